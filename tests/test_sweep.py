"""Sweeps of runs and the command line."""

import numpy as np
import pytest

from vicinal.__main__ import main, parse
from vicinal.operators.layout import Config
from vicinal.plans import sweep
from vicinal.sources.vectors import read_layout, write_fvecs


def points(spark, n=60):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, rng.normal(i % 3 * 4, 1, 6).tolist()) for i in range(n)], "id long, v array<double>")


def test_sweep_and_report(spark):
    base = Config(k=8, perplexity=4.0, epochs_coarse=5, epochs_fine=5)
    runs = sweep.run_sweep(spark, points(spark), base, {"k": [6, 200]})
    rows = {r["test_id"]: r for r in runs.collect()}
    assert rows["k_6"]["success"] and rows["k_6"]["knn_overlap_pct"] > 0 and rows["k_6"]["config_k"] == 6
    assert not rows["k_200"]["success"] and rows["k_200"]["knn_overlap_pct"] is None and "200" in rows["k_200"]["error"]
    tables = sweep.report(runs)
    assert tuple(tables["counts"].first()) == (2, 1)
    assert tables["config_k"].first()["std"] is None
    text = sweep.report_text(tables)
    assert text.startswith("Runs: 2, successful: 1") and "+- none (1)" in text and text.rstrip().splitlines()[-1].startswith("  k_6: ")


def test_kinds_of_sweeps():
    assert {n: len(sweep.kind(n)) for n in ("baseline", "K", "epochs", "mneg", "coarsening", "comprehensive", "custom")} == {
        "baseline": 1, "K": 4, "epochs": 16, "mneg": 3, "coarsening": 16, "comprehensive": 21, "custom": 1,
    }
    assert sweep.kind("coarsening")[0] == ("pull_2_shrink_0.6", Config(k=100, perplexity=50.0, epochs_coarse=50, epochs_fine=100, pull=2, shrink=0.6))
    assert sweep.kind("custom", Config(k=7))[0][1].k == 7


def test_names_of_a_sweep():
    found = sweep.configs(Config(), {"gamma": [1.0, 5.0]})
    assert [(n, c.gamma_fine, c.gamma_coarse) for n, c in found] == [("gamma_1.0", 1.0, 1.0), ("gamma_5.0", 5.0, 5.0)]


def test_command_line(spark, tmp_path, capsys):
    x = np.random.default_rng(1).normal(size=(50, 8)).astype("f4")
    write_fvecs(x, str(tmp_path / "x.fvecs"))
    common = ["--input", str(tmp_path / "x.fvecs"), "--n", "50", "--dim-in", "8", "--out", str(tmp_path / "out")]
    main([*common, "--k", "6", "--perplexity", "4", "--epochs-coarse", "3", "--epochs-fine", "3", "--gamma-fine", "-1.5", "--metrics"])
    assert '"knn_overlap_pct"' in capsys.readouterr().out
    assert read_layout(spark, str(tmp_path / "out.csv")).count() == 50
    assert parse([*common, "--gamma-fine", "-2"])[1].gamma_fine == -2.0
    with pytest.raises(SystemExit):
        parse(["--input", "x"])
    with pytest.raises(ValueError):
        parse([*common, "--dim", "5"])
