"""Runs of many configurations over one set of points, with a row of metrics each, and their report."""

from __future__ import annotations

import time
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.operators import evaluate
from vicinal.operators.layout import AXES, Config, embed
from vicinal.session import cut


def flat(layout: DataFrame, dim: int = 2) -> DataFrame:
    """(id, v) of a layout's coordinates."""
    return layout.select("id", F.array(*AXES[:dim]).alias("v"))


def metrics(points: DataFrame, layout: DataFrame, dim: int = 2, k: int = 30, labels: DataFrame | None = None) -> DataFrame:
    """One row: separation, spread, density, preservation, and with ``labels(id, label)`` the silhouette."""
    at = cut(flat(layout, dim), "flat")
    n = at.count()
    parts = [evaluate.separation(at), evaluate.spread(at), evaluate.local_density(at, min(10, n - 1)), evaluate.preservation(points, at, min(k, n - 1))]
    if labels is not None:
        parts.append(evaluate.silhouettes(at.join(labels, "id")).agg(F.avg("silhouette").alias("silhouette")))
    row = parts[0].withColumn("one", F.lit(1))
    for part in parts[1:]:  # each has one row
        row = row.join(part.withColumn("one", F.lit(1)), "one")
    return row.drop("one")


def configs(base: Config, sweep: dict[str, list]) -> list[tuple[str, Config]]:
    """(test id, configuration) for each combination; ``gamma`` sets both of a configuration's gammas."""
    from itertools import product

    out = []
    names = sorted(sweep)
    for values in product(*[sweep[n] for n in names]):
        chosen = dict(zip(names, values, strict=True))
        named = "_".join(f"{n}_{v}" for n, v in chosen.items())
        if "gamma" in chosen:
            chosen |= {"gamma_coarse": chosen["gamma"], "gamma_fine": chosen.pop("gamma")}
        out.append((named, replace(base, **chosen)))
    return out


def kind(name: str, custom: Config | None = None) -> list[tuple[str, Config]]:
    """(test id, configuration) of a kind of sweep: those of evaluate.SWEEPS around the baseline, ``baseline``
    alone, ``comprehensive`` with one parameter after the other, and ``custom``."""
    base = Config(**evaluate.BASELINE)
    if name == "baseline":
        return [("baseline", base)]
    if name == "custom":
        return [("custom", custom or base)]
    if name != "comprehensive":
        return configs(base, evaluate.SWEEPS[name])
    out = [c for one in ("K", "perplexity", "lr") for c in configs(base, evaluate.SWEEPS[one])]
    out += [c for a, b in evaluate.COMPREHENSIVE_EPOCHS for c in configs(base, {"epochs_coarse": [a], "epochs_fine": [b]})]
    return out + configs(base, evaluate.SWEEPS["mneg"]) + configs(base, {"gamma": evaluate.COMPREHENSIVE_GAMMAS})


def run_sweep(
    spark: SparkSession, points: DataFrame, base: Config, sweep: dict[str, list] | list[tuple[str, Config]], most: int | None = None, labels: DataFrame | None = None
) -> DataFrame:
    """One row for each run: test_id, success, error, elapsed_time, config_* and metrics (null where it failed).

    ``sweep``: lists of parameters around ``base``, or the configurations of ``kind``.
    """
    rows: DataFrame | None = None
    for test_id, config in (configs(base, sweep) if isinstance(sweep, dict) else sweep)[:most]:
        began = time.time()
        try:
            found = cut(metrics(points, embed(spark, points, config), config.dim, labels=labels), "metrics")
            error = None
        except ValueError as e:  # a configuration that the points don't allow
            found, error = spark.range(1).select(), str(e)
        fixed = {"test_id": test_id, "success": error is None, "error": error, "elapsed_time": time.time() - began}
        fixed |= {f"config_{k}": v for k, v in asdict(config).items()}
        row = found.select(*[F.lit(v).cast("string" if v is None else type(v).__name__.replace("str", "string").replace("bool", "boolean").replace("float", "double")).alias(k) for k, v in fixed.items()], *found.columns)
        rows = row if rows is None else rows.unionByName(row, allowMissingColumns=True)
    return cut(rows, "runs")


def report(runs: DataFrame, metric: str = "knn_overlap_pct") -> dict[str, DataFrame]:
    """The tables of a sweep's report: counts, run times, the metric, its sensitivity and the best runs."""
    done = runs.where("success")
    counts = runs.agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"))
    tables = {"counts": counts, "elapsed_time": evaluate.scalars(done, "elapsed_time"), metric: evaluate.scalars(done, metric), "best": evaluate.best(done, metric, "test_id")}
    swept = ("config_k", "config_perplexity", "config_rate", "config_epochs_coarse", "config_epochs_fine", "config_negatives", "config_gamma_fine", "config_pull", "config_shrink")
    return tables | {name: evaluate.sensitivity(done, name, metric) for name in swept}


def report_text(tables: dict[str, DataFrame], metric: str = "knn_overlap_pct") -> str:
    """The report as text: counts, times, the metric, its sensitivity to each parameter and the best runs."""
    counts, time_, found = (tables[name].first() for name in ("counts", "elapsed_time", metric))
    show = lambda x, unit="": "none" if x is None else f"{x:.2f}{unit}"
    out = [f"Runs: {counts['total']}, successful: {counts['successful']}", ""]
    for title, row, unit in (("Seconds", time_, "s"), (metric, found, "")):
        out += [title, *[f"  {name}: {show(row[name], unit)}" for name in ("mean", "median", "least", "most")], ""]
    for name in sorted(n for n in tables if n.startswith("config_")):
        out += [name, *[f"  {r[name]}: {show(r['mean'])} +- {show(r['std'])} ({r['n']})" for r in tables[name].orderBy(name).collect()], ""]
    out += [f"Best by {metric}", *[f"  {r['test_id']}: {show(r[metric])}" for r in tables["best"].collect()]]
    return "\n".join(out) + "\n"
