"""Readers and writers: raw float32 and fvecs matrices, layouts, labels and sweep results.

Matrix files are cut into byte ranges of whole records, which executors read on their own.
"""

from __future__ import annotations

import os
import struct
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that one task reads, about.
RANGE_BYTES = 64 << 20


def _open(path: str):
    """A seekable local or mounted file; other stores need pyarrow's file systems."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        return system.open_input_file(inner)
    return open(path.removeprefix("file:") if path.startswith("file:") else path, "rb")


def _create(path: str):
    """A new file, and the folder that it is in."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        system.create_dir(str(PurePosixPath(inner).parent), recursive=True)
        return system.open_output_stream(inner)
    path = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    return open(path, "wb")


def _size(f) -> int:
    if hasattr(f, "size") and callable(f.size):
        return f.size()
    at = f.tell()
    end = f.seek(0, 2)
    f.seek(at)
    return end


def _ranges(spark: SparkSession, path: str, n: int, record: int, offset: int, decode) -> DataFrame:
    rows = max(1, RANGE_BYTES // max(1, record))
    starts = spark.range(0, n, rows, max(1, -(-n // rows)))

    def run(batches):
        for batch in batches:
            with _open(path) as f:
                for start in batch.column(0).to_pylist():
                    count = min(rows, n - start)
                    f.seek(offset + start * record)
                    x = decode(f.read(count * record), count)
                    flat = pa.array(x.reshape(-1), pa.float32())
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, x.shape[1] or 1, dtype=np.int32)[: count + 1]), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + count)), vectors], names=["id", "features"])

    return starts.mapInArrow(run, "id long, features array<float>")


def read_raw(spark: SparkSession, path: str, n: int, dim: int, stride: int | None = None, offset: int = 0) -> DataFrame:
    """(id, features) of row-major float32: ``offset`` and ``stride`` in floats, bytes beyond ``n`` rows ignored."""
    stride = stride or dim
    if stride < dim:
        raise ValueError(f"stride {stride} is under the dimension {dim}")
    with _open(path) as f:
        need = 4 * (offset + n * stride)
        if _size(f) < need:
            raise ValueError(f"{path} has {_size(f)} bytes, {need} are needed")
    return _ranges(spark, path, n, 4 * stride, 4 * offset, lambda raw, count: np.frombuffer(raw, "<f4").reshape(count, stride)[:, :dim])


def read_fvecs(spark: SparkSession, path: str, n: int, dim: int) -> DataFrame:
    """(id, features) of the first ``n`` records, each an int32 dimension and as many floats; all must be ``dim``."""
    record = 4 + 4 * dim
    with _open(path) as f:
        if n:
            head = f.read(4)
            if len(head) < 4 or struct.unpack("<i", head)[0] != dim:
                raise ValueError(f"{path}: the first record isn't of dimension {dim}")
        if _size(f) < n * record:
            raise ValueError(f"{path} ends before record {n - 1}")

    def decode(raw: bytes, count: int) -> np.ndarray:
        table = np.frombuffer(raw, np.dtype([("d", "<i4"), ("x", "<f4", (dim,))]))
        if (table["d"] != dim).any():
            raise ValueError(f"{path}: a record isn't of dimension {dim}")
        return np.ascontiguousarray(table["x"])

    return _ranges(spark, path, n, record, 0, decode)


def read_vectors(spark: SparkSession, path: str, n: int, dim: int, **options) -> DataFrame:
    """By the name's end: fvecs, parquet with (id, features), or else raw float32."""
    if path.endswith(".fvecs"):
        return read_fvecs(spark, path, n, dim)
    if path.endswith(".parquet"):
        return spark.read.parquet(path).where(F.col("id") < n)
    return read_raw(spark, path, n, dim, **options)


def write_fvecs(x: np.ndarray, path: str) -> None:
    x = np.ascontiguousarray(x, "<f4")
    table = np.empty(len(x), np.dtype([("d", "<i4"), ("x", "<f4", (x.shape[1],))]))
    table["d"], table["x"] = x.shape[1], x
    with _create(path) as f:
        f.write(table.tobytes())


def write_raw(x: np.ndarray, path: str) -> None:
    with _create(path) as f:
        f.write(np.ascontiguousarray(x, "<f4").tobytes())


def write_vectors(vectors: DataFrame, path: str) -> int:
    """``vectors(id, features)`` in order of id, as fvecs or raw float32 by the name's end, and how many they
    are.  They stream through the driver a partition at a time, since one file has one writer."""
    n, dim = 0, None
    with _create(path) as f:
        for row in vectors.select("id", "features").orderBy("id").toLocalIterator(prefetchPartitions=True):
            x = np.asarray(row["features"], "<f4")
            dim = len(x) if dim is None else dim
            if len(x) != dim:
                raise ValueError(f"vector {row['id']} has {len(x)} components, not {dim}")
            f.write((struct.pack("<i", dim) if path.endswith(".fvecs") else b"") + x.tobytes())
            n += 1
    return n


def read_matrix(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(id, features) of a whole raw file: as many rows of ``dim`` as its size holds."""
    with _open(path) as f:
        n, rest = divmod(_size(f), 4 * dim)
    if rest:
        raise ValueError(f"{path} isn't a whole number of rows of {dim}")
    return read_raw(spark, path, n, dim)


def _axes(layout: DataFrame) -> list[str]:
    axes = [c for c in ("x", "y", "z") if c in layout.columns]
    if axes not in (["x", "y"], ["x", "y", "z"]):
        raise ValueError(f"a layout has x, y and perhaps z, not {axes}")
    return axes


def write_layout_f32(layout: DataFrame, path: str) -> None:
    """Row-major float32 in order of id, streamed through the driver a partition at a time."""
    axes = _axes(layout)
    with _create(path) as f:
        for row in layout.orderBy("id").select(*axes).toLocalIterator():
            f.write(struct.pack(f"<{len(axes)}f", *row))


def write_layout_csv(layout: DataFrame, folder: str) -> None:
    """Parts with a header id,x,y[,z] and six decimals, in order of id from part to part."""
    fixed = [F.format_string("%.6f", F.col(c).cast("double")).alias(c) for c in _axes(layout)]
    layout.orderBy("id").select("id", *fixed).write.mode("overwrite").csv(folder, header=True)


def write_layout(layout: DataFrame, base: str) -> tuple[str, str]:
    """Both forms, under the base's name without its last suffix; the paths written."""
    p = PurePosixPath(base)
    stem = str(p.with_suffix("")) if p.suffix else base
    write_layout_f32(layout, f"{stem}.f32")
    write_layout_csv(layout, f"{stem}.csv")
    return f"{stem}.f32", f"{stem}.csv"


def read_layout(spark: SparkSession, path: str, dim: int = 2) -> DataFrame:
    schema = "id long, x double, y double" + ", z double" * (dim == 3)
    return spark.read.schema(schema).csv(path, header=True)


def write_labels(labels: DataFrame, path: str) -> None:
    """``labels(id, label)`` as a .npy array in order of id; one file has one writer, so it holds them all."""
    values = np.array([r["label"] for r in labels.orderBy("id").select("label").toLocalIterator()])
    with _create(path) as f:
        np.lib.format.write_array(f, values)


def read_labels(spark: SparkSession, path: str) -> DataFrame | None:
    """(id, label) of a .npy array in order; None if there is no such file."""
    try:
        with _open(path) as f:
            values = np.lib.format.read_array(f)
    except FileNotFoundError:
        return None
    kind = "long" if np.issubdtype(values.dtype, np.integer) else "double"
    return spark.createDataFrame(pa.table({"id": np.arange(len(values)), "label": values.astype("int64" if kind == "long" else "float64")}))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Sweep results: a CSV as it is, or a JSON array whose successes get their config as config_* columns."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    runs = spark.read.json(path, multiLine=True).where("success")
    config = [F.col(f"config.{c}").alias(f"config_{c}") for c in runs.select("config.*").columns]
    return runs.select(*[c for c in runs.columns if c != "config"], *config)


def write_metrics(metrics: DataFrame, folder: str) -> None:
    metrics.write.mode("overwrite").json(folder)


def write_text(text: str, path: str) -> None:
    with _create(path) as f:
        f.write(text.encode())


def write_runs(runs: DataFrame, folder: str) -> None:
    runs.write.mode("overwrite").csv(folder, header=True)
