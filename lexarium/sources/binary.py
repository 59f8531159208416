"""Length-prefixed big-endian arrays of numbers in files, as written by Java's data streams."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_KINDS = {"double": ">f8", "int": ">i4"}


def write_arrays(df: DataFrame, path: str, column: str = "v", kind: str = "double") -> DataFrame:
    """Write each row's array as a count and its numbers, a file a partition; returns the files (uri, n) when it is run."""

    def run(batches):
        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(at, recursive=True)
        name, n = f"{at}/{uuid.uuid4().hex}.bin", 0
        with store.open_output_stream(name) as out:
            for b in batches:
                for row in b.column(0).to_pylist():
                    out.write(np.array([len(row)], ">i4").tobytes() + np.array(row, _KINDS[kind]).tobytes())
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["uri", "n"])

    return df.select(column).mapInArrow(run, "uri string, n long")


def arrays(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """(file, place, v) of all arrays in the files under ``path``; each file is one task's."""
    width = np.dtype(_KINDS[kind]).itemsize

    def run(batches):
        for b in batches:
            for file, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out, at = [], 0
                while at < len(raw):
                    n = int(np.frombuffer(raw, ">i4", 1, at)[0])
                    out.append(np.frombuffer(raw, _KINDS[kind], n, at + 4).astype(_KINDS[kind][1:]))
                    at += 4 + n * width
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(out), pa.string()), pa.array(np.arange(len(out))), pa.array([x.tolist() for x in out], pa.list_(pa.float64() if kind == "double" else pa.int32()))], ["file", "place", "v"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, place long, v array<{kind}>")
