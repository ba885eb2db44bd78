"""Shared folders for intermediate tables, and batches for Python workers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
#: Temporary folders of local applications whose session names none.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one in local mode where it is unset, an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="llm-")
        _LOCAL[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once and outlives its executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(df: DataFrame) -> None:
    """Let Python workers import this package where it is not installed but lies in the same place; else ship it with the job."""
    env = df.sparkSession.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package within the workers' reach."""
    ship(df)
    return df.mapInArrow(run, schema)


_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]) -> object:
    """The one object that a worker remembers between tasks; one under another key takes its place, and its memory."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the cycle collector, which would go through a worker's millions of remembered words again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with lines before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(texts: list, most_chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most_chars`` characters each (a longer text is a range of its own)."""
    start = size = 0
    for k, text in enumerate(texts):
        n = len(text) if text else 0
        if k > start and size + n > most_chars:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
