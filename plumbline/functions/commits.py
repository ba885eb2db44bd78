"""Tables that grow by whole runs: a run counts once its marker exists, and counts once.

A run's files are written to a folder of their own, and a marker file, put in place last by one rename, makes them part of
the table. A run that dies half-way leaves no marker, so readers never see it and the next
attempt writes over it; a run that is written again finds its marker and does nothing. A marker may name runs it replaces,
which is how small runs are put together without a moment in which rows are missing or doubled. No step relies on renaming
folders, so object stores serve as well. Two writers of one run at the same moment are not told apart.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession

from plumbline.functions.lineage import discard


@dataclass(frozen=True)
class Run:
    id: str
    replaces: tuple[str, ...] = ()


class Log:
    """The runs of a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _marker(self, run: str) -> str:
        return f"{self.root}/_runs/{run}.json"

    def folder(self, run: str) -> str:
        return f"{self.root}/run={run}"

    def _markers(self) -> dict[str, Run]:
        fs, folder = self._fs(f"{self.root}/_runs")
        out = {}
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            name = status.getPath().getName()
            if not name.endswith(".json"):
                continue
            stream = fs.open(status.getPath())
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text:  # an empty one is being written, or its writer died
                out[name[:-5]] = Run(name[:-5], tuple(json.loads(text)["replaces"]))
        return out

    def runs(self) -> list[str]:
        """Runs that count, in the order of their names."""
        markers = self._markers()
        gone = {old for run in markers.values() for old in run.replaces}
        return sorted(set(markers) - gone)

    def folders(self) -> list[str]:
        return [self.folder(run) for run in self.runs()]

    def done(self, run: str) -> bool:
        """Whether the run counts, or counted until another replaced it."""
        markers = self._markers()
        return run in markers or any(run in other.replaces for other in markers.values())

    def add(self, run: str, write: Callable[[str], None], replaces: Sequence[str] = ()) -> bool:
        """Let ``write`` fill the run's folder, then make it count. False, and nothing written, if it counts already."""
        if not run or any(c in run for c in "/\\:*?[]{}=%") or run.startswith(("_", ".")):
            raise ValueError(f"a run's name must be usable as the name of a folder, got {run!r}")
        if self.done(run):
            return False
        write(self.folder(run))
        fs, draft = self._fs(f"{self.root}/_runs/_{run}.tmp")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps({"replaces": list(replaces)}), "utf-8"))
        stream.close()
        return bool(fs.rename(draft, self._fs(self._marker(run))[1]))

    def clean(self) -> None:
        """Delete what replaced runs left. Not while a reader may still hold their files."""
        markers = self._markers()
        for old in {old for run in markers.values() for old in run.replaces}:
            discard(self.spark, self.folder(old))
