"""Tables as immutable Parquet snapshots behind a pointer that is swapped whole."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import files


@dataclass(frozen=True)
class SnapshotTable:
    spark: SparkSession
    path: str

    @property
    def _pointer(self) -> str:
        return f"{self.path}/_current.json"

    def current(self) -> str | None:
        return (files.read_json(self.spark, self._pointer) or {}).get("version")

    def read(self) -> DataFrame | None:
        """The published snapshot; None before the first."""
        version = self.current()
        return self.spark.read.parquet(f"{self.path}/v={version}") if version else None

    def publish(self, rows: DataFrame, run_id: str, partition_by: tuple[str, ...] = (), files_count: int | None = None) -> int:
        """Write a new snapshot, then point to it; returns its rows, counted while they are written.

        Readers see the old snapshot or the new one. A run that fails leaves the pointer alone.
        """
        version = f"{re.sub('[^A-Za-z0-9_.-]', '_', run_id)}.{uuid.uuid4().hex[:6]}"
        counted = Observation(f"publish-{version}")
        out = rows.coalesce(files_count) if files_count else rows
        writer = out.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/v={version}")
        self._point(version, run_id)
        return int(counted.get["rows"])

    def _point(self, version: str, run_id: str, keep: list[str] | None = None) -> None:
        """The pointer names the version and, oldest first, all that were current before it."""
        old = files.read_json(self.spark, self._pointer) or {}
        past = [v for v in [*(old.get("history") or []), old.get("version")] if v and v != version]
        past = list(dict.fromkeys(reversed(past)))[::-1]
        if keep is not None:
            past = [v for v in past if v in keep]
        files.write_json(self.spark, self._pointer, {"version": version, "previous": past[-1] if past else None, "history": past, "run_id": run_id})

    def versions(self) -> list[str]:
        return [x[2:] for x in files.children(self.spark, self.path) if x.startswith("v=")]

    def rollback(self, version: str) -> None:
        if version not in self.versions():
            raise ValueError(f"no such snapshot: {version}")
        self._point(version, "rollback")

    def retain(self, n: int) -> list[str]:
        """Delete all snapshots but the current one and the n - 1 that were current last before it; returns the deleted.

        Snapshots that never were current, as of a run that failed, go too; so one writer at a time.
        """
        pointer = files.read_json(self.spark, self._pointer) or {}
        past = pointer.get("history") or []
        kept = [*past[len(past) - min(len(past), max(0, n - 1)) :], pointer.get("version")]
        gone = [v for v in self.versions() if v not in kept]
        if pointer:
            self._point(pointer["version"], pointer["run_id"], kept)
        for version in gone:
            files.delete(self.spark, f"{self.path}/v={version}")
        return gone
