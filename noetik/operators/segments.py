"""Keyed tables in segments: a change writes what changes, readers hold a version.

A segment holds rows and the keys that it touches (those of its rows and those it deletes); a row is live unless a later
segment touches its key. A version is a small file that names its segments and is created, never replaced: of two writers
that start from one version the second fails and can try again. Compaction writes the live rows as one segment, in a new
version, so what a reader has opened stays as it is until vacuum() removes what no kept version names.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard


class Conflict(RuntimeError):
    """Another writer has made the version first."""


class Segments:
    """Rows under a path, keyed by key columns. Keys are unique and never null; update() raises where they are not."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path, key
        jvm = spark._jvm
        self._new = jvm.org.apache.hadoop.fs.Path
        self._files = self._new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def versions(self) -> list[int]:
        folder = self._new(f"{self.path}/versions")
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(folder)) if self._files.exists(folder) else []

    def version(self, number: int | None = None) -> dict:
        """The newest version, or the one asked for: number, segments (oldest first) and what the writer noted."""
        known = self.versions()
        if not known:
            return {"number": 0, "segments": []}
        number = known[-1] if number is None else number
        if number not in known:
            raise KeyError(f"no version {number}")
        lines = self.spark.read.text(f"{self.path}/versions/{number}", wholetext=True).collect()  # one short file
        return json.loads(lines[0].value)

    def commit(self, base: dict, segments: list[str], **noted) -> dict:
        made = {"number": base["number"] + 1, "segments": segments, **noted}
        target = self._new(f"{self.path}/versions/{made['number']}")
        try:
            out = self._files.create(target, False)
        except Exception as e:
            if self._files.exists(target):
                raise Conflict(f"version {made['number']} exists") from e
            raise
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        return made

    # rows

    def folder(self, segment: str, name: str = "rows") -> str:
        return f"{self.path}/segments/{segment}/{name}"

    def of(self, segment: str, name: str = "rows") -> DataFrame:
        return self.spark.read.parquet(self.folder(segment, name))

    def table(self, version: dict, name: str = "rows") -> DataFrame:
        """A table of all segments, with its segment's number as seg (0: the oldest)."""
        if not version["segments"]:
            raise KeyError(f"nothing is stored under {self.path}")
        return reduce(lambda a, b: a.unionByName(b), [self.of(s, name).withColumn("seg", F.lit(k)) for k, s in enumerate(version["segments"])])

    def dead(self, version: dict) -> DataFrame | None:
        """Key columns and before: rows of the key in segments below it are dead. Only segments after the first are
        read, so its size is that of the changes since the last compaction."""
        later = [self.of(s, "keys").withColumn("before", F.lit(k)) for k, s in enumerate(version["segments"]) if k]
        return reduce(lambda a, b: a.unionByName(b), later).groupBy(*self.key).agg(F.max("before").alias("before")) if later else None

    def live(self, rows: DataFrame, version: dict) -> DataFrame:
        """rows (with seg) without those of dead keys."""
        dead = self.dead(version)
        if dead is None:
            return rows
        dead = dead.select(*(F.col(c).alias(f"_dead_{c}") for c in self.key), "before")
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_dead_{c}") for c in self.key])
        return rows.join(dead, same & (F.col("seg") < F.col("before")), "left_anti")

    def read(self, number: int | None = None) -> DataFrame:
        version = self.version(number)
        return self.live(self.table(version), version).drop("seg")

    def check(self, rows: DataFrame) -> None:
        bad = rows.groupBy(*self.key).agg(F.count("*").alias("_n")).where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in self.key], F.col("_n") > 1))
        if not bad.isEmpty():
            raise ValueError(f"null or repeated key {self.key}")

    def update(self, rows: DataFrame, deleted: DataFrame | None = None) -> dict:
        """A version in which rows stand for their keys and deleted keys are gone."""
        self.check(rows)
        base = self.version()
        return self.commit(base, [*base["segments"], self.store(rows, deleted)])

    def store(self, rows: DataFrame, deleted: DataFrame | None = None) -> str:
        """A segment that no version names yet."""
        name = uuid.uuid4().hex
        rows.write.parquet(self.folder(name))
        keys = self.of(name).select(*self.key)
        (keys if deleted is None else keys.unionByName(deleted.select(*self.key)).distinct()).write.parquet(self.folder(name, "keys"))
        return name

    def compact(self) -> dict:
        """The live rows as one segment."""
        base = self.version()
        name = self.store(self.live(self.table(base), base).drop("seg"))
        return self.commit(base, [name], **{k: v for k, v in base.items() if k not in ("number", "segments")})

    def size(self, segment: str) -> int:
        """Bytes of a segment."""
        return self._files.getContentSummary(self._new(f"{self.path}/segments/{segment}")).getLength()

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the newest `keep` versions and the segments that only they name. Readers of these must be done."""
        known = self.versions()
        kept = {s for n in known[-keep:] for s in self.version(n)["segments"]}
        gone = {s for n in known[:-keep] for s in self.version(n)["segments"]} - kept
        for n in known[:-keep]:
            discard(self.spark, f"{self.path}/versions/{n}")
        for s in gone:
            discard(self.spark, f"{self.path}/segments/{s}")
