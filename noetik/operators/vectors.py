"""A vector index in segments: rebuild, upsert, delete, exact search, stale vectors.

Each change writes a segment of the changed rows (see segments.py), so a reader never sees half of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import nearest
from .segments import Segments


class VectorIndex(Segments):
    """Rows object_type, object_id, vector, content_hash under a path, by object_type and object_id. Keys are unique."""

    COLUMNS = ["object_type", "object_id", "vector", "content_hash"]

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, ["object_type", "object_id"])

    def rebuild(self, vectors: DataFrame) -> None:
        """A version of these rows alone."""
        self.check(vectors)
        base = self.version()
        name = self.store(vectors.select(*self.COLUMNS))
        self.commit(base, [name])

    def upsert(self, vectors: DataFrame) -> None:
        self.update(vectors.select(*self.COLUMNS))

    def delete(self, keys: DataFrame) -> None:
        self.update(self.read().limit(0), keys)

    def search(self, query: list[float], k: int, object_types: list[str] | None = None) -> DataFrame:
        rows = self.read()
        rows = rows.where(F.col("object_type").isin(object_types)) if object_types else rows
        return nearest(rows, query, k, "object_id", "vector")

    def stale(self, objects: DataFrame) -> DataFrame:
        """object_type, object_id whose vector is missing or is of other content."""
        now = self.read().select("object_type", "object_id", F.col("content_hash").alias("indexed"))
        return objects.join(now, ["object_type", "object_id"], "left").where(~F.col("indexed").eqNullSafe(F.col("content_hash"))).select("object_type", "object_id")
