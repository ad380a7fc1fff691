"""Capabilities that models and platforms provide, with deterministic stand-ins, and how tables call them.

A capability is a protocol; a registry maps roles to implementations. Calls run batch by batch on executors, with one
result and one error column for each row, so that a failed row never fails its batch. Results are checked against a
schema: what does not parse, or holds other fields, is an error and not a guess.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROLES = ["triage_model", "extraction_model", "query_planner_model", "answer_model", "vision_model", "embedding_model", "asr_provider", "ocr_provider"]


class ChatModel(Protocol):
    def complete(self, prompt: str) -> str: ...


class StructuredModel(Protocol):
    def extract(self, text: str) -> str:
        """JSON."""


class VisionModel(Protocol):
    def describe(self, key: str) -> str: ...


class EmbeddingModel(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ASRProvider(Protocol):
    def transcribe(self, key: str) -> str: ...


class OCRProvider(Protocol):
    def read(self, key: str) -> str: ...


class Retryable(RuntimeError):
    """The call may succeed later."""


class Terminal(RuntimeError):
    """The call will never succeed."""


class CaptureProvider(Protocol):
    def health(self) -> str: ...
    def list_collections(self) -> list[dict]: ...
    def iterate_sources(self, collection: str) -> list[dict]: ...
    def fetch_source(self, external_id: str) -> dict: ...
    def acquire_media(self, external_id: str) -> str: ...


@dataclass
class FakeModel:
    """Every model capability, from the input alone."""

    dimensions: int = 8

    def complete(self, prompt: str) -> str:
        return prompt.strip().split("\n")[-1][:200]

    def extract(self, text: str) -> str:
        if "BROKEN" in text:
            return "{not json"
        words = text.split()
        return json.dumps({"title": " ".join(words[:3]), "n_words": len(words)})

    def describe(self, key: str) -> str:
        return f"image {hashlib.sha256(key.encode()).hexdigest()[:8]}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[: self.dimensions]] for t in texts]

    transcribe = read = describe


@dataclass
class FakeCapture:
    """A platform in memory: collections of items with external_id, title, and perhaps fail (retryable or terminal)."""

    collections: dict[str, list[dict]] = field(default_factory=dict)
    down: bool = False

    def health(self) -> str:
        return "down" if self.down else "ok"

    def list_collections(self) -> list[dict]:
        return [{"external_id": c, "n": len(v)} for c, v in sorted(self.collections.items())]

    def iterate_sources(self, collection: str) -> list[dict]:
        return self.collections.get(collection, [])

    def fetch_source(self, external_id: str) -> dict:
        for item in (x for v in self.collections.values() for x in v):
            if item["external_id"] == external_id:
                if item.get("fail"):
                    raise (Retryable if item["fail"] == "retryable" else Terminal)(f"{external_id}: {item['fail']}")
                return item
        raise Terminal(f"{external_id}: not found")

    def acquire_media(self, external_id: str) -> str:
        return f"media/{self.fetch_source(external_id)['external_id']}"


class Registry:
    """Roles to implementations; one may fill several."""

    def __init__(self, **roles: object):
        if unknown := set(roles) - set(ROLES):
            raise ValueError(f"unknown roles: {sorted(unknown)}")
        self.roles = roles

    def get(self, role: str) -> object:
        if role not in self.roles:
            raise KeyError(f"no provider for {role}")
        return self.roles[role]


def call(df: DataFrame, column: str, function, into: str = "result") -> DataFrame:
    """df with a string column of the function's results and a column error: retryable, terminal or null. function: one
    text to one string; null stays null. A column of df with one of these names is replaced."""
    import pyarrow as pa

    keep = df.drop(into, "error")
    at = keep.columns.index(column)

    def rows(batches):
        for b in batches:
            out, errors = [], []
            for x in b.column(at).to_pylist():
                try:
                    out.append(None if x is None else function(x))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a row's failure is that row's
                    out.append(None)
                    errors.append("terminal" if isinstance(e, Terminal) else "retryable")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), pa.array(errors, pa.string())], [*b.schema.names, into, "error"])

    from pyspark.sql import types as T

    return keep.mapInArrow(rows, T.StructType([*keep.schema.fields, T.StructField(into, T.StringType()), T.StructField("error", T.StringType())]))


def structured(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with the fields of a JSON column and a column invalid, true where it does not parse or lacks a field."""
    names = [f.split()[0] for f in schema.split(", ")]
    parsed = F.from_json(column, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = df.withColumn("_p", parsed)
    lacks = F.coalesce(F.size(F.array_except(F.array(*map(F.lit, names)), F.json_object_keys(column))) > 0, F.lit(True))
    return out.select(*df.columns, *[F.col(f"_p.{n}").alias(n) for n in names], (F.col("_p").isNull() | F.col("_p._bad").isNotNull() | lacks).alias("invalid"))


class CaptureSource(DataSource):
    """spark.read.format("capture").option("path", folder): a folder with a JSON-lines file for each collection, read as
    one partition each. Columns: collection_id, external_id, title."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return "collection_id string, external_id string, title string"

    def reader(self, schema):  # noqa: ARG002
        return CaptureReader(self.options["path"])


class CaptureReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        from pathlib import Path

        return [InputPartition(str(p)) for p in sorted(Path(self.path).glob("*.jsonl"))]

    def read(self, partition):
        from pathlib import Path

        path = Path(partition.value)
        with path.open(encoding="utf-8") as lines:
            for line in lines:
                if line.strip():
                    item = json.loads(line)
                    yield path.stem, item.get("external_id"), item.get("title")
