"""python -m noetik.cli: doctor, sync, reindex, search, export, backup, restore, cleanup over a folder of tables."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import jobs, postings
from .session import discard
from .sources import tables


def doctor(spark: SparkSession, folder: str) -> dict[str, str]:
    """Each table's rows, or what is wrong with it; one bad table does not hide the others."""
    out = {}
    for path in sorted(Path(folder).glob("*.parquet")):
        try:
            out[path.stem] = str(tables.table(spark, folder, path.stem).count())
        except Exception as e:  # noqa: BLE001
            out[path.stem] = f"unreadable: {type(e).__name__}"
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="noetik")
    p.add_argument("command", choices=["doctor", "sync", "reindex", "search", "export", "backup", "restore", "cleanup"])
    p.add_argument("folder")
    p.add_argument("--to", help="where to write, or to read from")
    p.add_argument("--words", nargs="*", default=[])
    a = p.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command != "doctor" and not a.to:
        p.error("--to is needed")
    if a.command == "doctor":
        found = doctor(spark, a.folder)
        print("\n".join(f"{n}: {v}" for n, v in found.items()))
        return int(any(v.startswith("unreadable") for v in found.values()) or not found)
    if a.command == "sync":
        now, new = tables.table(spark, a.folder, "documents"), spark.read.parquet(a.to)
        jobs.sync(now.select("doc_id", "text"), new.select("doc_id", "text"), "doc_id", "text").groupBy("change").count().show()
    elif a.command == "reindex":
        index = postings.PostingsIndex(spark, a.to)
        index.update(tables.table(spark, a.folder, "documents"), "doc_id")
    elif a.command == "search":
        postings.PostingsIndex(spark, a.to).scores([w.lower() for w in a.words]).orderBy(F.desc("score"), "doc").show(10)
    elif a.command == "export":
        docs = tables.table(spark, a.folder, "documents")
        head = F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\n---\n"))
        docs.select("lang", F.concat(head, F.coalesce("text", F.lit(""))).alias("value")).write.partitionBy("lang").text(a.to)
    elif a.command == "backup":
        jobs.backup({p.stem: tables.table(spark, a.folder, p.stem) for p in sorted(Path(a.folder).glob("*.parquet"))}, a.to)
    elif a.command == "restore":
        print("\n".join(sorted(jobs.restore(spark, a.to))))
    elif a.command == "cleanup":
        discard(spark, a.to)
    return 0


if __name__ == "__main__":
    sys.exit(main())
