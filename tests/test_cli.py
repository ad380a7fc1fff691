from noetik import cli
from noetik.operators import jobs, windows
from pyspark.sql import functions as F
import pytest

SF = "/root/testdata/sf0.001"


def test_commands(spark, tmp_path, capsys):
    assert cli.main(["doctor", SF], spark) == 0 and "documents: 200" in capsys.readouterr().out
    assert cli.main(["reindex", SF, "--to", str(tmp_path / "index")], spark) == 0
    assert cli.main(["search", SF, "--to", str(tmp_path / "index"), "--words", "The"], spark) == 0
    assert "score" in capsys.readouterr().out
    cli.main(["cleanup", SF, "--to", str(tmp_path / "index")], spark)
    assert not (tmp_path / "index").exists()
    (tmp_path / "bad.parquet").write_text("no table")
    assert cli.main(["doctor", str(tmp_path)], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["export", SF], spark)


def test_a_changed_backup_is_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    jobs.backup({"t": df}, str(tmp_path / "b"))
    assert jobs.restore(spark, str(tmp_path / "b"))["t"].count() == 2
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "b" / "t"))
    with pytest.raises(ValueError):
        jobs.restore(spark, str(tmp_path / "b"))


def test_wide_ranks_are_ranks(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id")
    order = [F.desc("v"), F.col("id")]
    a = {(r.id, r.rank) for r in windows.ranked(df, ["g"], order).collect()}
    assert {(r.id, r.rank) for r in windows.ranked_wide(df, ["g"], order).collect()} == a
