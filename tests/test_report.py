"""What a run took, stage by stage, the listing as files, and the command line on a given session."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from merset import session
from merset.plans import cli
from merset.plans.methods import find_mis
from merset.plans.report import STAGE, stages_measured
from merset.plans.sink import HEADER, write_listing
from merset.session import cut, scratch_cleared


def joined(path):
    return "".join(p.read_text() for p in sorted(Path(path).iterdir()) if p.suffix == ".txt").splitlines()


def test_a_row_for_each_stage_of_the_block(spark):
    spark.range(10).count()  # before
    spark.sparkContext.setJobGroup("own", "mine")
    out = []
    with stages_measured(spark, out):
        spark.range(200_000).groupBy((F.col("id") % 1000).alias("x")).count().repartition(3).write.format("noop").mode("overwrite").save()
    spark.range(10).count()  # after
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "own"
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = out[0].collect()
    assert out[0].schema.simpleString() == spark.createDataFrame([], STAGE).schema.simpleString()
    assert 2 <= len(rows) <= 4 and len({(r.stage, r.attempt) for r in rows}) == len(rows)
    assert sum(r.shuffle_written for r in rows) > 1000 and sum(r.shuffle_read for r in rows) == sum(r.shuffle_written for r in rows)
    assert all(r.tasks > 0 and r.failed_tasks == 0 and r.run_s >= 0 and r.cpu_s >= 0 for r in rows) and sum(r.cpu_s for r in rows) > 0
    assert max(r.peak_memory for r in rows) > 0


def test_an_error_in_the_block_leaves_no_group_behind(spark):
    with pytest.raises(ZeroDivisionError), stages_measured(spark, []):
        1 / 0
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


@pytest.mark.parametrize("files", [1, 3, None])
def test_listing_is_in_order_of_selection(spark, tmp_path, files):
    mis = cut(find_mis(spark, 4, 2), "mis")
    want = [r.kmer for r in mis.orderBy("sel_idx").collect()]
    manifest = write_listing(mis.orderBy(F.rand(1)), f"file://{tmp_path}/l", files)
    assert joined(tmp_path / "l") == [HEADER, *want, "The graph has an independent set of size 12."]
    assert json.loads((tmp_path / "l" / "_manifest.json").read_text()) == manifest and manifest["size"] == 12
    for f in manifest["files"]:
        assert (tmp_path / "l" / f["file"]).read_text().split() == want[f["first"] - 1 :][: f["kmers"]]
    with pytest.raises(FileExistsError):
        write_listing(mis, f"file://{tmp_path}/l")


def test_empty_and_failed_listings(spark, tmp_path):
    none = spark.createDataFrame([(1, None, "x")], "sel_idx long, kmer string, file string")
    assert write_listing(none, f"{tmp_path}/e") == {"size": 0, "files": []}
    assert joined(tmp_path / "e") == [HEADER, "The graph has an independent set of size 0."]
    broken = spark.range(4).select(F.col("id").alias("sel_idx"), F.when(F.col("id") < 3, F.lit("AC")).otherwise(F.raise_error(F.lit("lost")).cast("string")).alias("kmer"))
    with pytest.raises(Exception, match="lost"):
        write_listing(broken, f"{tmp_path}/b")
    assert sorted(x.name for x in tmp_path.iterdir()) == ["e"]  # neither a listing nor a draft


def test_command_line_uses_the_session_and_clears_up(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(session, "_made", [])
    monkeypatch.setattr(cli, "get_spark", lambda: pytest.fail("a session is there"))
    kept = cut(spark.range(3), "kept")
    assert cli.main(["-k", "3", "-d", "2", "--listing", f"{tmp_path}/l", "--stages", f"{tmp_path}/s"], spark) == 0
    assert joined(tmp_path / "l")[1:-1] == ["AAA", "CCC", "GGG", "TTT"]
    assert spark.read.parquet(f"{tmp_path}/s").where("tasks > 0").count() > 3
    assert len(session._made) == 1 and kept.count() == 3
    assert cli.main(["-k", "2", "-d", "1"]) == 0 and "AA\nCC\nGG\nTT" in capsys.readouterr().err
    with pytest.raises(RuntimeError), scratch_cleared(spark):
        cut(spark.range(3), "gone")
        raise RuntimeError
    assert len(session._made) == 1
