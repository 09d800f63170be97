import random
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from test_kmers import DIST, kmers

from merset.functions.kmers import decode, encode
from merset import session
from merset.operators import rootset
from merset.plans import cli, methods
from merset.plans.methods import METHODS, assign, cover_from_neighbors, find_mis, not_covered
from merset.plans.report import measured, size
from merset.plans.verify import dependent_pairs, uncovered
from merset.session import cut
from merset.sources.universe import full_universe

#: Members in order of selection, and sizes. Fixed values.
GOLDEN = {
    ("edit", 2, 1): "AA CC GG TT", ("hamming", 3, 2): "AAA CCC GGG TTT",
    ("edit", 4, 2): "AAAA ACCC AGGG ATTT CACG CCAT CGTA CTGC GAGT GGAC TATC TTAG",
    ("hamming", 4, 2): "AAAA ACCC AGGG ATTT CACG CCAT CGTA CTGC GAGT GCTG GGAC GTCA TATC TCGA TGCT TTAG",
    ("edit", 4, 3): "AAAA CCCC GGGG TTTT",
    ("edit", 5, 3): "AAAAA ACCCC AGGGG ATTTT CACGT CCTAG CGATC CTGCA",
}
SIZES = {("edit", 3, 1): 16, ("hamming", 4, 1): 64, ("edit", 6, 4): 4, ("hamming", 5, 3): 16}


def greedy(names, d, metric):
    out = []
    for x in names:
        if all(DIST[metric](x, m) > d for m in out):
            out.append(x)
    return out


def listed(df):
    return [r.kmer for r in df.orderBy("sel_idx").collect()]


@pytest.mark.parametrize("metric,k,d", list(GOLDEN))
def test_golden_lists(spark, metric, k, d):
    assert " ".join(listed(find_mis(spark, k, d, metric))) == GOLDEN[metric, k, d]


@pytest.mark.parametrize("metric,k,d", list(SIZES))
def test_golden_sizes(spark, metric, k, d):
    assert size(find_mis(spark, k, d, metric)).first().mis_size == SIZES[metric, k, d]


@pytest.mark.parametrize("metric", ["edit", "hamming"])
@pytest.mark.parametrize("method", METHODS)
def test_methods_equal_sequential_greedy_on_subsets(spark, metric, method, monkeypatch):
    monkeypatch.setattr(methods, "FIRST", 10)  # three chunks
    monkeypatch.setattr(methods, "GROWTH", 3)
    rng = random.Random(11)
    names = sorted(rng.sample(kmers(4), 90))
    u = spark.createDataFrame([(x,) for x in names], "kmer string").select(encode(F.col("kmer")).alias("enc"), "kmer")
    assert listed(find_mis(u, 4, 2, metric, method)) == greedy(names, 2, metric)


def test_bfs_is_right_beyond_five(spark):
    assert listed(find_mis(spark.createDataFrame([(x,) for x in ("AAAAAAA", "AAAACCC", "CCCCCCC", "GGGGGGG", "TTTTTTT")], "kmer string").select(encode(F.col("kmer")).alias("enc"), "kmer"), 7, 6, "edit", "bfs")) == ["AAAAAAA", "CCCCCCC", "GGGGGGG", "TTTTTTT"]


@pytest.mark.parametrize("metric", ["edit", "hamming"])
@pytest.mark.parametrize("method", METHODS)
def test_random_orders_are_independent_and_maximal(spark, metric, method):
    u = cut(full_universe(spark, 3), "u")
    mis = cut(find_mis(u, 3, 1, metric, method, "random", seed=9), "mis")
    assert dependent_pairs(mis, 3, 1, metric).isEmpty() and uncovered(u, mis, 3, 1, metric).isEmpty()
    if (metric, method) == ("edit", "improved"):
        assert listed(mis)[0] == "AAA"
    again = find_mis(u, 3, 1, metric, method, "random", seed=9)
    assert listed(again) == listed(mis)


def test_assignment_and_neighbor_cover(spark):
    u = cut(full_universe(spark, 4), "u")
    mis = cut(find_mis(u, 4, 2), "mis")
    members = listed(mis)
    got = {r.kmer: (r.cover, r.dist) for r in assign(u, mis, 4, 2, "edit").select(decode(F.col("enc"), 4).alias("kmer"), decode(F.col("cover"), 4).alias("cover"), "dist").collect()}
    assert got == {x: next((m, DIST["edit"](x, m)) for m in members if DIST["edit"](x, m) <= 2) for x in kmers(4)}
    known = assign(u, mis, 4, 2, "edit").select("enc", "cover", decode(F.col("cover"), 4).alias("cover_kmer"))
    for r in cover_from_neighbors(u, known, 4, 2, "edit").select(decode(F.col("enc"), 4).alias("kmer"), decode(F.col("cover"), 4).alias("cover")).collect():
        assert DIST["edit"](r.kmer, r.cover) <= 2


def test_cover_check_without_broadcast(spark, monkeypatch):
    u = full_universe(spark, 3).withColumn("rank", F.col("enc"))
    members = u.where("kmer in ('AAA', 'CCC')")
    want = {r.kmer for r in not_covered(u, members, 3, 2, "edit").collect()}
    monkeypatch.setattr(methods, "MOST_BROADCAST", 0)
    assert {r.kmer for r in not_covered(u, members, 3, 2, "edit").collect()} == want == {x for x in kmers(3) if DIST["edit"](x, "AAA") > 2 and DIST["edit"](x, "CCC") > 2}


@pytest.mark.parametrize("metric", ["edit", "hamming"])
@pytest.mark.parametrize("k,d", [(20, 5), (30, 10)])
def test_long_kmers_equal_sequential_greedy(spark, metric, k, d):
    """Families of k-mers a few edits from each other, over the advertised domain."""
    rng = random.Random(k)
    names = set()
    for _ in range(20):
        base = [rng.choice("ACGT") for _ in range(k)]
        for _ in range(6):
            x = list(base)
            for _ in range(rng.randint(0, d)):
                x[rng.randrange(k)] = rng.choice("ACGT")
            if rng.random() < 0.5:
                x.insert(rng.randrange(k), x.pop(rng.randrange(k)))
            names.add("".join(x))
    names = sorted(names)
    u = spark.createDataFrame([(x,) for x in names], "kmer string").select(encode(F.col("kmer")).alias("enc"), "kmer")
    want = greedy(names, d, metric)
    for method in ("simple", "improved"):
        mis = cut(find_mis(u, k, d, metric, method), "mis")
        assert listed(mis) == want
    assert dependent_pairs(mis, k, d, metric).isEmpty() and uncovered(u, mis, k, d, metric).isEmpty()


def test_rounds_equal_the_walk(spark, monkeypatch):
    rng = random.Random(4)
    names = sorted(rng.sample(kmers(4), 120))
    u = spark.createDataFrame([(x,) for x in names], "kmer string").select(encode(F.col("kmer")).alias("enc"), "kmer")
    for few in (0, 40, 10**6):
        monkeypatch.setattr(rootset, "FEW", few)
        assert listed(find_mis(u, 4, 2, "edit", "improved")) == greedy(names, 2, "edit")


@pytest.mark.parametrize("method", METHODS)
def test_null_and_foreign_kmers_are_left_out(spark, method):
    rows = [("AAA", 0), ("TTT", 63), (None, None), ("ANA", None), ("AAAA", 0), ("", 0), ("ttt", 63), ("AAA", 7), ("TTT", None)]
    u = spark.createDataFrame([(e, x, 1) for x, e in rows], "enc long, kmer string, rank int")
    assert listed(find_mis(u, 3, 1, "edit", method)) == ["AAA", "TTT"]


def test_empty_universe_and_bad_arguments(spark):
    none = full_universe(spark, 3).limit(0)
    for method in METHODS:
        assert find_mis(none, 3, 1, method=method).isEmpty()
    with pytest.raises(ValueError):
        find_mis(spark, 3, 1, metric="other")
    with pytest.raises(ValueError):
        find_mis(spark, 3, 3)


def test_report(spark):
    out = []
    with measured(spark, out):
        sum(i * i for i in range(3_000_000))
        spark.range(3).repartition(2).count()
    got = {(r.process, r.metric): r.value for r in out[0].collect()}
    each = {"time in user mode", "time in kernel mode", "peak virtual memory size", "peak resident set size"}
    assert got.keys() == {(p, m) for p in ("python", "jvm") for m in each} | {("all", "wall time"), ("executors", "task time"), ("executors", "garbage collection")}
    assert got["python", "time in user mode"] > 0.05 and min(got.values()) >= 0
    assert all(got[p, "peak virtual memory size"] >= got[p, "peak resident set size"] > 10_000 for p in ("python", "jvm"))


def test_scratch_is_cleared(spark, monkeypatch):
    monkeypatch.setattr(session, "_made", [])
    assert cut(spark.range(5), "x").count() == 5
    (path,) = [Path(x.removeprefix("file://")) for x in session._made]
    assert path.is_dir() and session.clear_scratch(spark) == 1 and not path.exists() and session.clear_scratch(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://far:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(far)


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "get_spark", lambda: spark)
    assert cli.main(["-k", "2", "-d", "1"]) == 0
    said = capsys.readouterr().err
    assert "AA\nCC\nGG\nTT" in said and "independent set of size 4." in said
    assert cli.main(["-k", "2", "-d", "1", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 4
