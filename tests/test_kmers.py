import itertools
import random

import pytest
from pyspark.sql import functions as F

from merset.functions.kmers import check_domain, code_of, decode, deletions, distance, encode, insertions, is_kmer, lower_bound, profile, substitutions, upper_bound, vertex, within
from merset.operators.ball import balls
from merset.operators.conflict import conflicts, piece_keys, sharing
from merset.operators.neighbors import unit_edges
from merset.operators.orders import ranked
from merset.sources.universe import SEGMENT, full_universe, kmer_counts, kmers_of


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def ham(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


DIST = {"edit": edit, "hamming": ham}


def kmers(k):
    return ["".join(x) for x in itertools.product("ACGT", repeat=k)]


def test_encode_decode(spark):
    rows = spark.createDataFrame([("AAAA", 0), ("ACGT", 27), ("TTTT", 255)], "kmer string, enc long")
    for r in rows.select("*", encode(F.col("kmer")).alias("e"), decode(F.col("enc"), 4).alias("s")).collect():
        assert r.e == r.enc and r.s == r.kmer


def test_k30_round_trip(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(20)] + ["T" * 30]
    rows = spark.createDataFrame([(w,) for w in words], "kmer string").withColumn("enc", encode(F.col("kmer")))
    got = rows.select("kmer", decode(F.col("enc"), 30).alias("s"), decode(code_of(vertex(F.col("enc"))), 30).alias("v")).collect()
    assert all(r.kmer == r.s == r.v for r in got)


def test_full_universe_is_alphabetical(spark):
    assert [r.kmer for r in full_universe(spark, 3).orderBy("enc").collect()] == kmers(3)


@pytest.mark.parametrize("k,d", [(1, None), (31, None), (4, 0), (4, 4)])
def test_domain(k, d):
    with pytest.raises(ValueError):
        check_domain(k, d)


def test_distances_bounds_and_threshold(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("ACGT") for _ in range(6)), "".join(rng.choice("ACGT") for _ in range(6))) for _ in range(300)] + [("ACGTAA", "CGTAAA"), ("AAAAAA", "AAAAAA")]
    rows = spark.createDataFrame(pairs, "x string, y string")
    side = lambda c: F.struct(encode(F.col(c)).alias("enc"), F.col(c).alias("kmer"), *[v.alias(n) for n, v in profile(F.col(c), 6).items()])
    rows = rows.select("x", "y", side("x").alias("a"), side("y").alias("b"))
    for r in rows.select("x", "y", *[distance(m, "a", "b").alias(m) for m in DIST], *[within(m, 3, "a", "b").alias(f"{m}3") for m in DIST], lower_bound("a", "b").alias("lo"), upper_bound("a", "b").alias("hi")).collect():
        e, h = edit(r.x, r.y), ham(r.x, r.y)
        assert (r.edit, r.hamming, r.edit3, r.hamming3) == (e, h, e <= 3, h <= 3)
        assert r.lo <= e <= h and h <= 6 and e <= r.hi and h <= r.hi


def test_profile(spark):
    row = spark.createDataFrame([("ACGA",)], "kmer string").select(*[v.alias(n) for n, v in profile(F.col("kmer"), 4).items()]).first()
    assert tuple(row) == (2, 3, 3, 4)


def test_edits(spark):
    rows = spark.createDataFrame([("AAAA",), ("ACGT",), ("GGTC",)], "kmer string").withColumn("enc", encode(F.col("kmer")))
    spell = lambda col, k: F.transform(col, lambda x: decode(x, k))
    for r in rows.select("kmer", spell(substitutions(F.col("enc"), 4), 4).alias("s"), spell(deletions(F.col("enc"), 4), 3).alias("d"), spell(insertions(F.col("enc"), 5), 5).alias("i")).collect():
        w = r.kmer
        assert sorted(r.s) == sorted(v for v in kmers(4) if ham(v, w) == 1)
        assert sorted(r.d) == sorted({w[:j] + w[j + 1 :] for j in range(4)})
        assert sorted(r.i) == sorted({w[:j] + x + w[j:] for j in range(5) for x in "ACGT"}) and len(r.i) == 16


def test_unit_edges_are_symmetric_and_counted(spark):
    five = full_universe(spark, 5).select(vertex(F.col("enc")).alias("vid"))
    four = full_universe(spark, 4).select(vertex(F.col("enc"), False).alias("vid"))
    edges = unit_edges(five.unionByName(four), 5, "edit").cache()
    assert edges.count() == edges.distinct().count() == 23552
    assert edges.exceptAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).isEmpty()
    assert edges.where(is_kmer(F.col("src")) & is_kmer(F.col("dst"))).count() == 1024 * 15


@pytest.mark.parametrize("metric", ["edit", "hamming"])
@pytest.mark.parametrize("d", [1, 2, 3])
def test_balls_and_conflicts_agree_with_brute_force(spark, metric, d):
    u = full_universe(spark, 4).where("enc % 7 <> 3").cache()
    names = [r.kmer for r in u.collect()]
    want = {(a, b) for a in names for b in names if a != b and DIST[metric](a, b) <= d}
    spell = lambda df: {(r.a, r.b) for r in df.select(decode(F.col("a"), 4).alias("a"), decode(F.col("b"), 4).alias("b")).collect()}
    for bounds in (True, False):
        pairs = conflicts(u, 4, d, metric, bounds)
        assert spell(pairs) == want and pairs.count() == len(want)
    every = {(r.a, r.b): r.dist for r in balls(u, 4, d, metric).select(decode(F.col("src"), 4).alias("a"), decode(F.col("dst"), 4).alias("b"), "dist").collect()}
    assert every == {(a, b): DIST[metric](a, b) for a in names for b in kmers(4) if DIST[metric](a, b) <= d}


def test_conflicts_join_few_pairs(spark):
    """Pieces are joined by equality, and of k-mers of 10 bases few pairs share one."""
    rng = random.Random(2)
    names = sorted({"".join(rng.choice("ACGT") for _ in range(10)) for _ in range(1500)})
    u = spark.createDataFrame([(x,) for x in names], "kmer string").select(encode(F.col("kmer")).alias("enc"), "kmer")
    for metric in DIST:
        pairs = sharing(u, u, 10, 2, metric)
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert pairs.count() < 0.05 * len(names) ** 2


@pytest.mark.parametrize("k,d", [(7, 3), (9, 4), (12, 5), (30, 10)])
def test_pieces_miss_no_pair(k, d):
    """Strings with up to d random edits share a piece, and there are few keys."""
    rng = random.Random(k)
    keys = {m: piece_keys(k, d, m) for m in DIST}
    assert len(keys["hamming"]) == d + 1 and len(keys["edit"]) <= (d + 1) * (d + 2) // 2
    for _ in range(1500):
        a = "".join(rng.choice("AC") for _ in range(k))
        b = list(a)
        for _ in range(rng.randint(0, d // 2)):
            del b[rng.randrange(len(b))]
        while len(b) < k:
            b.insert(rng.randint(0, len(b)), rng.choice("AC"))
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(k)] = rng.choice("ACGT")
        b = "".join(b)
        for m, dist in DIST.items():
            if dist(a, b) <= d:
                assert any(a[x : x + n] == b[y : y + n] for x, y, n in keys[m])


def test_foreign_strings_have_no_code(spark):
    rows = spark.createDataFrame([(None,), ("",), ("ACN",), ("acg",), ("A" * 31,), ("ACG",)], "kmer string")
    assert [r.e for r in rows.select(encode(F.col("kmer")).alias("e")).collect()] == [None] * 5 + [6]


def test_kmer_counts(spark):
    long = "ACGTTGCA" * (SEGMENT // 4) + "GATTACA"
    texts = [None, "", "acg", "ac-g t", "nnnACGTnnn", long, long, "é" * 5 + "TTTT"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "n long, text string, kmer string")
    want = {}
    for t in texts:
        s = "".join(c for c in (t or "").upper() if c in "ACGT")
        for i in range(len(s) - 3):
            want[s[i : i + 4]] = want.get(s[i : i + 4], 0) + 1
    assert {r.kmer: r.n for r in kmer_counts(rows, 4).collect()} == want
    assert {r.kmer for r in kmers_of(rows, 4, min_count=3).collect()} == {w for w, n in want.items() if n >= 3}
    assert kmer_counts(rows.limit(0), 4).isEmpty()


def test_orders_are_bijections(spark):
    u = full_universe(spark, 5)
    for order in ("lex", "affine", "random"):
        r = ranked(u, 5, order, seed=4)
        assert r.select("rank").distinct().count() == 1024
    first = ranked(u, 5, "random", 1, pin_first=True).orderBy("rank").first()
    assert first.kmer == "AAAAA"
    with pytest.raises(ValueError):
        ranked(u, 5, "other")
