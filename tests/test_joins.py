"""The three joins that find pairs within d, the choice among them, pivots, and the kept distance table."""

import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F
from test_kmers import DIST, kmers
from test_mis import greedy, listed

from merset.functions.kmers import decode, encode, pivot_distances, vertex
from merset.operators import grid
from merset.operators.conflict import cheapest, conflicts, costs, first_covers, near_pairs, profiled, sharing
from merset.operators.grid import by_profile, cells_in_reach, grid_rates
from merset.operators.meeting import ball_size, flood, halves, meeting
from merset.operators.reach import compacted, nearer, reach_within
from merset.plans import methods
from merset.plans.methods import find_mis
from merset.session import cut
from merset.sources.universe import full_universe

WAYS = ("pieces", "meeting", "profiles")


def universe(spark, names):
    return cut(spark.createDataFrame([(x,) for x in names], "kmer string").select(encode(F.col("kmer")).alias("enc"), "kmer"), "u")


def some(k, n, seed, d):
    """k-mers in families, so that many are within d."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = [rng.choice("ACGT") for _ in range(k)]
        for _ in range(5):
            x = list(base)
            for _ in range(rng.randint(0, d)):
                x[rng.randrange(k)] = rng.choice("ACGT")
            if rng.random() < 0.5:
                x.insert(rng.randrange(k), x.pop(rng.randrange(k)))
            out.add("".join(x))
    return sorted(out)


@pytest.mark.parametrize("metric", ["edit", "hamming"])
@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("k,d", [(6, 5), (9, 4)])
def test_every_way_finds_all_pairs(spark, metric, way, k, d, monkeypatch):
    monkeypatch.setattr(grid, "BLOCK", 20)
    left, right = some(k, 50, 1, d), some(k, 40, 2, d)
    right = sorted({*right, *left[:10]})
    got = near_pairs(universe(spark, left), universe(spark, right), k, d, metric, way).select("a.kmer", F.col("b.kmer").alias("other")).collect()
    want = {(a, b) for a, b in product(left, right) if a != b and DIST[metric](a, b) <= d}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("metric", ["edit", "hamming"])
def test_meeting_tells_distances(spark, metric):
    u = full_universe(spark, 4)
    for d in (1, 2, 3):
        got = {(r.a, r.b): r.dist for r in meeting(u, u, 4, d, metric).select(decode(F.col("a"), 4).alias("a"), decode(F.col("b"), 4).alias("b"), "dist").collect()}
        assert got == {(a, b): DIST[metric](a, b) for a, b in product(kmers(4), repeat=2) if a != b and DIST[metric](a, b) <= d}


def test_walks_stay_in_their_task(spark):
    """Dealt by enc once; steps and repeats need no further shuffle, and null or repeated codes no rows."""
    rows = spark.createDataFrame([(27,), (27,), (None,)], "enc long")
    walked = flood(rows, 4, 2, "edit")
    assert walked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = walked.collect()
    assert {r.enc for r in got} == {27} and len(got) == len({r.vid for r in got})
    near = {r.vid >> 2: r.dist for r in got if r.vid & 3 == 1}
    assert near == {e: DIST["edit"]("ACGT", x) for e, x in enumerate(kmers(4)) if DIST["edit"]("ACGT", x) <= 2}


def test_only_near_pairs_meet(spark):
    """At (9, 4), where pieces have one base, pieces bring most pairs together and meeting none that is not near."""
    names = random.Random(5).sample(["".join(x) for x in product("ACGT", repeat=9)], 150)
    u = universe(spark, names)
    every = len(names) * (len(names) - 1)
    for metric in DIST:
        near = sum(2 for a, b in combinations(names, 2) if DIST[metric](a, b) <= 4)
        assert meeting(u, u, 9, 4, metric).count() == near < 0.12 * every
        assert sharing(u, u, 9, 4, metric).count() > 0.3 * every


def test_profiles_reject_before_pairs_are_formed(spark):
    """Cells at (10, 2): all near pairs meet, a good part of the others does not, about as many as is expected."""
    names = random.Random(6).sample(["".join(x) for x in product("ACGT", repeat=10)], 300)
    u = cut(profiled(universe(spark, names), 10), "u")
    looks, meets = grid_rates(10, 2)
    cells = u.select(F.size(cells_in_reach(10, 2)).alias("n")).agg(F.avg("n")).first()[0]
    assert abs(cells - looks) < 0.1 * looks
    right = u.withColumn("cell", grid.cell(2))
    formed = u.select("enc", F.explode(cells_in_reach(10, 2)).alias("cell")).join(right.select("cell"), "cell").count()
    assert abs(formed / 300**2 - meets) < 0.1 * meets < 0.08
    kept = {(r.a, r.b) for r in by_profile(u, u, 10, 2).select("a.kmer", F.col("b.kmer").alias("other")).toDF("a", "b").collect()}
    assert kept == {(a, b) for a, b in product(names, repeat=2) if a != b and max(abs(a.count(x) - b.count(x)) for x in "ACGT") <= 2}


@pytest.mark.parametrize("metric", ["edit", "hamming"])
def test_pivots_leave_fewer_distances_open(spark, metric):
    k, d = 8, 2
    names = some(k, 120, 9, 3)
    u = universe(spark, names)
    pivots = tuple(names[::40])
    pairs = [(a, b) for a, b in product(names, repeat=2) if a != b]
    near = {p for p in pairs if DIST[metric](*p) <= d}
    assert {tuple(r) for r in near_pairs(u, u, k, d, metric, "pieces", pivots).select("a.kmer", F.col("b.kmer").alias("o")).collect()} == near

    def open_(refs):
        bounds = [([abs(DIST[metric](a, r) - DIST[metric](b, r)) for r in refs], [DIST[metric](a, r) + DIST[metric](b, r) for r in refs]) for a, b in pairs]
        return sum(max(low) <= d < min(high) for low, high in bounds)

    homopolymers = [x * k for x in "ACGT"]
    assert open_([*homopolymers, *pivots]) < 0.75 * open_(homopolymers)
    told = u.withColumns(pivot_distances(metric, pivots)).collect()
    assert all([r[f"p{i}"] for i in range(len(pivots))] == [DIST[metric](r.kmer, p) for p in pivots] for r in told)


@pytest.mark.parametrize("metric", ["edit", "hamming"])
def test_expected_rows_and_the_choice(spark, metric):
    for k, steps in ((4, 1), (6, 2), (9, 2)):
        walked = flood(universe(spark, random.Random(k).sample(["".join(x) for x in product("ACGT", repeat=k)], 20)), k, steps, metric).count() / 20
        assert abs(walked - ball_size(k, steps, metric)) < 0.15 * walked
    assert halves(5) == (3, 2)
    for k, d in ((9, 4), (12, 5), (20, 10), (30, 15)):
        assert costs(k, d, metric)["profiles"][2] <= 1
        assert cheapest(k, d, metric, 400, 400) in ("profiles", "pieces")
    assert cheapest(20, 10, metric, 10**6, 10**6) == "profiles"  # pieces would form over one row a pair, balls are huge
    assert cheapest(30, 2, metric, 10**9, 10**7) == "pieces" and cheapest(10, 2, metric, 10**9, 10**7) == "meeting"


@pytest.mark.parametrize("metric", ["edit", "hamming"])
def test_far_apart_members_of_long_kmers(spark, metric):
    """(20, 10): neither pieces nor balls help; the selection still equals sequential greedy."""
    names = some(20, 120, 3, 8)
    u = universe(spark, names)
    for method in ("simple", "improved"):
        assert listed(find_mis(u, 20, 10, metric, method)) == greedy(names, 10, metric)


@pytest.mark.parametrize("metric", ["edit", "hamming"])
def test_first_covers(spark, metric):
    names = some(7, 90, 4, 3)
    members = random.Random(1).sample(names, 12)
    u, m = universe(spark, names), universe(spark, members).withColumn("place", F.col("enc") % 97)
    place = {r.kmer: (r.place, r.enc) for r in m.collect()}
    got = {r.enc: (r.cover_kmer, r.dist) for r in first_covers(u, m, 7, 3, metric).collect()}
    for r in u.collect():
        best = min((m for m in members if DIST[metric](r.kmer, m) <= 3), key=place.get, default=None)
        assert got.get(r.enc) == (None if best is None else (best, DIST[metric](r.kmer, best)))


@pytest.mark.parametrize("metric", ["edit", "hamming"])
def test_kept_distances(spark, metric):
    """A later member moves on only where it is nearer; the least row of a vertex is its distance to all members."""
    parts, moved = [], []
    members = ["AAAA", "ACGT", "AAAC", "TTTT"]
    for m in members:
        one = universe(spark, [m]).select(vertex(F.col("enc")).alias("vid"))
        new = nearer(one, parts, 4, 2, metric)
        moved.append(sum(x.count() for x in new))
        parts += new
    rows = {}
    for p in parts:
        for r in p.collect():
            rows.setdefault(r.vid, []).append(r.dist)
    (one,) = compacted(parts, 3)
    assert compacted(parts) == parts and {r.vid: r.dist for r in one.collect()} == {v: min(x) for v, x in rows.items()} and one.count() == len(rows)
    assert all(len(set(v)) == len(v) and v == sorted(v, reverse=True) for v in rows.values())
    for e, x in enumerate(kmers(4)):
        want = min(DIST[metric](x, m) for m in members)
        assert min(rows.get(4 * e + 1, [9])) == (want if want <= 2 else 9)
    assert moved[2] < moved[0]  # next to the first one, most is as near already
    assert reach_within(parts, 0).distinct().count() == len(members)


def test_bfs_floods_less_as_more_is_decided(spark):
    metric, names = "hamming", kmers(4)
    u = universe(spark, names).withColumn("rank", F.struct(F.lit(0).alias("pin"), F.col("enc").alias("at"), "enc"))
    told = []
    got = methods._bfs(u, 4, 2, metric, told)
    assert sorted(r.kmer for r in got.select("kmer").collect()) == greedy(names, 2, metric)
    opened = [t["open"] for t in told]
    assert opened == sorted(opened, reverse=True) and len(set(opened)) == len(opened)
    assert told[-1]["reached"] < told[0]["reached"]
    assert sum(t["reached"] for t in told) < 2 * (256 + 64)  # a flood from every member anew would reach far more
    assert {(r.a, r.b) for r in conflicts(got, 4, 2, metric).collect()} == set()
