"""Conflicts: pairs of k-mers within distance d, by one of three equi-joins, each of them exact.

**Pieces**, for d small beside k. Cut a k-mer into d + 1 pieces. If another of the same length is within d
substitutions, it has one of the pieces at the same place; within d edits, it
has one of them moved by few places, and the i-th piece by min(i, d - i) at
most (Li, Deng, Wang and Feng, Pass-Join, 2011). So a k-mer has at most
(d + 1) (d + 2) / 2 keys, whatever k is, and a piece of k / (d + 1) bases is rare
unless d is above k / 3. A pair is taken where its first equal piece is, so no
duplicates have to be removed.

**Meeting** in the middle (``meeting``), for larger d: only pairs within d are ever formed, at the cost of a ball of half the radius a row.

**Profiles** (``grid``), for few rows, or d so large that hardly a pair is far: pairs that the profiles don't reject.

Which is expected to take the fewest rows follows from k, d and both sides'
sizes (``cheapest``). The distance of a pair is worked out only where the bounds of profiles
and pivots leave it open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merset.functions.kmers import distance, lower_bound, pivot_distances, profile, upper_bound, within
from merset.operators.grid import by_profile, grid_rates
from merset.operators.meeting import ball_size, halves, meeting
from merset.session import built_once, partitions


def profiled(universe: DataFrame, k: int) -> DataFrame:
    """The universe with da, dc, dg and dt."""
    return universe.withColumns(_profile(k))


@built_once
def _profile(k: int) -> dict[str, Column]:
    return profile(F.col("kmer"), k)


def costs(k: int, d: int, metric: str) -> dict[str, tuple[float, float, float]]:
    """way: (rows that a left k-mer becomes, rows that a right one becomes, rows a pair that are joined), over uniform k-mers."""
    keys = piece_keys(k, d, metric)
    up, down = (ball_size(k, steps, metric) for steps in halves(d))
    looks, meets = grid_rates(k, d)
    vertices = 4**k + (4 ** (k - 1) if metric == "edit" else 0)
    return {"pieces": (len(keys), len(keys), sum(0.25**n for _, _, n in keys)), "meeting": (up, down, up * down / vertices), "profiles": (looks, 1.0, meets)}


def cheapest(k: int, d: int, metric: str, n_left: int, n_right: int) -> str:
    """The way that takes the fewest rows."""
    total = {way: n_left * l + n_right * r + n_left * n_right * both for way, (l, r, both) in costs(k, d, metric).items()}
    return min(total, key=lambda way: total[way])


def pieces(k: int, d: int) -> list[tuple[int, int]]:
    """(start, length) of d + 1 pieces; the longer ones in the middle, which are looked for at the most places."""
    size, more = divmod(k, d + 1)
    middle = sorted(range(d + 1), key=lambda i: (abs(2 * i - d), i))[:more]
    lengths = [size + (i in middle) for i in range(d + 1)]
    return [(sum(lengths[:i]), n) for i, n in enumerate(lengths)]


def piece_keys(k: int, d: int, metric: str) -> list[tuple[int, int, int]]:
    """(start in one k-mer, start in the other, length) of each piece and move."""
    out = []
    for i, (start, n) in enumerate(pieces(k, d)):
        most = min(i, d - i) if metric == "edit" else 0
        out += [(start, start + move, n) for move in range(-most, most + 1) if 0 <= start + move <= k - n]
    return out


@built_once
def _parts(k: int, d: int, metric: str, side: int) -> Column:
    """A k-mer's pieces, at their places in one side or the other."""
    return F.posexplode(F.array(*[F.substring("kmer", key[side] + 1, key[2]) for key in piece_keys(k, d, metric)])).alias("at", "piece")


@built_once
def _first_equal(k: int, d: int, metric: str) -> Column:
    """Whether a pair of sides a and b meets on the first piece that they share."""
    equal = F.array(*[F.substring("a.kmer", x + 1, n) == F.substring("b.kmer", y + 1, n) for x, y, n in piece_keys(k, d, metric)])
    return F.array_position(equal, True) == F.col("a.at") + 1


def sharing(left: DataFrame, right: DataFrame, k: int, d: int, metric: str) -> DataFrame:
    """a, b (structs of each side's columns) of the pairs that share a piece, each once; among them all within d. Sides have enc and kmer; a k-mer is not paired with itself.

    The pairs are the work here and the rows are few, so the left side is dealt
    over all tasks first: partitions sized by their bytes would be one or two.
    """
    left = left.repartition(partitions(left.sparkSession), "enc")
    a, b = left.select("*", _parts(k, d, metric, 0)).alias("a"), right.select("*", _parts(k, d, metric, 1)).alias("b")
    joined = a.join(b, (F.col("a.at") == F.col("b.at")) & (F.col("a.piece") == F.col("b.piece")) & (F.col("a.enc") != F.col("b.enc")))
    side = lambda x, rows: F.struct(*[F.col(f"{x}.{c}").alias(c) for c in rows.columns]).alias(x)
    return joined.where(_first_equal(k, d, metric)).select(side("a", left), side("b", right))


def near_pairs(left: DataFrame, right: DataFrame, k: int, d: int, metric: str, way: str | None = None, pivots: tuple[str, ...] = (), sizes: tuple[int, int] | None = None) -> DataFrame:
    """a, b (structs of each side's columns) of the pairs within d, each once; a k-mer is not paired with itself.

    Sides have enc and kmer. The way follows from their sizes; if these are not
    given either, the sides are counted, so they should be cheap to read.
    Bounds reject, bounds accept, and the distance decides the rest. pivots: k-mers whose
    distances to both sides are worked out once a row and bound those of pairs, as the
    four of one base do.
    """
    way = way or cheapest(k, d, metric, *(sizes or (left.count(), right.count())))
    if way == "meeting":
        sides = [rows.select(F.col("enc").alias(x), F.struct(*rows.columns).alias(f"{x}_")) for x, rows in (("a", left), ("b", right))]
        return meeting(left, right, k, d, metric).join(sides[0], "a").join(sides[1], "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    sides = [profiled(rows, k).withColumns(pivot_distances(metric, pivots)) for rows in (left, right)]
    pairs = by_profile(*sides, k, d) if way == "profiles" else sharing(*sides, k, d, metric)
    more = len(pivots)
    return pairs.where(F.when(lower_bound("a", "b", more) > d, False).when(upper_bound("a", "b", more) <= d, True).otherwise(within(metric, d, "a", "b")))


def conflicts(universe: DataFrame, k: int, d: int, metric: str, bounds: bool = True, size: int | None = None) -> DataFrame:
    """a, b (enc) of ordered pairs within d, and where the universe has a rank, b's as ``rank``, of the pairs whose a comes first.

    With bounds, by the cheapest way, and distances are worked out only where
    they leave it open; otherwise by pieces. size: that of the universe, if known.
    """
    ranks = ["rank"] if "rank" in universe.columns else []
    rows = universe.select("enc", "kmer", *ranks)
    pairs = near_pairs(rows, rows, k, d, metric, sizes=None if size is None else (size, size)) if bounds else sharing(rows, rows, k, d, metric).where(within(metric, d, "a", "b"))
    if ranks:
        return pairs.where("a.rank < b.rank").select(F.col("a.enc").alias("a"), F.col("b.enc").alias("b"), F.col("b.rank").alias("rank"))
    return pairs.select(F.col("a.enc").alias("a"), F.col("b.enc").alias("b"))


def first_covers(candidates: DataFrame, members: DataFrame, k: int, d: int, metric: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    """enc, cover, cover_kmer, dist: for each candidate (enc, kmer) within d of a member (enc, kmer, place), the member of the lowest place; a member covers itself."""
    found = near_pairs(candidates.select("enc", "kmer"), members.select("enc", "kmer", "place"), k, d, metric, sizes=sizes)
    of = F.struct(F.col("b.place").alias("place"), F.col("b.enc").alias("cover"), F.col("b.kmer").alias("cover_kmer"), distance(metric, "a", "b").cast("int").alias("dist"))
    own = candidates.select("enc").join(members.select("enc", "kmer", "place"), "enc").select("enc", F.struct("place", F.col("enc").alias("cover"), F.col("kmer").alias("cover_kmer"), F.lit(0).alias("dist")).alias("m"))
    return found.select(F.col("a.enc").alias("enc"), of.alias("m")).unionByName(own).groupBy("enc").agg(F.min("m").alias("m")).select("enc", "m.cover", "m.cover_kmer", "m.dist")
