"""Maximal independent sets of k-mers: pairwise further apart than d, and not to be enlarged.

Three methods give the same set for the same order; they differ in how
conflicts are found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merset.functions.kmers import check_domain, code_of, encode, is_kmer, substitutions, vertex, within
from merset.operators.ball import balls
from merset.operators.conflict import conflicts, first_covers, near_pairs
from merset.operators.neighbors import vid_neighbors
from merset.operators.orders import placed, ranked
from merset.operators.reach import compacted, nearer, reach_within
from merset.operators.rootset import greedy_roots
from merset.session import built_once, cut
from merset.sources.universe import full_universe

METRICS, METHODS, ORDERS = ("edit", "hamming"), ("simple", "improved", "bfs"), ("lex", "affine", "random")
#: Members that the simple method compares with every candidate, by broadcast; beyond, they meet by a join on pieces.
MOST_BROADCAST = 1_000
#: Vertices of the order's first chunk; and how many times as many the chunks up to the next one have together.
FIRST = 128
GROWTH = 8
#: Survivors of a chunk among which conflicts are searched first; and rows that such a search is meant to find at most, or MOST_A_MEMBER for each member so far if that is more.
PART = 256
MOST_STATE, MOST_A_MEMBER = 50_000, 16
#: Up to so many vertices are counted off by a sort of the first ones in each task, more by a sketch.
COUNTED = 100_000


def not_covered(candidates: DataFrame, members: DataFrame, k: int, d: int, metric: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Candidates (enc, kmer, all columns) further than d from all members: an anti join that stops at the first match. A null kmer is near nothing, so it stays; sizes: of both sides, if known."""
    if (sizes[1] if sizes else members.count()) <= MOST_BROADCAST:
        return candidates.alias("c").join(F.broadcast(members.select("enc", "kmer")).alias("m"), within(metric, d, "c", "m"), "left_anti")
    near = near_pairs(candidates.select("enc", "kmer"), members.select("enc", "kmer"), k, d, metric, sizes=sizes).select("a.enc").unionByName(members.select("enc")).distinct()
    return candidates.join(near, "enc", "left_anti")


def _chunks(vertices: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """Parts of the order and their sizes, one after the other; each is GROWTH - 1 times as large as all before.

    The first is small, since only its conflicts are found before any member
    is known; of the later ones most vertices are covered by then.
    """
    ends = [FIRST * GROWTH**j for j in range(60) if FIRST * GROWTH**j <= 4**30]
    chunk = reduce(lambda c, end: c + (F.col("_place") > end).cast("int"), ends, F.lit(0))
    dealt = cut(placed(vertices, "_place").withColumn("chunk", chunk), "mis-chunks")
    n = dealt.count()
    for i, (before, end) in enumerate(zip([0, *ends], [*ends, n], strict=True)):
        if before < n:
            yield dealt.where(F.col("chunk") == i).drop("chunk"), min(end, n) - before


def _first(queue: DataFrame, n: int, size: int) -> int:
    """The place up to which ``queue`` (n rows) has about ``size`` vertices; exactly, up to COUNTED."""
    if size <= COUNTED:
        return queue.select("_place").orderBy("_place").limit(size).agg(F.max("_place")).first()[0]
    return int(queue.approxQuantile("_place", [size / n], size / n / 10)[0])


#: What keeps the rows of the first argument that no member in the second is near, given both sizes.
Without = Callable[[DataFrame, DataFrame, tuple[int, int]], DataFrame]


def _in_parts(queue: DataFrame, n: int, n_members: int, conflicting: Callable[[DataFrame, int], DataFrame], without: Without, told: list[int] | None) -> tuple[list[DataFrame], int]:
    """Members among ``queue`` (n rows of enc, kmer, rank, _place), part by part of the order, and how many members there are then.

    What a part's members cover leaves the queue before conflicts of the next
    part are searched. So where members cover much, few conflicts are ever
    found; and where they cover little, parts grow with the members there are.
    """
    size, members = PART, []
    while n:
        end = None if n <= size else _first(queue, n, size)
        part = queue if end is None else queue.where(F.col("_place") <= end)
        states: list[int] = []
        found = cut(greedy_roots(part, conflicting(part, min(n, size)), states).join(part, "enc"), "mis-members")
        members.append(found)
        new = found.count()
        n_members += new
        if told is not None:
            told += states
        if end is None:
            break
        queue = cut(without(queue.where(F.col("_place") > end), found, (n - size, new)), "mis-queue")
        n = queue.count()
        most = max(MOST_STATE, MOST_A_MEMBER * n_members)
        size = int(min(8.0, (most / states[0]) ** 0.5) * size) if states[0] < most else max(64, size // 2)
    return members, n_members


def _simple(vertices: DataFrame, k: int, d: int, metric: str, told: list[int] | None = None) -> DataFrame:
    """Chunks of the order against the members so far, then greedy rounds among parts of each chunk's survivors. told: gets the rows of every round's state."""
    members: list[DataFrame] = []
    n_members = 0
    without = lambda rest, found, sizes: not_covered(rest, found, k, d, metric, sizes)
    for part, n in _chunks(vertices):
        if members:
            part = cut(without(part, reduce(DataFrame.unionByName, members), (n, n_members)), "mis-survivors")
            n = part.count()
        found, n_members = _in_parts(part, n, n_members, lambda rows, _: conflicts(rows, k, d, metric, bounds=False), without, told)
        members += found
    return reduce(DataFrame.unionByName, members) if members else vertices


def _improved(vertices: DataFrame, k: int, d: int, metric: str, told: list[int] | None = None) -> DataFrame:
    """As the simple method, with less to compare: neighbours' covers first, then bounds.

    A chunk's k-mers are first tried against the members that cover one of
    their substitution neighbours; what is left meets the members by the
    bounds, and its first cover is kept for the chunks after it; what is still left goes
    through greedy rounds. Only conflicts among survivors are ever stored.
    """
    members: list[DataFrame] = []
    known: list[DataFrame] = []
    n_members = 0

    def without(rest: DataFrame, found: DataFrame, sizes: tuple[int, int]) -> DataFrame:
        covers = cut(first_covers(rest, found.select("enc", "kmer", F.col("rank").alias("place")), k, d, metric, sizes).select("enc", "cover", "cover_kmer"), "mis-covers")
        known.append(covers)
        return rest.join(covers, "enc", "left_anti")

    for part, n in _chunks(vertices):
        if members:
            taken = cut(reduce(DataFrame.unionByName, members), "mis-members")
            heard = cut(cover_from_neighbors(part, reduce(DataFrame.unionByName, known), k, d, metric).join(taken.select(F.col("enc").alias("cover"), F.col("kmer").alias("cover_kmer")), "cover").select("enc", "cover", "cover_kmer"), "mis-heard")
            known.append(heard)
            part = cut(without(part.join(heard, "enc", "left_anti"), taken, (n, n_members)), "mis-survivors")
            n = part.count()
        found, n_members = _in_parts(part, n, n_members, lambda rows, size: conflicts(rows, k, d, metric, size=size), without, told)
        members += found
        known += [m.select("enc", F.col("enc").alias("cover"), F.col("kmer").alias("cover_kmer")) for m in found]
    return reduce(DataFrame.unionByName, members) if members else vertices


def _spread_least(values: DataFrame, k: int, metric: str) -> DataFrame:
    """vid, least: the least value of a vertex and its unit neighbours; combined in each task before the shuffle."""
    ahead = values.select(F.explode(vid_neighbors(k, metric)).alias("vid"), "least")
    return values.unionByName(ahead).groupBy("vid").agg(F.min("least").alias("least"))


def _bfs(vertices: DataFrame, k: int, d: int, metric: str, told: list[dict[str, int]] | None = None) -> DataFrame:
    """Floods ranks d steps over unit edits: who hears nothing smaller is a root, and who hears a root is covered.

    No conflict is stored. Vertices outside the universe pass ranks on. How far
    the nearest member is persists over the rounds (``reach``): new members
    move on only where they are nearer than any before, and ranks only through
    vertices that can lie between two open ones. told: gets a round's open
    vertices and the rows that its new members reached.
    """
    vertices = cut(vertices, "mis-vertices")
    left = cut(vertices.select(vertex(F.col("enc")).alias("vid"), "rank"), "mis-left")
    found: list[DataFrame] = []
    reach: list[DataFrame] = []
    while not left.isEmpty():
        heard = left.select("vid", F.col("rank").alias("least"))
        for step in range(1, d + 1):
            heard = _spread_least(heard, k, metric)
            if reach:
                heard = heard.join(reach_within(reach, step), "vid", "left_anti")
        roots = cut(left.join(heard, "vid").where(F.col("rank") == F.col("least")).select("vid"), "mis-roots")
        found.append(roots)
        new = nearer(roots, reach, k, d, metric)
        if told is not None:
            told.append({"open": left.count(), "reached": sum(x.count() for x in new)})
        reach = compacted([*reach, *new])
        covered = reduce(DataFrame.unionByName, new).where(is_kmer(F.col("vid")))
        left = cut(left.join(covered, "vid", "left_anti"), "mis-left")
    return reduce(DataFrame.unionByName, found).select(code_of(F.col("vid")).alias("enc")).join(vertices, "enc") if found else vertices


def find_mis(universe: DataFrame | SparkSession, k: int, d: int, metric: str = "edit", method: str = "improved", order: str = "lex", seed: int = 0) -> DataFrame:
    """sel_idx, enc, kmer: the greedy maximal independent set, in order of selection.

    universe: k-mers to choose from (enc, kmer), or a session for all 4^k. The
    set depends on the universe and the order only. The improved method with
    edits and an order other than ``lex`` selects A...A first if it is there.

    Rows whose kmer is null, not of k letters, or has a letter other than A, C,
    G and T are left out; repeated rows count once; enc is made anew from kmer;
    other columns are not read. An empty universe gives no rows.
    """
    check_domain(k, d)
    if metric not in METRICS or method not in METHODS or order not in ORDERS:
        raise ValueError(f"metric, method and order must be among {METRICS}, {METHODS} and {ORDERS}")
    if isinstance(universe, SparkSession):
        universe = full_universe(universe, k)
    pin = order != "lex" and (metric, method) == ("edit", "improved")
    sound = universe.where(F.col("kmer").rlike(f"^[ACGT]{{{k}}}$")).select("kmer").distinct().select(encode(F.col("kmer")).alias("enc"), "kmer")
    vertices = ranked(sound, k, order, seed, pin)
    members = {"simple": _simple, "improved": _improved, "bfs": _bfs}[method](vertices, k, d, metric)
    return placed(members.select("enc", "kmer", "rank"), "sel_idx").select(F.col("sel_idx").cast("bigint").alias("sel_idx"), "enc", "kmer")


def assign(universe: DataFrame, mis: DataFrame, k: int, d: int, metric: str) -> DataFrame:
    """enc, cover, dist: for each k-mer the earliest selected member within d of it.

    Members flood their balls; k-mers pick by selection order. No distance of
    a pair is computed.
    """
    reached = balls(mis, k, d, metric).join(mis.select(F.col("enc").alias("src"), "sel_idx"), "src")
    best = reached.groupBy("dst").agg(F.min(F.struct("sel_idx", "src", "dist")).alias("best"))
    return universe.select("enc").join(best, F.col("enc") == F.col("dst")).select("enc", F.col("best.src").alias("cover"), F.col("best.dist").alias("dist"))


@built_once
def _self_and_swapped(k: int) -> Column:
    return F.concat(F.array("enc"), substitutions(F.col("enc"), k))


def cover_from_neighbors(candidates: DataFrame, assigned: DataFrame, k: int, d: int, metric: str) -> DataFrame:
    """enc, cover: candidates (enc, kmer) that lie within d of a member covering one of their substitution neighbours.

    assigned: enc, cover, cover_kmer of k-mers that have a cover. The lookup is
    an equi-join on generated neighbours; distinct covers are then verified.
    """
    asked = candidates.select(F.col("enc").alias("own"), F.col("kmer").alias("own_kmer"), F.explode(_self_and_swapped(k)).alias("enc"))
    told = asked.join(assigned, "enc").select("own", "own_kmer", "cover", "cover_kmer").distinct()
    sides = told.select(F.struct(F.col("own").alias("enc"), F.col("own_kmer").alias("kmer")).alias("a"), F.struct(F.col("cover").alias("enc"), F.col("cover_kmer").alias("kmer")).alias("b"))
    return sides.where(within(metric, d, "a", "b")).groupBy(F.col("a.enc").alias("enc")).agg(F.min("b.enc").alias("cover"))
