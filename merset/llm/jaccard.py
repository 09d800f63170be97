"""N-gram Jaccard join: size-banded tiles with hashed bitmaps, bounded by bit counts before exact intersections.

Each set has a bitmap of the parities of its members' hashes, about two bits a
member. Two bitmaps differ in at most as many bits as the sets do in members, so
their bit counts bound the overlap from above. Which bitmaps are compared:

1. A shingle order, the rarest first by hashed counts over all documents, is the
   same for every set; two linked sets share one of the first few members of it
   (prefix filter), which name the groups.
2. Every set of a group is compared with two members of it that a hash chooses.
   Most links of a group of copies follow from these, so components are made.
3. What is in a group but in several components is dealt into tiles: pairs of
   blocks of one size band and the next. A tile compares its bitmaps, and then,
   on sorted arrays, what passed. So a group of copies emits no pairs, and
   no group, band or block is too large for a task.

Any order and any counts give the same links: nothing is left out at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merset.llm.common import flat
from merset.llm.components import components
from merset.llm.neardup import _confirm, _settle, _Words, shingle_sets, shingles
from merset.session import cut, partitions, spread

#: Hashed counts of shingles, and the parts they are summed in. They order shingles and decide nothing.
COUNTERS, PARTS = 1 << 17, 32
#: Bits of the narrowest and widest bitmap.
NARROW, WIDEST = 128, 8192
#: Sets and shingles of a block, about; and the members that all of a group are first compared with.
BLOCK, WIDE, CENTRES = 1024, 1 << 20, 2


def signatures(docs: DataFrame, words: int, text: str) -> DataFrame:
    """doc_id, n_shingles, cls and row_key of each row; and, in rows of their own with a part, each task's hashed counts of shingles."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, ids = _Words(), np.zeros(COUNTERS, np.int64), None
        for batch in batches:
            raw, starts, ends = flat(batch.column(1))
            n, cls = [], []
            for a, b in zip(starts, ends, strict=True):
                s = shingles(raw[a:b].tobytes(), words, known)
                np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            ids, none = batch.column(0).type, pa.nulls(len(n))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), batch.column(2), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        if ids is not None:
            none = pa.nulls(PARTS)
            yield pa.record_batch([none.cast(ids), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(range(PARTS), pa.int32()), pa.array([c.tobytes() for c in np.split(counts, PARTS)], pa.binary())], names=names)

    names = ["doc_id", "n_shingles", "cls", "row_key", "part", "counts"]
    return spread(docs.select("doc_id", text, F.xxhash64("doc_id", text))).mapInArrow(run, f"doc_id {kind.simpleString()}, n_shingles long, cls binary, row_key long, part int, counts binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
    yield pa.record_batch({"part": pa.array(sums.keys(), pa.int32()), "counts": pa.array([c.tobytes() for c in sums.values()], pa.binary())})


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the members' hashes, in a power of two of bits, twice as many as members at least (up to WIDEST)."""
    width = min(max(NARROW, 1 << int(2 * len(s) - 1).bit_length()), WIDEST)
    return np.packbits(np.bincount((s >> np.uint64(40)).astype(np.int64) & (width - 1), minlength=width).astype(np.uint8) & 1).tobytes()


def prefixes(docs: DataFrame, counts: np.ndarray, words: int, percent: int, text: str) -> DataFrame:
    """cls, prefix (its rarest shingles, as many as a link must share one of) and bits, of the texts' sets; most repeats are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # COUNTERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, seen = _Words(), shared.value, set()
        for batch in batches:
            raw, starts, ends = flat(batch.column(0))
            out, firsts, bits = [], [], []
            for a, b in zip(starts, ends, strict=True):
                s = shingles(raw[a:b].tobytes(), words, known)
                cls = xxhash.xxh3_128_digest(s.tobytes())
                if not len(s) or cls in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(cls)
                often = counts[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]
                out.append(cls)
                firsts.append(s[np.lexsort((s, often))[: len(s) - -(-percent * len(s) // 100) + 1]].view(np.int64))
                bits.append(bitmap(s))
            at = np.cumsum([0, *map(len, firsts)])
            prefix = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([*firsts, np.zeros(0, np.int64)])))
            yield pa.record_batch([pa.array(out, pa.binary()), prefix, pa.array(bits, pa.binary())], names=["cls", "prefix", "bits"])

    return spread(docs.select(text)).mapInArrow(run, "cls binary, prefix array<bigint>, bits binary")


def band_of(n: Column, percent: int) -> Column:
    """The size band: two sizes that a link allows are in one band or in neighbouring ones."""
    ends = [1]
    while ends[-1] < 1 << 31:
        ends.append(max(ends[-1] * 100 // percent, ends[-1] * 9 // 8) + 1)
    bounds = F.array(*[F.lit(e).cast("long") for e in ends])
    return F.size(F.filter(bounds, lambda e: e <= n))


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) in ``width`` bits, as 64-bit words: parities of the parts add up."""
    parts = bits.reshape(len(bits), -1, width // 8)
    return np.ascontiguousarray(np.bitwise_xor.reduce(parts, axis=1)).view(np.uint64)


def _may_link(bits: pa.Array, n: np.ndarray, percent: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of left, j of right) whose sizes and bit counts allow a link, some rows of left at a time."""
    values = bits.to_pylist()
    width = np.array([8 * len(b) for b in values])
    by_width = {int(w): np.frombuffer(b"".join(values[i] for i in np.flatnonzero(width == w)), np.uint8).reshape(-1, int(w) // 8) for w in np.unique(width)}
    place = np.zeros(len(n), np.int64)
    for w in by_width:
        place[width == w] = np.arange((width == w).sum())
    for w, u in ((w, u) for w in by_width for u in by_width):
        i_of, j_of = left[width[left] == w], right[width[right] == u]
        if not len(i_of) or not len(j_of):
            continue
        least = min(w, u)
        a, b = _folded(by_width[w], least)[place[i_of]], _folded(by_width[u], least)[place[j_of]]
        step = max(1, (1 << 21) // (len(b) * b.shape[1]))
        for at in range(0, len(i_of), step):
            i = i_of[at : at + step]
            both = n[i][:, None] + n[j_of]
            close = 100 * np.minimum(n[i][:, None], n[j_of]) >= percent * np.maximum(n[i][:, None], n[j_of])
            apart = np.bitwise_count(a[at : at + step, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)
            x, y = np.nonzero(close & ((100 + percent) * (both - apart) >= 2 * percent * both))
            yield i[x], j_of[y]


def _bounded(percent: int):
    """Pairs (u, v, nu, nv, x, y: sizes and bitmaps) to those that may be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = np.zeros(len(batch), bool)
            x, y, nu, nv = batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("nu").to_numpy(), batch.column("nv").to_numpy()
            for k in range(len(batch)):
                least = 8 * min(len(x[k]), len(y[k]))
                apart = int(np.bitwise_count(_folded(np.frombuffer(x[k], np.uint8)[None], least) ^ _folded(np.frombuffer(y[k], np.uint8)[None], least)).sum())
                on[k] = (100 + percent) * (nu[k] + nv[k] - apart) >= 2 * percent * (nu[k] + nv[k])
            yield batch.select(["u", "v"]).filter(pa.array(on))

    return run


def _open(percent: int):
    """Tiles (members: cls, n, bits, root, far) to their members that may be linked with one in another component, one of the two far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, out, roots = [], [], []
            for tile, members in zip(batch.column("tile").to_pylist(), batch.column("members"), strict=True):
                m = members.values
                cls, root = m.field("cls").to_pylist(), m.field("root").to_pylist()
                part = np.unique(np.array(root, object), return_inverse=True)[1]
                far = m.field("far").to_numpy(zero_copy_only=False)
                on = np.zeros(len(cls), bool)
                for i, j in _may_link(m.field("bits"), m.field("n").to_numpy(), percent, np.flatnonzero(far), np.arange(len(cls))):
                    other = part[i] != part[j]
                    on[i[other]] = on[j[other]] = True
                for k in np.flatnonzero(on):
                    tiles.append(tile)
                    out.append(cls[k])
                    roots.append(root[k])
            yield pa.record_batch({"tile": pa.array(tiles, pa.int64()), "cls": pa.array(out, pa.binary()), "root": pa.array(roots, pa.binary())})

    return run


def _tiles(rows: DataFrame, percent: int) -> DataFrame:
    """tile, cid, root, far: the tiles of groups (token) with several components. rows: token, cid, n, size, total, root.

    far are the members outside the group's largest component; every pair to be
    compared has one. A group of a block's size is one tile. Larger ones are
    split by size band; each band's far members and all its members are dealt
    into blocks, and a tile is a block of far ones with a block of all of
    the same or a neighbouring band.
    """
    parts = rows.groupBy("token", "root").agg(F.count("*").alias("m"))
    main = parts.groupBy("token").agg(F.max(F.struct("m", "root")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("token", F.col("most.root").alias("main"))
    rows = cut(rows.join(main, "token").withColumn("far", F.col("root") != F.col("main")).withColumn("band", band_of(F.col("n"), percent)).drop("main"), "tile-rows")
    small = (F.col("size") <= BLOCK) & (F.col("total") <= WIDE)
    one = rows.where(small).select(F.xxhash64("token").alias("tile"), "cid", "root", "far")
    large = rows.where(~small)
    blocks = lambda c: F.ceil(F.greatest(F.sum(c.cast("long")) / F.lit(BLOCK), F.sum(F.when(c, F.col("n")).otherwise(0)) / F.lit(WIDE))).cast("int")
    sizes = cut(large.groupBy("token", "band").agg(blocks(F.col("far")).alias("far_blocks"), blocks(F.lit(True)).alias("all_blocks")), "tile-sizes")
    facing = sizes.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("other"), F.col("far_blocks").alias("fb"), F.col("all_blocks").alias("ab"))
    upto = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1))
    # a far member meets every block of all members of three bands; any member meets every block of far ones
    left = large.where("far").join(sizes.select("token", "band", "far_blocks"), ["token", "band"]).join(facing.select("token", "band", "other", "ab"), ["token", "band"])
    left = left.select("token", "band", "other", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("far_blocks")).alias("i"), upto("ab").alias("j"), "cid", "root", F.lit(True).alias("far"))
    right = large.join(sizes.select("token", "band", "all_blocks"), ["token", "band"]).join(facing.where("fb > 0").select("token", "band", "other", "fb"), ["token", "band"])
    right = right.select("token", F.col("other").alias("band"), F.col("band").alias("other"), upto("fb").alias("i"), F.pmod(F.xxhash64("cid", F.lit(2)), F.col("all_blocks")).alias("j"), "cid", "root", F.lit(False).alias("far"))
    dealt = left.unionByName(right).groupBy(F.xxhash64("token", "band", "other", "i", "j").alias("tile"), "cid").agg(F.first("root").alias("root"), F.bool_or("far").alias("far"))
    return one.unionByName(dealt)


def ngram_components(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row a row of ``docs``.

    Two texts are linked if 100 times the size of the intersection of their
    sets of ``words``-word shingles is at least ``percent`` times the union's;
    component_id is the smallest doc_id that links reach. Words are runs of
    anything but ASCII white space, A-Z lower-cased; a text with fewer words is
    one shingle; null and empty texts have none, are linked with nothing, and
    are their own component. Sets are of 64-bit hashes.

    Rows with the same doc_id but different texts are each linked by their own
    text. A null doc_id is never a component's id unless all of it is null.
    Repeated rows are all returned. Long texts are taken whole. An empty table
    gives an empty result. Other columns of docs are not read.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")
    spark = docs.sparkSession
    told = cut(signatures(docs, words, text), "ngram-signatures")
    rows = told.where("part IS NULL").drop("part", "counts")
    counts = np.zeros(COUNTERS, np.int64)
    for r in told.where("part IS NOT NULL").select("part", "counts").repartition(PARTS, "part").mapInArrow(_summed, "part int, counts binary").collect():
        counts[r["part"] * (COUNTERS // PARTS) :][: COUNTERS // PARTS] = np.frombuffer(r["counts"], np.int64)
    known = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("row_key").alias("rep_key"), F.first("n_shingles").alias("n"))
    firsts = prefixes(docs, counts, words, percent, text).groupBy("cls").agg(F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = cut(known.join(firsts, "cls").withColumn("cid", F.monotonically_increasing_id()), "ngram-classes")

    tokens = classes.select("cid", "n", F.explode("prefix").alias("token"))
    chosen = [F.min(F.struct(F.xxhash64("cid", F.lit(i)).alias("h"), "cid", "n")).alias(f"c{i}") for i in range(CENTRES)]
    groups = tokens.groupBy("token").agg(F.count("*").alias("size"), F.sum("n").alias("total"), *chosen).where("size > 1")
    members = cut(tokens.join(cut(groups, "ngram-groups"), "token"), "ngram-members")
    centre = F.explode(F.array(*[F.struct(F.col(f"c{i}.cid").alias("cid"), F.col(f"c{i}.n").alias("n")) for i in range(CENTRES)])).alias("c")
    star = members.select("cid", "n", centre).where((F.col("cid") != F.col("c.cid")) & (100 * F.least("n", "c.n") >= percent * F.greatest("n", "c.n")))
    pairs = star.select(F.greatest("cid", "c.cid").alias("p"), F.least("cid", "c.cid").alias("q")).distinct()
    side = lambda p, c, n, b: classes.select(F.col("cid").alias(p), F.col("cls").alias(c), F.col("n").alias(n), F.col("bits").alias(b))
    bounded = pairs.join(side("p", "u", "nu", "x"), "p").join(side("q", "v", "nv", "y"), "q").select("u", "v", "nu", "nv", "x", "y")
    likely = cut(bounded.mapInArrow(_bounded(percent), "u binary, v binary"), "ngram-likely")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return cut(shingle_sets(docs, wanted.join(classes.select("cls", "rep_key"), "cls"), words, text), "ngram-sets")

    sets = sets_of(likely.select(F.col("u").alias("cls")).unionByName(likely.select(F.col("v").alias("cls"))).distinct())
    x, y = sets.select(F.col("cls").alias("u"), F.col("set").alias("x")), sets.select(F.col("cls").alias("v"), F.col("set").alias("y"))
    links = cut(likely.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_confirm(percent), "u binary, v binary"), "ngram-links")
    roots = cut(components(links), "ngram-roots")

    of = classes.select("cid", "cls").join(roots, F.col("cls") == F.col("vertex"), "left").select("cid", F.coalesce("root", "cls").alias("root"))
    more_than_pairs = members.where("size > 2").select("token", "cid", "n", "size", "total").join(cut(of, "ngram-of"), "cid")
    tiles = _tiles(more_than_pairs, percent).join(classes.select("cid", "cls", "n", "bits"), "cid")
    packed = tiles.repartition(partitions(spark), "tile").groupBy("tile").agg(F.collect_list(F.struct("cls", "n", "bits", "root", "far")).alias("members"))  # two blocks at most
    rest = cut(packed.mapInArrow(_open(percent), "tile long, cls binary, root binary"), "ngram-open")
    if not rest.isEmpty():
        held = rest.join(sets_of(rest.select("cls").distinct()), "cls").groupBy("tile").agg(F.collect_list(F.struct("cls", "root", "set")).alias("members"))
        more = cut(held.select("members").mapInArrow(_settle(percent), "u binary, v binary").distinct(), "ngram-links")
        roots = cut(components(links.unionByName(more)), "ngram-roots")
    reached = classes.select("cls", "rep").join(roots, F.col("cls") == F.col("vertex"))
    least = reached.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = classes.select("cls", "rep").join(roots, F.col("cls") == F.col("vertex"), "left").join(least, "root", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.join(of_class, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
