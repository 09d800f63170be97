"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

Equal shingle sets are one class from the start. Each of several independent
trees puts the classes into nodes by a minwise token; nodes that stay large are
branched again by two more tokens each (chosen by the node), until they are
small. Documents that share only a passage part ways within a level or two.

Within a small node all pairs are compared by sketch. First a spanning
forest of the pairs that pass, the likeliest first, is confirmed on full sets
and gives components. Then every pair that passes but lies in two components is
settled on full sets, by counting shared shingles within the node. So no group
emits its pairs, and no pair that passes is left unsettled unless links already
connect it. (After Christiani, Pagh and Sivertsen, Scalable and Robust Set
Similarity Join, 2018.)

A large node that hardly shrinks is a dense group: near copies, or texts around
one template. Minwise tokens tell nothing more there. Such nodes of all trees
are merged where they hold the same classes, and each is joined exactly on what
its sets do not have in common; see ``dense_links``. None is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merset.llm.common import LOWER, flat
from merset.llm.components import components
from merset.session import cut, spread

T = 64
TREES = 8
LEVELS = 5
LEAF = 256
BLOCK = 1024
#: A child with more than this share of its parent is dense.
DENSE = 0.5
#: Sets that a dense node's template is made from, about, and shingles of a block or leaf there.
SAMPLE = 200
WIDE = 1 << 20
#: Sets of a block where a dense node is compared in full, and how many pairs such a comparison may have for each row that branching would make.
TILE = 2048
PAIRS_A_ROW = 1 << 13
_rng = np.random.default_rng(8)
_MULT = _rng.integers(1, 1 << 63, T, dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class _Words(dict):
    """word: its 64-bit hash; emptied when it has a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes, words: int, known: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; of the whole sequence if it has fewer words; none without words."""
    tokens = text.translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) < words:
        return np.array([xxhash.xxh64_intdigest(b"\x00" + b" ".join(tokens))], np.uint64)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    n = len(h) - words + 1
    s = h[:n] * _STEP[0]
    for k in range(1, words):
        s += h[k : k + n] * _STEP[k]
    s ^= s >> np.uint64(33)
    s *= np.uint64(0xFF51AFD7ED558CCD)
    s ^= s >> np.uint64(33)
    return np.unique(s)


def sketch(s: np.ndarray) -> bytes:
    """T minwise tokens of 32 bits."""
    least = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 2048):
        np.minimum(least, (_MULT[:, None] * s[a : a + 2048]).min(1), out=least)
    return (least >> np.uint64(32)).astype("<u4").tobytes()


def signatures(docs: DataFrame, words: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, cls (128 bits of the set; null if empty), sketch and row_key (a hash of id and text), from whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            raw, starts, ends = flat(batch.column(1))
            n, cls, tokens = [], [], []
            for a, b in zip(starts, ends, strict=True):
                s = shingles(raw[a:b].tobytes(), words, known)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                tokens.append(sketch(s) if len(s) else None)
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(tokens, pa.binary()), batch.column(2)], names=["doc_id", "n_shingles", "cls", "sketch", "row_key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs.select("doc_id", text, F.xxhash64("doc_id", text))).mapInArrow(run, f"doc_id {kind}, n_shingles long, cls binary, sketch binary, row_key long")


def _token(position: Column) -> Column:
    return F.substring(F.col("sketch"), 1 + 4 * position, F.lit(4))


def _populous(rows: DataFrame, tag: str) -> DataFrame:
    """Rows with size and total (shingles) of nodes of two classes and more.

    Sizes are summed in each task before the shuffle, and written, so that the
    join is of two plain tables and AQE can split a hot node's side.
    """
    sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("total")).where("size > 1")
    return cut(rows.join(cut(sizes, f"{tag}-sizes"), "node"), tag)


def tree_nodes(classes: DataFrame) -> DataFrame:
    """node, cls, n, size, total, exact: small nodes, and those large ones (dense, or still large at the last level) that are to be joined exactly.

    classes: cls, n, sketch. A pair of similarity 0.8 shares a first token and
    one of the two next ones with a chance of 0.77 in a tree, so one of these
    nodes in eight trees with 1 - 0.23 ** 8, above 0.99999.
    """
    first = classes.select("cls", "n", F.explode(F.array(*[F.xxhash64(F.lit(r), _token(F.lit(r))) for r in range(TREES)])).alias("node"))
    rows = _populous(first.withColumn("parent_size", F.lit(None).cast("long")), "tree-1")
    open_ = (F.col("size") > LEAF) & F.coalesce(F.col("size") <= DENSE * F.col("parent_size"), F.lit(True))
    done = rows.where(~open_)
    for level in range(2, LEVELS + 1):
        large = rows.where(open_)
        if large.isEmpty():
            break
        one = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(T)).cast("int")
        two = F.pmod(one + 1 + F.pmod(F.xxhash64("node", F.lit(-level)), F.lit(T - 1)).cast("int"), F.lit(T))
        paths = F.array(*[F.xxhash64("node", p, _token(p)) for p in (one, two)])
        children = large.join(classes.select("cls", "sketch"), "cls").select("cls", "n", F.col("size").alias("parent_size"), F.explode(paths).alias("node"))
        rows = _populous(children, f"tree-{level}")
        done = done.unionByName(rows.where(~open_))
    else:
        done = done.unionByName(rows.where(open_))
    return done.select("node", "cls", "n", "size", "total", (F.col("size") > BLOCK).alias("exact"))


def merge_nodes(large: DataFrame) -> DataFrame:
    """node, cls, n, size, total: nodes of all trees merged with the largest node that over half of their classes are in.

    A dense group is a node in nearly every tree; so it is joined once. A node
    whose classes lie in no common larger one stays as it is. Every two classes
    that share a node still do.
    """
    hubs = large.groupBy("cls").agg(F.max(F.struct("size", "node")).alias("h"))
    votes = large.join(hubs, "cls").groupBy("node", F.col("h.node").alias("hub")).agg(F.count("*").alias("votes"), F.first("size").alias("size"))
    roots = components(votes.where("2 * votes > size").select(F.col("node").alias("u"), F.col("hub").alias("v")))
    merged = large.join(roots, large["node"] == roots["vertex"], "left").select(F.coalesce("root", "node").alias("node"), "cls", "n").distinct()
    return _populous(cut(merged, "merged"), "merged-nodes")


def _members(groups: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    """grp, members: the classes of each group with n_shingles, sketch and ``more``; a group is bounded by BLOCK."""
    return groups.join(classes, "cls").groupBy("grp").agg(F.collect_list(F.struct("cls", "n_shingles", "sketch", *more)).alias("members"))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """The 64-bit numbers of each value of a binary or list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        at = column.offsets.to_numpy()
        return np.split(column.values.to_numpy().view(np.uint64)[at[0] : at[-1]], at[1:-1] - at[0]) if len(column) else []
    raw, starts, ends = flat(column)
    return [np.frombuffer(raw[a:b].tobytes(), np.uint64) for a, b in zip(starts, ends, strict=True)]


def _template(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some sets of each node to its template: the members of over half of them; and how often a template member is missing, and any other that repeats is there."""
    for batch in batches:
        common, known, counts = [], [], []
        for sets in batch.column("sets"):
            each = _arrays(sets.values)
            x, n = np.unique(np.concatenate(each), return_counts=True)
            on = 2 * n > len(each)
            n = np.where(on, len(each) - n, n)
            common.append(x[on].tobytes())
            known.append(x[on | (n > 1)].tobytes())
            counts.append(n[on | (n > 1)].astype(np.int64).tobytes())
        yield pa.record_batch([batch.column("node"), batch.column("nb"), *[pa.array(c, pa.binary()) for c in (common, known, counts)]], names=["node", "nb", "common", "known", "counts"])


DIFFERENCES = "node long, nb long, blk long, cls binary, n long, e long, a array<bigint>"


def _differences(percent: int):
    """A block's sets and its node's template to what each set and the template do not share, rarest first, and e: how far from the template that is."""

    def run(rows: pa.Table, template: pa.Table) -> pa.Table:
        get = lambda name: np.frombuffer(template.column(name)[0].as_py(), np.uint64) if template.num_rows else np.zeros(0, np.uint64)
        common, known, counts = get("common"), get("known"), get("counts").astype(np.int64)
        lists = []
        for s in _arrays(rows.column("s")):
            a = np.setxor1d(s, common, assume_unique=True)
            at = np.minimum(np.searchsorted(known, a), max(len(known) - 1, 0))
            often = np.where(known[at] == a, counts[at], 0) if len(known) else np.zeros(len(a), np.int64)
            lists.append(a[np.lexsort((a, often))].view(np.int64))
        size = np.array([len(a) for a in lists], np.int64)
        e = (100 + percent) * size - (100 - percent) * rows.column("n").to_numpy()
        a = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate([*lists, np.zeros(0, np.int64)])))
        return pa.table([*[rows.column(c) for c in ("node", "nb", "blk", "cls", "n")], pa.array(e, pa.int64()), a], names=["node", "nb", "blk", "cls", "n", "e", "a"])

    return run


def _linked(percent: int):
    """Members (cls, e, far, a) of a leaf to a spanning forest of their links; pairs of two that aren't far are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for members in batch.column("members"):
                m = members.values
                cls, e = m.field("cls").to_pylist(), m.field("e").to_numpy()
                part = np.arange(len(cls))
                counted = _shared(_arrays(m.field("a")))
                for i in np.flatnonzero(m.field("far").to_numpy(zero_copy_only=False)):
                    for j in np.flatnonzero((2 * (100 + percent) * counted(i) >= e[i] + e) & (part != part[i])):
                        if part[i] != part[j]:
                            part[part == part[j]] = part[i]
                            us.append(max(cls[i], cls[j]))
                            vs.append(min(cls[i], cls[j]))
            yield pa.record_batch({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return run


def _crossed(percent: int):
    """A tile (cls, e, far, a, second) to a spanning forest of the links between its first and second block, or within its only one; pairs of two that aren't far are left out."""

    def run(tile: pa.Table) -> pa.Table:
        us, vs = [], []
        cls, e = tile.column("cls").to_pylist(), tile.column("e").to_numpy()
        far, second = tile.column("far").to_numpy(), tile.column("second").to_numpy()
        other = second if second.any() and not second.all() else np.ones(len(cls), bool)
        part, counted = np.arange(len(cls)), _shared(_arrays(tile.column("a")), other)
        for i in np.flatnonzero(~second if second.any() else other):
            for j in np.flatnonzero(other & (far | far[i]) & (part != part[i]) & (2 * (100 + percent) * counted(i) >= e[i] + e)):
                if part[i] != part[j]:
                    part[part == part[j]] = part[i]
                    us.append(max(cls[i], cls[j]))
                    vs.append(min(cls[i], cls[j]))
        return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return run


def dense_links(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: links that connect what is linked within each node. large: node, cls, n, size, total; sets: cls, set.

    A node's template C is what over half of a sample of its sets hold. With
    A = a xor C and e(a) = (100 + percent) |A| - (100 - percent) |a|, two sets
    are linked iff 2 (100 + percent) |A and B| >= e(a) + e(b), whatever C is.
    So of the sets with e(a) + e(b) <= 0, all are linked with the one of the
    smallest e, its centre: one link each. All other links share a member of A
    and B, and, taking members from the rarest on, one of the first
    |A| - q + 1, with q the least number that any partner must share. These
    members name the node's children; children of up to BLOCK classes are
    compared on their members, larger ones are nodes with a template of their
    own. A child has about half its parent at most, so this ends; and it is
    exact for any template. The order of members is the template's, the same
    for all of a node.

    Where all children together have more pairs than the node itself (filled-in
    forms: few values in each slot), branching only multiplies the work. Such a
    node, if branching would also make a row for each PAIRS_A_ROW of its pairs, is
    compared in full instead: blocks of up to TILE sets meet in tiles, in which
    shared members are counted and only links of a spanning forest are given out.
    A larger one branches once more first. Both ways are exact.

    A node's sets are dealt into blocks of about BLOCK sets and WIDE shingles,
    and its template is sent to each, so no task holds a node.
    """
    spark = large.sparkSession
    state = large.join(sets.withColumnRenamed("set", "s"), "cls").select("node", "cls", "n", "s", "size", "total")
    found = spark.createDataFrame([], "u binary, v binary")
    of_block = lambda k: F.xxhash64("node", k)
    dealt = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1), of_block)).alias("blk")
    while True:
        state = state.withColumn("nb", F.ceil(F.greatest(F.col("size") / F.lit(BLOCK), F.col("total") / F.lit(WIDE))).cast("long"))
        state = state.withColumn("blk", of_block(F.pmod(F.xxhash64("cls"), F.col("nb"))))
        share = F.greatest(F.lit(32) / F.col("size"), F.least(F.lit(SAMPLE) / F.col("size"), F.lit(2 * WIDE) / F.col("total")))
        sample = state.where(F.pmod(F.xxhash64("cls", "node"), F.lit(1 << 30)) < share * (1 << 30))
        template = sample.groupBy("node").agg(F.first("nb").alias("nb"), F.collect_list("s").alias("sets")).mapInArrow(_template, "node long, nb long, common binary, known binary, counts binary")
        blocks = template.select(dealt, "common", "known", "counts")
        apart = cut(state.select("node", "nb", "blk", "cls", "n", "s").groupBy("blk").cogroup(blocks.groupBy("blk")).applyInArrow(_differences(percent), DIFFERENCES), "dense-differences")
        centre = cut(apart.groupBy("node").agg(F.min(F.struct("e", "cls")).alias("c"), F.max("nb").alias("nb"), F.count("*").alias("held"), F.sum(F.size("a")).alias("wide")), "dense-centres")
        told = apart.join(centre.select(dealt, F.col("c.e").alias("least"), F.col("c.cls").alias("centre")), "blk")
        star = told.where("e + least <= 0 AND cls <> centre").select(F.greatest("cls", "centre").alias("u"), F.least("cls", "centre").alias("v"))
        far = F.col("e") + F.col("least") > 0
        partner = F.when(far, F.col("least")).otherwise(1 - F.col("least"))
        must = F.greatest(F.lit(1), F.ceil((F.col("e") + partner) / F.lit(2 * (100 + percent))))
        first = F.greatest(F.lit(0), F.size("a") - must + 1).cast("int")
        kids = told.select("node", "cls", far.alias("far"), F.size("a").alias("width"), F.explode(F.slice("a", 1, first)).alias("x")).select(F.xxhash64("node", "x").alias("child"), "node", "cls", "far", "width")
        sizes = cut(kids.groupBy("child").agg(F.count("*").alias("size"), F.sum("width").alias("total"), F.count_if("far").alias("n_far"), F.first("node").alias("of")).where("size > 1 AND n_far > 0"), "dense-sizes")
        square = lambda c: F.pow(F.col(c).cast("double"), 2)
        work = sizes.groupBy(F.col("of").alias("node")).agg(F.sum("size").alias("rows"), F.sum(square("size")).alias("pairs"))
        whole = (F.col("pairs") > square("held")) & (square("held") <= F.col("rows") * PAIRS_A_ROW)
        tiles = F.ceil(F.greatest(F.col("held") / F.lit(TILE), F.col("wide") / F.lit(WIDE))).cast("long").alias("tiles")
        full = cut(work.join(centre, "node").where(whole).select("node", "nb", tiles, F.col("c.e").alias("least")), "dense-full")
        at = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("tiles"))
        laid = apart.join(full.select(dealt, "tiles", "least"), "blk").select("node", "cls", "e", (F.col("e") + F.col("least") > 0).alias("far"), "a", at.alias("at"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("to"))
        laid = laid.select(F.xxhash64("node", F.least("at", "to"), F.greatest("at", "to")).alias("tile"), "cls", "e", "far", "a", (F.col("at") > F.col("to")).alias("second"))
        crossed = laid.groupBy("tile").applyInArrow(_crossed(percent), "u binary, v binary")
        kids = cut(kids.join(sizes.join(full.select(F.col("node").alias("of")), "of", "left_anti").drop("of"), "child"), "dense-children")
        leaf = (F.col("size") <= BLOCK) & ((F.col("total") <= 4 * WIDE) | (F.col("size") <= 32))
        inside = kids.where(leaf).join(apart.select("node", "cls", "e", "a"), ["node", "cls"]).groupBy("child").agg(F.collect_list(F.struct("cls", "e", "far", "a")).alias("members"))
        within = inside.select("members").mapInArrow(_linked(percent), "u binary, v binary")
        found = found.unionByName(cut(star.unionByName(within).unionByName(crossed).distinct(), "dense-links"))
        large = kids.where(~leaf)
        if large.isEmpty():
            return found
        state = large.join(apart.select("node", "cls", "n", "a"), ["node", "cls"]).select(F.col("child").alias("node"), "cls", "n", F.col("a").alias("s"), "size", "total")


def _tokens_of(m: pa.StructArray) -> np.ndarray:
    return np.frombuffer(b"".join(m.field("sketch").to_pylist()), "<u4").reshape(-1, T)


def _passing(m: pa.StructArray, share: float) -> np.ndarray:
    """Equal tokens of each pair that may reach ``share``; -1 for other pairs. At the threshold a pair passes with five standard deviations to spare."""
    least = int(np.floor(share * T - 5 * np.sqrt(T * share * (1 - share))))
    tokens, n = _tokens_of(m), m.field("n_shingles").to_numpy()
    same = np.zeros((len(n), len(n)), np.int16)
    for a in range(0, len(n), 64):
        same[a : a + 64] = (tokens[a : a + 64, None, :] == tokens[None, :, :]).sum(2, dtype=np.int16)
    close = np.minimum(n[:, None], n) >= share * np.maximum(n[:, None], n) - 1e-9
    same[(same < least) | ~close] = -1
    np.fill_diagonal(same, -1)
    return same


def _forest(same: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs that aren't -1, likeliest first in each round."""
    n = len(same)
    part, edges = np.arange(n), []
    while True:
        apart = np.where(part[:, None] != part, same, -1)
        to = apart.argmax(1)
        most = apart[np.arange(n), to]
        ahead = np.lexsort((np.arange(n), -most))
        if most[ahead[0]] < 0:
            return edges
        seen: set[int] = set()
        for i in ahead:
            if most[i] < 0:
                break
            a, b = int(part[i]), int(part[to[i]])
            if a == b or a in seen:
                continue
            seen.add(a)
            edges.append((int(i), int(to[i])))
            part[part == a] = b
            seen.discard(b)


def _likely(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for members in batch.column("members"):
                m = members.values
                cls = m.field("cls").to_pylist()
                for i, j in _forest(_passing(m, share)):
                    us.append(max(cls[i], cls[j]))
                    vs.append(min(cls[i], cls[j]))
            yield pa.record_batch({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return run


def _unsettled(share: float):
    """Groups (with each class's component) to the classes that have a passing pair in two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grps, out, roots = [], [], []
            for grp, members in zip(batch.column("grp").to_pylist(), batch.column("members"), strict=True):
                m = members.values
                root = m.field("root").to_pylist()
                part = np.unique(np.array(root, object), return_inverse=True)[1]
                if part.max(initial=0) == 0:
                    continue
                cls = m.field("cls").to_pylist()
                for i in np.flatnonzero(((_passing(m, share) >= 0) & (part[:, None] != part)).any(1)):
                    grps.append(grp)
                    out.append(cls[i])
                    roots.append(root[i])
            yield pa.record_batch({"grp": pa.array(grps, pa.int64()), "cls": pa.array(out, pa.binary()), "root": pa.array(roots, pa.binary())})

    return run


def _shared(sets: list[np.ndarray], among: np.ndarray | None = None):
    """A function from a set's number to how many members it shares with each of ``sets``, or of those ``among`` is true for (0 elsewhere)."""
    n = np.array([len(x) for x in sets], np.int64)
    member = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)[1]
    order = np.argsort(member, kind="stable")
    owner = np.repeat(np.arange(len(n)), n)[order]
    if among is not None:
        order, owner = order[among[owner]], owner[among[owner]]
    start = np.searchsorted(member[order], np.arange(member.max(initial=-1) + 2))
    at = np.cumsum(n) - n

    def counted(i: int) -> np.ndarray:
        own = member[at[i] : at[i] + n[i]]
        size = start[own + 1] - start[own]
        where = np.repeat(start[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.bincount(owner[where], minlength=len(n))

    return counted


def _settle(percent: int):
    """Groups of (cls, root, set) to a link for each two components that have one there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for members in batch.column("members"):
                m = members.values
                cls, sets = m.field("cls").to_pylist(), _arrays(m.field("set"))
                part = np.unique(np.array(m.field("root").to_pylist(), object), return_inverse=True)[1]
                n, counted = np.array([len(x) for x in sets]), _shared(sets)
                linked: set[tuple[int, int]] = set()
                for i in np.flatnonzero(part != np.bincount(part).argmax()):
                    both = counted(i)
                    for j in np.flatnonzero((part != part[i]) & (100 * both >= percent * (n[i] + n - both))):
                        key = (int(min(part[i], part[j])), int(max(part[i], part[j])))
                        if key not in linked:
                            linked.add(key)
                            us.append(max(cls[i], cls[j]))
                            vs.append(min(cls[i], cls[j]))
            yield pa.record_batch({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})

    return run


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, text: str = "text") -> DataFrame:
    """cls, set (its hashes, sorted) for the classes in ``wanted`` (cls, rep_key: the row_key of a row that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            raw, starts, ends = flat(batch.column(1))
            kept, sets = [], []
            for cls, a, b in zip(batch.column(0).to_pylist(), starts, ends, strict=True):
                s = shingles(raw[a:b].tobytes(), words, known).tobytes()
                if xxhash.xxh3_128_digest(s) == cls:
                    kept.append(cls)
                    sets.append(s)
            yield pa.record_batch({"cls": pa.array(kept, pa.binary()), "set": pa.array(sets, pa.binary())})

    texts = docs.where(F.col(text).isNotNull()).select(F.xxhash64("doc_id", text).alias("rep_key"), F.col(text).alias("text"))
    rows = texts.join(wanted, "rep_key").select("cls", "text")
    return rows.mapInArrow(run, "cls binary, set binary").groupBy("cls").agg(F.first("set").alias("set"))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                on.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(on, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, row_key, component_id, kept: one row a row of ``docs``.

    Two texts are linked if 100 times the size of the intersection of their
    sets of ``words``-word shingles is at least ``percent`` times the union's.
    component_id is the smallest doc_id that links reach; kept says that it is
    the row's own. Words are runs of anything but ASCII white space, A-Z
    lower-cased; a text with fewer words is one shingle; null and empty texts
    have none, are linked with nothing, and are their own component.

    Rows with the same doc_id but different texts are each linked by their own
    text. A null doc_id is never a component's id unless all of it is null; such
    rows are kept only then. Repeated rows of a kept doc_id are all kept. Long
    texts are taken whole. An empty table gives an empty result. Other columns
    of docs are not read.
    """
    rows = cut(signatures(docs, words, text), "signatures")
    classes = cut(rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("row_key").alias("rep_key"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    share = percent / 100
    sketches = classes.select("cls", "n_shingles", "sketch")
    nodes = cut(tree_nodes(classes.select("cls", F.col("n_shingles").alias("n"), "sketch")), "nodes")
    groups, large = nodes.where("not exact").select(F.col("node").alias("grp"), "cls").distinct(), nodes.where("exact").drop("exact")
    large = large if large.isEmpty() else merge_nodes(large)
    likely = cut(_members(groups, sketches).select("members").mapInArrow(_likely(share), "u binary, v binary").distinct(), "likely")
    ends = likely.select(F.col("u").alias("cls")).unionByName(likely.select(F.col("v").alias("cls"))).distinct()
    wanted = ends.unionByName(large.select("cls")).distinct()
    sets = cut(shingle_sets(docs, wanted.join(classes.select("cls", "rep_key"), "cls"), words, text), "shingle-sets")
    x, y = sets.select(F.col("cls").alias("u"), F.col("set").alias("x")), sets.select(F.col("cls").alias("v"), F.col("set").alias("y"))
    links = cut(likely.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_confirm(percent), "u binary, v binary"), "links")
    if not large.isEmpty():
        links = links.unionByName(dense_links(large, sets, percent))
    roots = cut(components(links), "roots")
    parted = ends.join(roots, ends["cls"] == roots["vertex"], "left").select("cls", F.coalesce("root", "cls").alias("root"))
    rest = _members(groups, sketches.join(parted, "cls"), "root").where(F.size("members") > 1).select("grp", "members").mapInArrow(_unsettled(share), "grp long, cls binary, root binary")
    held = rest.join(sets, "cls").groupBy("grp").agg(F.collect_list(F.struct("cls", "root", "set")).alias("members"))
    more = cut(held.select("members").mapInArrow(_settle(percent), "u binary, v binary").distinct(), "links")
    if not more.isEmpty():
        roots = cut(components(links.unionByName(more)), "roots")
    reached = classes.select("cls", "rep").join(roots, classes["cls"] == roots["vertex"]).groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = classes.select("cls", "rep").join(roots, classes["cls"] == roots["vertex"], "left").join(reached, "root", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "row_key", "cls").join(of_class, "cls", "left")
    return out.select("doc_id", "n_shingles", "row_key", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are kept; of repeated rows (same doc_id and text) one."""
    kept = near_duplicates(docs, words, percent, text).where("kept").select("row_key").distinct()
    marked = docs.withColumn("_row_key", F.xxhash64("doc_id", text))
    there = marked.join(kept, marked["_row_key"] == kept["row_key"], "left_semi")
    return there.dropDuplicates(["_row_key", "doc_id"]).drop("_row_key")  # dealt by the key already
