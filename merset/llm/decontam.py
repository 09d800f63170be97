"""Benchmark decontamination: a BM25 inverted index of test items, asked by every training passage.

Items are classed by length, doubling from class to class. For a class of up to
L words, a passage is a window of 2 L words at every multiple of L, so each
occurrence of an item lies whole in one of them, whatever other items there
are. Weights are BM25's for a passage's distinct words, divided by what an item
scores on its own words, so 1 means the whole item.

Retrieval is block-max WAND with the terms of an item in a fixed order, rarest
first. An item's pivot is where the terms that follow can no longer matter much:
only the terms up to it, which carry LEAD of the item's weight, are posted. A
passage so skips every item none of whose leading terms it has. Postings are
grouped by blocks of items with the largest weight of each term there; a block
is skipped if the sum of these maxima, with the most that its trailing terms
may add, stays below the threshold. Items of the other blocks are scored in
full, so nothing above the threshold is missed. What is retrieved is verified
on the item's words: question shingles and answer words in the passage.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merset.llm.common import LOWER, flat, slices
from merset.session import cut, spread

BLOCK = 4
#: Share of an item's weight that its leading terms have at least.
LEAD = 0.7
#: Words of the first class's items.
SHORTEST = 32
CHUNK = 1 << 20
#: ASCII punctuation and white space to blanks, A-Z to a-z.
PLAIN = bytes(32 if i < 128 and not chr(i).isalnum() else LOWER[i] for i in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def span_of(n_words: int) -> int:
    """The class of an item: SHORTEST doubled until the item fits."""
    return max(SHORTEST, 1 << (n_words - 1).bit_length())


@dataclass
class Item:
    """One test item: its key, words, question shingles and answer words."""

    key: bytes
    words: list[bytes]
    question: set[tuple[bytes, ...]]
    answer: set[bytes]


def parts_of(text: bytes, n: int) -> tuple[set[tuple[bytes, ...]], set[bytes]]:
    """n-word shingles of the question (all but the last sentence, or everything if there is only one) and the words of the answer (the last sentence)."""
    body = text.rstrip(b" \t\r\n.?!")
    cut_at = max(body.rfind(c) for c in b".?!\n") if body else -1
    question, answer = words_of(body[: cut_at + 1]), words_of(body[cut_at + 1 :])
    if len(question) < n:
        question = words_of(text)
    n = min(n, len(question))
    return {tuple(question[i : i + n]) for i in range(len(question) - n + 1)}, set(answer or question)


def weights_of(words: list[bytes], df: dict[bytes, int], n_items: int, mean: float, k1: float = 1.2, b: float = 0.75) -> dict[bytes, float]:
    """An item's BM25 weight of each of its terms, as shares of their sum."""
    w = {t: np.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * c * (k1 + 1) / (c + k1 * (1 - b + b * len(words) / mean)) for t, c in Counter(words).items()}
    own = sum(w.values())
    return {t: float(x / own) for t, x in w.items()}


class Postings:
    """The items of one length class: leading postings by term and block, with block maxima, and each item's terms."""

    def __init__(self, span: int, items: list[tuple[Item, dict[bytes, float]]], ids: dict[bytes, int], df: dict[bytes, int]):
        self.span, leads = span, []
        for item, w in items:
            ahead, lead = 0.0, []
            for t in sorted(w, key=lambda t: (df[t], t)):
                if ahead >= LEAD:
                    break
                ahead += w[t]
                lead.append(t)
            leads.append((lead, 1 - ahead))
        order = sorted(range(len(items)), key=lambda i: (leads[i][1], items[i][0].key))  # alike in what their trailing terms may add
        self.items = [items[i][0] for i in order]
        self.terms = [np.array([ids[t] for t in items[i][1]], np.int64) for i in order]
        self.weights = [np.array(list(items[i][1].values())) for i in order]
        trailing = np.array([leads[i][1] for i in order])
        self.n_blocks = -(-len(order) // BLOCK)
        self.trailing = np.maximum.reduceat(trailing, np.arange(0, len(order), BLOCK))
        lists: dict[int, dict[int, float]] = defaultdict(dict)
        for at, i in enumerate(order):
            for t in leads[i][0]:
                own = lists[ids[t]]
                own[at // BLOCK] = max(own.get(at // BLOCK, 0.0), items[i][1][t])
        size = np.zeros(len(ids), np.int64)
        for t, own in lists.items():
            size[t] = len(own)
        self.start = np.concatenate([[0], np.cumsum(size)])
        self.block, self.block_max = np.zeros(int(size.sum()), np.int64), np.zeros(int(size.sum()))
        for t, own in lists.items():
            self.block[self.start[t] : self.start[t + 1]] = list(own)
            self.block_max[self.start[t] : self.start[t + 1]] = list(own.values())
        self.leading = size > 0

    def candidates(self, terms: np.ndarray, cell: np.ndarray, joined: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(cell, block) for passages (a cell and, where ``joined``, the next one) and blocks that may reach ``threshold``, in order.

        terms, cell: the distinct leading terms of each cell. A term in both
        cells of a passage counts twice in the bound.
        """
        n = self.start[terms + 1] - self.start[terms]
        owner = np.repeat(np.arange(len(terms)), n)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[terms], n)
        key, most = cell[owner] * self.n_blocks + self.block[at], self.block_max[at]
        before = cell[owner] > 0
        before[before] = joined[cell[owner][before] - 1]
        key, most = np.concatenate([key, key[before] - self.n_blocks]), np.concatenate([most, most[before]])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bound, (cells, blocks) = np.add.reduceat(most[order], first), np.divmod(key[first], self.n_blocks)
        on = bound + self.trailing[blocks] >= threshold - 1e-9
        return cells[on], blocks[on]


class Index:
    """One shard of items: term numbers and the postings of each length class."""

    def __init__(self, items: list[Item], df: dict[bytes, int], n_items: int, mean: float):
        self.ids: dict[bytes, int] = {}
        by_span: dict[int, list] = defaultdict(list)
        for item in items:
            w = weights_of(item.words, df, n_items, mean)
            for t in w:
                self.ids.setdefault(t, len(self.ids))
            by_span[span_of(len(item.words))].append((item, w))
        self.classes = [Postings(span, by_span[span], self.ids, df) for span in sorted(by_span)]


def split_items(benchmark: DataFrame) -> DataFrame:
    """key, text, words: the distinct texts of the items, without those that have no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([words_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))], names=["key", "text", "words"])

    texts = benchmark.where(F.col("text").isNotNull()).select(item_key().alias("key"), F.col("text").cast("binary").alias("text"))
    return texts.dropDuplicates(["key"]).mapInArrow(run, "key binary, text binary, words array<binary>").where(F.size("words") > 0)


def item_key():
    return F.unhex(F.md5(F.col("text").cast("binary")))


def index_shards(items: DataFrame, most_items: int, shingle: int) -> Iterator[Index]:
    """Indexes of about ``most_items`` items each, and 50 times as many words, so what a task holds is bounded whatever the benchmark's size.

    items: as ``split_items`` has them. Document frequencies and the mean
    length are those of the whole benchmark; of the frequencies a shard gets
    only its own terms'. Which shard an item is in changes no result.
    """
    n, words = items.agg(F.count("*"), F.sum(F.size("words"))).first()
    if not n:
        return
    df = cut(items.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "item-terms")
    shards = max(-(-n // most_items), -(-words // (50 * most_items)))
    for k in range(shards):
        own = items.where(F.pmod(F.xxhash64("key"), F.lit(shards)) == k)
        made = [Item(bytes(r["key"]), [bytes(w) for w in r["words"]], *parts_of(bytes(r["text"]), shingle)) for r in own.orderBy("key").collect()]
        if made:
            terms = own.select(F.explode("words").alias("term")).distinct()
            yield Index(made, {bytes(r["term"]): r["df"] for r in df.join(terms, "term").collect()}, n, words / n)


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = 0.6, overlap: float = 0.5, shingle: int = 5, most_items: int = 20_000) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row a document and item that it contains.

    score is the best passage's BM25 in units of the item's score on itself;
    passages of at least ``threshold`` are retrieved, all of them. Kept are
    those with at least ``overlap`` of the question's ``shingle``-word shingles
    and of the answer's distinct words. Words are compared without ASCII
    punctuation and case. Document frequencies count equal items once.

    Null, empty and wordless texts and items give nothing. Equal items are found
    alike, each with its id, null or repeated ones too; repeated documents give
    repeated rows. Very long texts are searched whole. An empty benchmark or
    table gives no rows. Other columns are not read. most_items: items that are
    searched for at once; a larger benchmark takes several passes, with equal
    results.
    """
    spark = docs.sparkSession
    items = cut(split_items(benchmark), "items")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key binary, score double, question_overlap double, answer_overlap double"
    found = spark.createDataFrame([], schema)
    rows = spread(docs.select("doc_id", text).where(F.col(text).isNotNull()))
    for index in index_shards(items, most_items, shingle):
        shared = spark.sparkContext.broadcast(index)
        found = found.unionByName(rows.mapInArrow(_search(shared, threshold, overlap, shingle), schema))
    named = benchmark.where(F.col("text").isNotNull()).select("item_id", item_key().alias("key"))
    return found.join(named, "key").select("doc_id", "item_id", "score", "question_overlap", "answer_overlap")


def _search(shared, threshold: float, overlap: float, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        get = index.ids.get
        for batch in batches:
            raw, starts, ends = flat(batch.column(1))
            hits: list[tuple[int, bytes, float, float, float]] = []
            for i, j in slices(starts, ends, CHUNK):
                lists = [words_of(raw[a:b].tobytes()) for a, b in zip(starts[i:j], ends[i:j], strict=True)]
                n = np.array([len(x) for x in lists])
                ids = np.fromiter(map(get, chain.from_iterable(lists), repeat(-1)), np.int64, int(n.sum()))
                for own in index.classes:
                    hits += [(i + d, *x) for d, *x in _matches(own, lists, n, ids, threshold, overlap)]
            if hits:
                d, key, score, q, a = zip(*hits, strict=True)
                yield pa.record_batch([batch.column(0).take(pa.array(d, pa.int64())), pa.array(key, pa.binary()), *[pa.array(np.round(x, 9)) for x in (score, q, a)]], names=["doc_id", "key", "score", "question_overlap", "answer_overlap"])

    return run


def _matches(own: Postings, lists: list[list[bytes]], n: np.ndarray, ids: np.ndarray, threshold: float, overlap: float) -> list[tuple]:
    """(document, item key, score, question and answer overlap) of the best passage of each document and item; ids: term numbers of all words, -1 for others."""
    span = own.span
    n_cells = -(-n // span)
    first, word_start = np.cumsum(n_cells) - n_cells, np.cumsum(n) - n
    if not n_cells.sum():
        return []
    on = np.flatnonzero(np.where(ids >= 0, own.leading[ids], False))
    document = np.searchsorted(word_start, on, side="right") - 1
    cell = first[document] + (on - word_start[document]) // span
    cells, terms = np.divmod(np.unique(cell * len(own.leading) + ids[on]), len(own.leading))
    joined = np.ones(int(n_cells.sum()), bool)
    joined[(first + n_cells - 1)[n_cells > 0]] = False
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    passages, blocks = own.candidates(terms, cells, joined, threshold)
    cuts = np.append(np.flatnonzero(np.diff(passages, prepend=-1)), len(passages))
    for a, b in zip(cuts, cuts[1:], strict=False):
        c = int(passages[a])
        d = int(np.searchsorted(first, c, side="right")) - 1
        at = (c - int(first[d])) * span
        there = np.unique(ids[word_start[d] + at : word_start[d] + min(at + 2 * span, int(n[d]))])
        words, runs = lists[d][at : at + 2 * span], {}
        for k in chain.from_iterable(range(x * BLOCK, min((x + 1) * BLOCK, len(own.items))) for x in blocks[a:b].tolist()):
            score = float(own.weights[k][np.isin(own.terms[k], there)].sum())
            if score < threshold - 1e-9:
                continue
            item = own.items[k]
            size = len(next(iter(item.question)))
            if size not in runs:
                runs[size] = {tuple(words[x : x + size]) for x in range(len(words) - size + 1)}
            q, s = len(item.question & runs[size]) / len(item.question), len(item.answer & set(words)) / len(item.answer)
            if q >= overlap and s >= overlap:
                best[d, k] = max(best.get((d, k), (0.0, 0.0, 0.0)), (score, q, s))
    return [(d, own.items[k].key, *x) for (d, k), x in sorted(best.items())]
