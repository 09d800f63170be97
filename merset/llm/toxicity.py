"""Toxicity from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digits that stand for letters, and
turns punctuation into blanks. The lexicon holds word beginnings whose share of
toxic documents is far from their share of clean ones, learned from labelled
rows with its weights; phrases of a lexicon word and the word before it that
clean documents favour are exceptions and cancel the match. The sum of weights,
and the sum over the text's length, go through a logistic curve.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merset.llm.common import LOWER, flat, no_clash
from merset.session import cut, spread

#: Letters of other scripts by the Latin ones they look like. Fixed values.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
#: Digits and signs by the letters they stand for. Fixed values.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
_TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD)}
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in _TABLE) + "]")
_SIGN = re.compile(rb"(?<=[a-z])[@$]+(?=[a-z])")
_FOLD = bytes(ord(DIGITS[chr(i)]) if chr(i) in DIGITS else 32 if i < 128 and not chr(i).isalnum() else LOWER[i] for i in range(256))
SHORTEST, LONGEST = 3, 10


def folded(raw: bytes) -> list[bytes]:
    """The words of a text after folding, as UTF-8."""
    if not raw.isascii():
        text = raw.decode("utf-8", "replace").lower()
        raw = (text.translate(_TABLE).lower() if _ODD.search(text) else text).encode()
    if b"@" in raw or b"$" in raw:
        raw = _SIGN.sub(lambda m: m[0].replace(b"@", b"a").replace(b"$", b"s"), raw.lower())
    return raw.translate(_FOLD).split()


def beginnings(words: set[bytes]) -> set[bytes]:
    """Word beginnings of 3 to 10 bytes, and whole words with a blank at the end."""
    out = {w + b" " for w in words if len(w) >= SHORTEST}
    for n in range(SHORTEST, LONGEST + 1):
        out.update(w[:n] for w in words if len(w) >= n)
    return out


def _counts(rows: DataFrame, keys_of, kind: str) -> DataFrame:
    """key, n: in how many texts a key is; summed in each task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch({"key": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(keys_of(text or b""))
                if len(held) > 500_000:
                    yield out()
        yield out()

    return rows.select(F.col("text").cast("binary")).mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias(kind))


@dataclass
class Lexicon:
    """weights by beginning, exception phrases, and the logistic curve over three features."""

    weights: dict[bytes, float]
    exceptions: set[bytes]
    curve: np.ndarray

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for key, weight in self.weights.items():
            made.add_word((b" " + key).decode("latin-1"), (len(key) + 1, weight, False))
        for key in self.exceptions:
            made.add_word((b" " + key).decode("latin-1"), (len(key) + 1, 0.0, True))
        if len(made):
            made.make_automaton()
        return made


def features(words: list[bytes], automaton) -> tuple[float, float, float]:
    """Weight in all, weight per hundred words, and length, each as a logarithm.

    At each word the longest match counts; a match that ends within an
    exception phrase does not.
    """
    total = 0.0
    if words and len(automaton):
        text = (b" " + b" ".join(words) + b" ").decode("latin-1")
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight, exception) in automaton.iter(text):
            start = end - size + 1
            if exception:
                spared.append((start, end))
            elif size > best.get(start, (0, 0.0))[0]:
                best[start] = (size, weight)
        inside = {x for a, b in spared for x in range(a, b) if x in best}
        total = sum(w for start, (_, w) in best.items() if start not in inside)
    return float(np.log1p(total)), float(np.log1p(100 * total / max(len(words), 20))), float(np.log1p(len(words)))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Coefficients (last: constant) by Newton's method, slightly ridged; each row counts n times."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (y - p)) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, most_docs: int = 40_000, least_weight: float = 2.0) -> Lexicon:
    """A lexicon from texts (doc_id, text) and labels (doc_id, toxic 0/1; null: not used).

    At most about ``most_docs`` labelled ids, chosen by hash, are learned from;
    that bounds what is joined by broadcast. Terms: all word beginnings in at
    least 4 toxic texts and 1 in 500 of them (so at most 500 times as many as a
    text has), that weigh ``least_weight`` or more.
    Without both kinds of label the lexicon is empty, and scores are those of
    the commoner kind. An id with both labels counts with each; repeated labels
    count once, repeated texts as often as they are there.
    """
    rated = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    share = min(1.0, most_docs / max(1, rated.count()))
    chosen = rated.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rated
    rows = cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")
    rows = spread(rows)
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, set(), np.array([0.0, 0.0, 0.0, 3.0 if n1 else -3.0]))
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic = 0")
    spark = docs.sparkSession
    every = lambda t: beginnings(set(folded(t)))
    seen = _counts(toxic, every, "n1").where(F.col("n1") >= max(4, n1 // 500)).join(_counts(clean, every, "n0"), "key", "left")
    seen = seen.withColumn("w", F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.coalesce("n0", F.lit(0)) + 0.5) / (n0 + 1)))
    found = seen.where(F.col("w") >= least_weight + np.log(0.9) - 0.01).orderBy("key").collect()  # with those that may stand for a shorter one
    ones, weight = {bytes(r["key"]): r["n1"] for r in found}, {bytes(r["key"]): r["w"] for r in found}
    longest: dict[bytes, int] = {}
    for key, n in ones.items():
        for k in range(SHORTEST, len(key) if not key.endswith(b" ") else 0):
            longest[key[:k]] = max(longest.get(key[:k], 0), n)
    weight = {k: w for k, w in weight.items() if longest.get(k, 0) < 0.9 * ones[k]}  # a longer beginning says the same
    kept: dict[bytes, float] = {}
    for key in sorted((k for k, w in weight.items() if w >= least_weight), key=lambda k: (len(k), k)):
        shorter = max((kept.get(key[:n], 0.0) for n in range(SHORTEST, len(key))), default=0.0)
        if weight[key] > shorter + 1:
            kept[key] = weight[key]
    draft = Lexicon(kept, set(), np.zeros(4))
    shared = spark.sparkContext.broadcast(kept)

    def phrases(text: bytes) -> set[bytes]:
        words, lexicon = folded(text), shared.value
        hit = lambda w: any(w[:n] in lexicon for n in range(SHORTEST, LONGEST + 1)) or w + b" " in lexicon
        return {a + b" " + b for a, b in zip(words, words[1:], strict=False) if hit(b)}

    spared = _counts(clean, phrases, "n0").where("n0 >= 3").join(_counts(toxic, phrases, "n1"), "key", "left").where(f"n0 / {n0} >= coalesce(n1, 0) / {n1}").orderBy("key")
    draft.exceptions = {bytes(r["key"]) for r in spared.collect()}
    held = spark.sparkContext.broadcast(draft)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value.automaton()
        for batch in batches:
            x = [features(folded(t or b""), automaton) for t in batch.column(0).to_pylist()]
            a, b, c = zip(*x, strict=True) if x else ((), (), ())
            yield pa.record_batch([pa.array(v, pa.float64()) for v in (a, b, c)] + [batch.column(1)], names=["a", "b", "c", "toxic"])

    alike = rows.select(F.col("text").cast("binary"), "toxic").mapInArrow(measure, "a double, b double, c double, toxic int").groupBy("a", "b", "c", "toxic").agg(F.count("*").alias("n"))
    x = alike.toPandas().sort_values(["a", "b", "c", "toxic"])
    draft.curve = _logistic(x[["a", "b", "c"]].to_numpy(), x["toxic"].to_numpy(float), x["n"].to_numpy(float))
    return draft


def score_texts(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The ``keep`` columns with score (0 to 1) and predicted (1 if score is at least 0.5).

    Null and empty texts score as texts without a match. Whole texts count. One
    row a row of docs, repeated ones too; an empty table gives no rows. ``keep``
    with a name of the results is an error.
    """
    no_clash(keep, ("score", "predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, curve = shared.value.automaton(), shared.value.curve
        for batch in batches:
            raw, starts, ends = flat(batch.column(batch.num_columns - 1))
            x = np.array([(*features(folded(raw[a:b].tobytes()), automaton), 1.0) for a, b in zip(starts, ends, strict=True)]).reshape(-1, 4)
            p = np.round(1 / (1 + np.exp(-np.clip(x @ curve, -30, 30))), 9)
            yield pa.record_batch([*[batch.column(k) for k in range(batch.num_columns - 1)], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = ", ".join([*[f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep], "score double, predicted int"])
    return spread(docs.select(*keep, F.col(text).alias("_text"))).mapInArrow(run, schema)
