"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit of the code a binary classifier over
hashed byte trigrams tells languages with 1 from languages with 0. The
classifiers are naive Bayes: all they need are trigram counts by language,
summed over the whole training fold by Spark (a feature has one of 2^14 values,
so the model's size depends on the number of languages, not on the input).
Decoding adds, for each codeword, the logistic losses of its bits, weighted by
how well each classifier separates its two sides; the nearest codeword wins,
and a small gap to the next flags the answer as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merset.llm.common import LOWER, flat, no_clash, slices
from merset.session import spread

FEATURE_BITS = 14
CHUNK = 1 << 20
LETTER = regex.compile(r"\p{L}")
_rng = np.random.default_rng(20)
_T = _rng.integers(0, 1 << FEATURE_BITS, size=(3, 256), dtype=np.uint16)[:, np.frombuffer(LOWER, np.uint8)]
_ASCII_LETTER = np.array([chr(i).isalpha() for i in range(128)] + [False] * 128)


def trigrams(data: np.ndarray) -> np.ndarray:
    """The hashed trigram that starts at each byte but the last two, A-Z as a-z."""
    if len(data) < 3:
        return np.zeros(0, np.uint16)
    return _T[0][data[:-2]] ^ _T[1][data[1:-1]] ^ _T[2][data[2:]]


@dataclass
class Code:
    """What scoring needs: languages, their codewords (-1 or 1), one weight a feature and bit, and the bits' weights."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    alpha: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1: all splits of the languages for up to 6, else a random code of large least distance."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= 6:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[1 if (s >> i) & 1 else -1 for s in splits] for i in range(n)], float)
    rng, best, most = np.random.default_rng(seed), None, -1
    bits = 6 * int(np.ceil(np.log2(n))) + 3
    for _ in range(64):
        c = rng.integers(0, 2, size=(n, bits)) * 2.0 - 1
        c[:, np.abs(c.sum(0)) == n] *= np.where(np.arange(n) % 2, 1, -1)[:, None]
        apart = (bits - c @ c.T) / 2 + np.eye(n) * bits
        if apart.min() > most:
            best, most = c, apart.min()
    return best


def trigram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, feature, n: counts over all rows with a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                on = np.flatnonzero(counts)
                yield pa.record_batch({"lang": pa.array([name] * len(on), pa.string()), "feature": pa.array(on.astype(np.int32)), "n": pa.array(counts[on])})
            held.clear()

        for batch in batches:
            raw, starts, ends = flat(batch.column(0))
            langs = batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                if name not in held and len(held) >= 256:
                    yield from out()
                sums = held.setdefault(name, np.zeros(1 << FEATURE_BITS, np.int64))
                for i in (i for i, x in enumerate(langs) if x == name):
                    for a in range(starts[i], ends[i], CHUNK):
                        sums += np.bincount(trigrams(raw[a : min(a + CHUNK + 2, ends[i])]), minlength=1 << FEATURE_BITS)
        yield from out()

    rows = docs.select(F.col(text), F.col(lang)).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    return spread(rows).mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Code:
    """Classifiers from all of ``docs``; to the driver come 2^14 counts a language at most."""
    counts = trigram_counts(docs, text, lang).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    n = np.zeros((len(languages), 1 << FEATURE_BITS))
    at = {x: i for i, x in enumerate(languages)}
    np.add.at(n, (np.array([at[x] for x in counts.column("lang").to_pylist()], int), counts.column("feature").to_numpy()), counts.column("n").to_numpy())
    words = codewords(len(languages))
    p = (n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * n.shape[1])
    side = lambda sign: np.stack([p[words[:, b] == sign].mean(0) for b in range(words.shape[1])], 1) if words.size else np.zeros((n.shape[1], 0))
    yes, no = side(1), side(-1)
    weights = np.log(yes / no)
    apart = ((yes - no) * weights).sum(0)
    return Code(languages, words, weights.astype(np.float32), apart / apart.mean() if len(apart) else apart)


def has_language(text: Column, lang_pred: Column, ambiguous: Column, enough: int = 64) -> Column:
    """Whether a text is in one of the languages: it has a letter, and is nearest to one codeword unless it is too short to tell (fewer than ``enough`` bytes)."""
    return (lang_pred != "und") & ~(ambiguous & (F.octet_length(text) >= enough))


def decode(code: Code, margins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest codeword, its share of belief, and the next one, from mean margins over n trigrams.

    Texts of more than 64 trigrams weigh as if they had 64, so that belief
    follows the evidence of a few words and not the length.
    """
    z = margins * np.minimum(n, 64)[:, None] / 4
    loss = np.stack([(code.alpha * np.logaddexp(0, -z * w)).sum(1) for w in code.words], 1)
    belief = np.exp(loss.min(1, keepdims=True) - loss)
    belief /= belief.sum(1, keepdims=True)
    order = np.argsort(-belief, axis=1, kind="stable")
    second = order[:, 1] if belief.shape[1] > 1 else order[:, 0]
    return order[:, 0], belief[np.arange(len(belief)), order[:, 0]], second


def identify(docs: DataFrame, code: Code, text: str = "text", keep: tuple[str, ...] = ("doc_id",), gap: float = 0.2) -> DataFrame:
    """The ``keep`` columns with lang_pred, score, runner_up and ambiguous.

    lang_pred is ``und``, with score 0, for null and empty texts, texts without
    a letter, and all texts if the training fold had no language. With one
    language known, it is that. Texts shorter than a trigram get equal beliefs,
    and ties go to the first language by code point. Ambiguous: the next
    language's belief comes within ``gap`` of the first's. Whole texts count,
    in chunks; one row a row of ``docs``, repeated ones too. Columns of docs
    other than ``keep`` and the text are not read; ``keep`` with a name of the
    results is an error.
    """
    shared = docs.sparkSession.sparkContext.broadcast(code)
    no_clash(keep, ("lang_pred", "score", "runner_up", "ambiguous"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        names = code.languages
        for batch in batches:
            raw, starts, ends = flat(batch.column(at))
            sums = np.zeros((len(starts), code.words.shape[1]))
            letters = np.zeros(len(starts), bool)
            for i, j in slices(starts, ends, CHUNK):
                for a in range(starts[i], max(ends[j - 1], starts[i] + 1), CHUNK):
                    b = min(a + CHUNK + 2, ends[j - 1])
                    part = raw[a:b]
                    if not len(part):
                        continue
                    rows = np.take(code.weights, trigrams(part), axis=0)
                    own_s, own_e = np.clip(starts[i:j] - a, 0, len(rows)), np.clip(np.minimum(ends[i:j] - 2, a + CHUNK) - a, 0, len(rows))
                    on = np.flatnonzero(own_e > own_s)
                    if len(on) and rows.shape[1]:
                        cuts = np.stack([own_s[on], own_e[on]], 1).ravel()
                        rows = np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])
                        sums[i + on] += np.add.reduceat(rows, cuts, axis=0)[::2]
                    has = np.concatenate([[0], np.cumsum(_ASCII_LETTER[part])])
                    letters[i:j] |= has[np.clip(ends[i:j] - a, 0, len(part))] > has[np.clip(starts[i:j] - a, 0, len(part))]
            for i in np.flatnonzero(~letters & (ends > starts)):
                letters[i] = bool(LETTER.search(raw[starts[i] : ends[i]].tobytes().decode("utf-8", "ignore")))
            n = np.maximum(ends - starts - 2, 0)
            if names:
                first, score, second = decode(code, sums / np.maximum(n, 1)[:, None], n) if len(names) > 1 else (np.zeros(len(n), int), np.ones(len(n)), np.zeros(len(n), int))
                near = (2 * score - 1 < gap) if len(names) > 1 else np.zeros(len(n), bool)
            else:
                letters[:] = False
                first, score, second, near = np.zeros(len(n), int), np.zeros(len(n)), np.zeros(len(n), int), np.zeros(len(n), bool)
            pick = lambda ids: pa.array([names[k] if ok else "und" for k, ok in zip(ids, letters, strict=True)], pa.string())
            cols = [batch.column(k) for k in range(len(keep))]
            yield pa.record_batch([*cols, pick(first), pa.array(np.where(letters, np.round(score, 9), 0.0)), pick(second), pa.array(np.where(letters, near, False))], names=[*keep, "lang_pred", "score", "runner_up", "ambiguous"])

    at = keep.index(text) if text in keep else len(keep)
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + ("," if keep else "") + " lang_pred string, score double, runner_up string, ambiguous boolean"
    return spread(rows).mapInArrow(run, schema)
