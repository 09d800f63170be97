import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_entry import check
from test_neardup import brute

from merset.llm import jaccard
from merset.llm.jaccard import _folded, _may_link, band_of, bitmap, ngram_components
from merset.llm.queries import ORACLES, op11_ngram_jaccard


def edited(rng, text, most, words):
    w = text.split()
    for k in rng.choice(len(w), int(rng.integers(0, most + 1)), replace=False):
        w[k] = str(rng.choice(words))
    return " ".join(w)


def found(spark, texts, words, percent):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = ngram_components(docs, words, percent).orderBy("doc_id").collect()
    return [r.component_id for r in rows], [r.n_shingles for r in rows]


@pytest.fixture(scope="module")
def corpus(rng, words, prose):
    """Copies, groups of near copies of many sizes around the threshold, texts that share a long passage, and odd ones."""
    shared = prose(60)
    out = [None, "", " \t\n", "One", "one", "a b", "A\tb ", "é É", "x" * 200_000]
    for n, most in ((30, 1), (80, 4), (200, 12), (900, 40)):
        base = prose(n)
        out += [edited(rng, base, most, words) for _ in range(40)]
    out += [f"{prose(int(rng.integers(5, 60)))} {shared}" for _ in range(120)]
    out += [prose(int(rng.integers(1, 300))) for _ in range(150)]
    out += [t for t in out[10:60]]
    return out


def test_query_agrees_with_sql(spark, sf_dir):
    check(spark, sf_dir, op11_ngram_jaccard, ORACLES["op11_ngram_jaccard"])


@pytest.mark.parametrize("block,wide,percent", [(1024, 1 << 20, 85), (8, 1 << 20, 85), (1024, 900, 60)])
def test_components_equal_brute_force(spark, corpus, monkeypatch, block, wide, percent):
    """Also where groups are cut into many tiles, by members and by shingles."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "WIDE", wide)
    assert found(spark, corpus, 4, percent) == brute(corpus, 4, percent)


def test_texts_of_one_template(spark, rng, monkeypatch):
    """Forms with 24 slots of four values: few are linked, nearly all share groups; planted pairs differ in few slots."""
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    monkeypatch.setattr(jaccard, "CENTRES", 1)
    frame = [f"w{i}" for i in range(250)]
    slots = rng.integers(0, 4, (600, 24))
    for i in range(0, 120, 2):
        slots[i + 1] = slots[i]
        for k in rng.choice(24, 1 + i % 8, replace=False):
            slots[i + 1, k] = (slots[i, k] + 1) % 4
    texts = []
    for row in slots:
        w = list(frame)
        for k, v in enumerate(row):
            w[10 * k + 5] = f"s{k}v{v}"
        texts.append(" ".join(w))
    assert found(spark, texts, 4, 85) == brute(texts, 4, 85)


def test_bit_counts_bound_overlaps(rng):
    """No pair that is linked is held back, at any widths."""
    sets = []
    for n in (1, 2, 20, 64, 65, 70, 300, 340, 5000, 5600):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets += [s, np.unique(np.concatenate([s[: max(1, int(n * 0.93))], rng.integers(0, 1 << 63, n // 25, dtype=np.uint64)]))]
    n, bits = np.array([len(s) for s in sets]), pa.array([bitmap(s) for s in sets], pa.binary())
    every = np.arange(len(sets))
    told = {(i, j) for x, y in _may_link(bits, n, 80, every, every) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    for i in every:
        for j in every:
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (n[i] + n[j] - both):
                assert (i, j) in told
            small = min(len(bits[int(i)].as_py()), len(bits[int(j)].as_py())) * 8
            apart = np.bitwise_count(_folded(np.frombuffer(bits[int(i)].as_py(), np.uint8)[None], small) ^ _folded(np.frombuffer(bits[int(j)].as_py(), np.uint8)[None], small)).sum()
            assert apart <= n[i] + n[j] - 2 * both
    assert len(told) < len(sets) ** 2 / 3


@pytest.mark.parametrize("percent", [50, 80, 85, 99, 100])
def test_linked_sizes_are_in_neighbouring_bands(spark, percent):
    band = {r.n: r.b for r in spark.range(1, 3000).select(F.col("id").alias("n"), band_of(F.col("id"), percent).alias("b")).collect()}
    for n in band:
        most = min(2999, n * 100 // percent)
        assert band[n] <= band[most] <= band[n] + 1


def test_null_and_repeated_ids_extra_columns_and_empty_tables(spark, prose):
    a, b = prose(40), prose(50)
    rows = [(None, a), (5, a), (5, a), (5, b), (None, None), (7, ""), (3, b + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("cls", "n_shingles", "component_id", "part", "token")})
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_components(docs, 4, 85).collect())
    assert got == sorted([("None", 37, "5"), ("5", 37, "5"), ("5", 37, "5"), ("5", 47, "3"), ("None", 0, "None"), ("7", 0, "7"), ("3", 48, "3")])
    assert ngram_components(docs.limit(0), 4, 85).isEmpty()
    alone = spark.createDataFrame([("x", "only one text")], "doc_id string, text string")
    assert [tuple(r) for r in ngram_components(alone).collect()] == [("x", 1, "x")]
    with pytest.raises(ValueError):
        ngram_components(docs, 4, 0)
