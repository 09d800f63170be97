import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from merset.llm import lm
from merset.llm.common import LOWER


def base(rows, train):
    tokens = [(t or "").encode().translate(LOWER).split() for _, t in rows]
    c, ends = Counter(), 0
    for i, w in enumerate(tokens):
        if train(rows[i][0]):
            c.update(w)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    cost = lambda x: math.log10((x + 1) / (n + v + 1))
    return [(len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n, sum(cost(c[x]) for x in w) + cost(ends)) for w in tokens]


def test_scores(spark, prose, rng):
    rows = [(i, prose(int(rng.integers(1, 120)))) for i in range(200)] + [(900, None), (901, ""), (902, "Unseen Wörds\x0bhere"), (902, "Unseen Wörds\x0bhere"), (903, prose(30000)), (None, "null id"), (904, "a\x00b")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, score int")
    got = lm.score_texts(df, F.col("doc_id") % 4 != 1, block_bytes=20_000).collect()
    want = base(rows, lambda i: i is not None and i % 4 != 1)
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for (i, t), w in zip(rows, want, strict=True):
        r = by[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and r["base_score"] == pytest.approx(w[3])
        assert r["total_bits"] == pytest.approx(-r["score"] * math.log2(10), abs=1e-2)
        assert r["bits_per_byte"] == pytest.approx(r["total_bits"] / (len((t or "").encode()) + 1), abs=1e-3)
    held = [by[i] for i, t in rows if i and i < 900 and i % 4 == 1]
    assert sum(r["total_bits"] for r in held) < 0.4 * 8 * sum(len(t) for i, t in rows if i and i < 900 and i % 4 == 1)
    assert len({r["score"] for r in got if r["doc_id"] == 902}) == 1


def made_model(rng, text=b"the cat sat on the mat, and that was that. "):
    """A code and random tables with every class of gate."""
    code = lm.code_of(np.bincount(np.frombuffer(text, np.uint8), minlength=256))
    tables = [rng.integers(-60, 60, 1 << (b + lm.CELL_BITS), dtype=np.int64).astype(np.int8) for b in lm.SLOT_BITS]
    for t in tables:
        t[:: 1 << lm.CELL_BITS] = rng.integers(0, len(lm.SEEN) + 1, len(t) >> lm.CELL_BITS)
    return code, tables, rng.uniform(0, 0.6, (lm.GATES, len(tables)))


def laid_out(texts):
    ends = np.cumsum([len(t) for t in texts])
    return lm._laid_out(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends)


def test_code_is_prefix_free():
    """Codes of 256 bytes share a node exactly up to where they part, and fill the tree."""
    code = lm.code_of(np.array([10_000 if b == 101 else b % 7 for b in range(256)]))
    assert sum(2.0 ** -int(n) for n in code.length) == 1 and code.length[101] == code.length.min()
    paths = {tuple(code.sign[: code.length[b], b]) for b in range(256)}
    assert len(paths) == 256 and not any(p[:k] in paths for p in paths for k in range(len(p)))


def test_probabilities_add_up(rng):
    """Over all next bytes, given a text, the model's probabilities add up to one."""
    code, tables, start = made_model(rng)
    total = 0.0
    for byte in range(256):
        data, first, last = laid_out([b"ab?"])
        data[first[0] + 2] = byte
        total += math.exp(-lm.byte_nats(data, first, last, code, tables, start)[2])
    assert total == pytest.approx(1, abs=1e-4)


def slot(value, bits):
    return (value * 0x9E3779B1 % 2**32) >> (32 - bits)


def brute_bytes(text, code, tables, start):
    """Cost of each byte of a text and its end, bit by bit; weights change where a block has ended."""
    data = [32] * 5 + list(text.lower()) + [lm.END]
    weights, bits, costs = start / lm.SCALE, np.zeros(lm.GATES), []
    done, size, steps, coded = 0, lm.FIRST_BLOCK, np.zeros_like(start), np.zeros(lm.GATES)
    for i in range(5, len(data)):
        a, b, c, d, e = data[i - 5 : i]
        word = 0
        for x in data[:i]:
            word = 0 if x in b" \t\n\v\f\r" else (word * 0x9E3779B97F4A7C15 + x + 1) % 2**64
        three = c << 16 | d << 8 | e
        five = ((three | b << 24) * 0x85EBCA6B % 2**32) ^ (a * 0xC2B2AE35 % 2**32)
        rows = [slot(v, n) << lm.CELL_BITS for v, n in zip((d << 8 | e, three, five, word >> 32), lm.SLOT_BITS, strict=True)]
        gate = int(tables[2][rows[2]]) * (len(lm.SEEN) + 1) + int(tables[3][rows[3]])
        cost = 0.0
        for k in range(int(code.length[data[i]])):
            x = np.array([float(t[r + code.cell[k, data[i]]]) for t, r in zip(tables, rows, strict=True)])
            wrong = 1 / (1 + math.exp(code.sign[k, data[i]] * float(weights[gate] @ x)))
            cost -= math.log(1 - wrong)
            steps[gate] += wrong * code.sign[k, data[i]] * x
            coded[gate] += 1
        costs.append(cost)
        if len(costs) == done + size:
            bits += coded
            weights = weights + steps / (lm.SCALE**2 * (lm.STIFF + lm.GAIN * bits))[:, None]
            done, size, steps, coded = done + size, min(2 * size, lm.LAST_BLOCK), np.zeros_like(start), np.zeros(lm.GATES)
    return costs


def brute_words(text, costs, counts, seen):
    """Cost of a text once its words are mixed with their counts' shares."""
    parts, word, at = [], b"", 0
    for i, x in enumerate([*text.lower(), lm.END]):
        if x in b" \t\n\v\f\r" or x == lm.END:
            share = counts.get(word, 0) / seen[256] * seen[x] / sum(seen[y] for y in [*b" \t\n\v\f\r", lm.END]) if word else 0.0
            parts.append((math.exp(-sum(costs[at : i + 1])), share))
            word, at = b"", i + 1
        else:
            word += bytes([x])
    a, b = lm.BELIEF
    shares = [a / (a + b)] * len(parts)
    for _ in range(lm.ROUNDS):
        right = [s * q / (s * q + (1 - s) * p) for s, (p, q) in zip(shares, parts, strict=True)]
        shares = [(a + sum(right[:k])) / (a + b + k) for k in range(len(parts))]
    return -sum(math.log((1 - s) * p + s * q) for s, (p, q) in zip(shares, parts, strict=True))


def test_costs_against_brute_force(rng, prose, monkeypatch):
    monkeypatch.setattr(lm, "LAST_BLOCK", 64)
    code, tables, start = made_model(rng)
    texts = [b"", b"x", b" ", b"The cat", b"a  b\n", "é Übung\tß".encode(), prose(30).encode(), prose(90).encode(), b"ab" * 100]
    data, first, last = laid_out(texts)
    nats = lm.byte_nats(data, first, last, code, tables, start)
    for t, a, b in zip(texts, first, last, strict=True):
        assert nats[a - 5 : b - 5] == pytest.approx(brute_bytes(t, code, tables, start), rel=1e-3, abs=1e-3)
    counts = {w: int(rng.integers(0, 50)) for t in texts for w in t.lower().split()}
    seen = np.append(rng.integers(1, 100, 256), 5000)
    whole = lm.mixed_nats(data, first, last, nats, np.array([counts[w] for t in texts for w in t.lower().split()], float), seen)
    for t, x in zip(texts, whole, strict=True):
        assert x == pytest.approx(brute_words(t, brute_bytes(t, code, tables, start), counts, seen), rel=1e-3, abs=1e-3)


def test_fitted_weights_beat_even_ones(rng, prose):
    """On the texts they are fitted on, and by the likelihood they maximise."""
    code, tables, _ = made_model(rng)
    texts = [prose(60).encode() for _ in range(20)]
    ends = np.cumsum([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    w = lm.fit_weights(raw, ends - [len(t) for t in texts], ends, code, tables)
    cost = lambda w: float(lm.byte_nats(*laid_out(texts), code, tables, w, []).sum())
    assert cost(w) < cost(np.full_like(w, 1.2 / w.shape[1]))


def test_counts_in_many_tasks_are_merged(spark, prose, monkeypatch):
    """Counts are those of all texts, however many tasks and merges they come through."""
    df = spark.createDataFrame([(prose(30),) for _ in range(90)], "text string").repartition(9).withColumn("fit", F.lit(False))
    tables = []
    for fan in (64, 2):
        monkeypatch.setattr(lm, "FAN", fan)
        counts = lm.context_counts(df, F.col("fit"), most=2_000)
        cells = Counter()
        for r in counts.collect():
            for c, n in zip(*lm._unpack(bytes(r["cells"])), strict=True):
                cells[r["table"], int(c)] += int(n)
        tables.append(+cells)
    assert tables[0] == tables[1] and tables[0][-1, 256] == 90 * 30 and tables[0][-1, lm.END] == 90


def test_no_training_and_empty(spark):
    df = spark.createDataFrame([(1, "abc d"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score_texts(df, F.lit(False)).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and got[1]["total_bits"] == pytest.approx(48) and got[2]["total_bits"] == pytest.approx(8)
    assert lm.score_texts(df.limit(0), F.lit(True)).count() == 0


def test_all_bytes_are_predicted(spark, rng):
    """Digits and letters of other scripts, too, cost less the more of them is trained on."""
    for words in (["0123456789", "<tag>", "[31]", "2024@{7}"], ["слово", "мир", "город", "дом"], ["世界", "人民", "大学", "中国"]):
        line = lambda: " ".join(rng.choice(words, 60))  # noqa: E731, B023
        df = spark.createDataFrame([(i, line()) for i in range(60)], "doc_id long, text string")
        held = [r for r in lm.score_texts(df, F.col("doc_id") >= 20).collect() if not r["train"]]
        assert len(held) == 20 and max(r["bits_per_byte"] for r in held) < 1.5


def brute_sums(texts, others, code, tables, start):
    """Cost, gradient and curvature by gate, bit by bit."""
    k = len(lm.SLOT_BITS)
    cost, slope, curve = 0.0, np.zeros((lm.GATES, k)), np.zeros((lm.GATES, k, k))
    for t, other in zip(texts, others, strict=True):
        seen = []
        lm.byte_nats(*laid_out([t]), code, tables[:k] if other else tables[k:], start, seen)
        for x, sign, gate in seen:
            for v, s, g in zip(x.astype(float), sign, gate, strict=True):
                wrong = 1 / (1 + math.exp(s * float(start[g] @ v) / lm.SCALE))
                cost, slope[g], curve[g] = cost - math.log(1 - wrong), slope[g] + wrong * s * v, curve[g] + wrong * (1 - wrong) * np.outer(v, v)
    return cost, slope, curve


def test_newton_sums_against_brute_force(rng, prose, monkeypatch):
    """Over all bits of both halves; the same whole numbers in any order and in parts."""
    code, tables, start = made_model(rng)
    tables = tables + made_model(rng)[1]
    texts = [b"", b"x", b"The cat  ", prose(60).encode(), b"ab" * 400, prose(20).encode(), "é Übung".encode()]
    others = np.array([True, False, False, True, False, False, True])
    got = lm.newton_sums(*laid_out(texts), others, code, tables, start)
    cost, slope, curve = brute_sums(texts, others, code, tables, start)
    assert got[:, 0].sum() / lm.FINE == pytest.approx(cost, rel=1e-4) and got[:, 1].sum() == sum(int(code.length[b]) for t in texts for b in [*t.lower(), lm.END])
    assert got[:, 2:6] / lm.FINE == pytest.approx(slope, rel=1e-3, abs=0.2) and (got[:, 6:] / lm.FINE).reshape(curve.shape) == pytest.approx(curve, rel=1e-3, abs=2)
    assert sum(int(n) for n in lm.newton_sums(*laid_out(texts[::-1]), others[::-1], code, tables, start).ravel() - got.ravel()) == 0
    monkeypatch.setattr(lm, "ALIKE_BITS", 6)
    assert (lm.newton_sums(*laid_out(texts), others, code, tables, start) == got).all()


def test_words_go_on_over_stretches(prose, monkeypatch):
    data, _, _ = laid_out([prose(40).encode(), b"w" * 300, b"", prose(3).encode()])
    want = lm._slots(data)
    for size in (7, 64):
        monkeypatch.setattr(lm, "STRETCH", size)
        assert all((a == b).all() for a, b in zip(lm._slots(data), want, strict=True))


def test_all_training_texts_are_learned_from(spark, prose, rng, monkeypatch):
    """Tables count every training text, and weights are the best for all of them, however little the fit starts from and however long a text is."""
    rows = [(prose(int(rng.integers(20, 80))),) for _ in range(150)] + [("digits " + " ".join(map(str, rng.integers(0, 10**9, 4000))),), ("".join(rng.choice(list("acgt "), 40_000)),), (None,), ("",)]
    df = spark.createDataFrame(rows, "text string")
    models = []
    for little, some in ((1e-9, 1 << 18), (1e-9, 1), (1e-3, 1 << 14)):
        monkeypatch.setattr(lm, "FIT_BYTES", some)
        monkeypatch.setattr(lm, "LITTLE", little)
        models.append(lm.learn(df))
    assert models[0].pieces == models[1].pieces == models[2].pieces
    assert models[0].start == pytest.approx(models[1].start, abs=1e-3) and models[0].start == pytest.approx(models[2].start, abs=0.1)
    data, first, last = laid_out([r[0].encode() for r in rows if r[0] is not None])
    seen = np.zeros(1 << lm.SLOT_BITS[0], np.int64)
    np.add.at(seen, lm._slots(data)[0][lm._coded(data, first, last)], 1)
    assert (lm.unpack(-99, models[0].pieces)[0][:: 1 << lm.CELL_BITS] == np.searchsorted(lm.SEEN, seen, side="right")).all()


def test_one_logarithm_for_several_bits(rng, prose, monkeypatch):
    """A byte's bits cost about one logarithm, not one each."""
    code, tables, start = made_model(rng)
    data, first, last = laid_out([prose(90).encode() for _ in range(5)])
    sizes, log = [], np.log
    monkeypatch.setattr(np, "log", lambda x, *a, **k: (sizes.append(np.size(x)), log(x, *a, **k))[1])
    lm.byte_nats(data, first, last, code, tables, start)
    n = int((last - first).sum())
    assert n <= sum(sizes) < 0.6 * code.length[data[data != 32]].sum() and sum(sizes) < 2 * n


def test_layout_and_packing(rng):
    """Texts with bytes between them, or in any order, are laid out as ones that follow each other; packed counts come back whole."""
    texts = [b"", b"Ab c", b"x", b"", "Übung\n".encode()]
    raw = np.frombuffer(b"??Ab c--x" + "Übung\n".encode(), np.uint8)
    starts = np.array([1, 2, 8, 3, 9])
    got = lm._laid_out(raw, starts, starts + [len(t) for t in texts])
    assert all((a == b).all() for a, b in zip(got, laid_out(texts), strict=True))
    for n in (0, 1, 5000):
        cells, counts = np.unique(rng.integers(0, 1 << 26, n).astype(np.uint32)), rng.integers(1, 1 << 40, n)
        got = lm._unpack(lm._pack(cells, counts[: len(cells)]))
        assert (got[0] == cells).all() and (got[1] == counts[: len(cells)]).all()
