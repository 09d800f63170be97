import hashlib
import re

import pytest

from merset.llm.mixture import mix_sources


def brute(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    w = {s: weights[i % 3] for i, s in enumerate(sources)}
    target, free, rest = {}, set(sources), share * sum(total.values())
    while free:
        level = rest / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] >= most * total[s]}
        for s in over or free:
            target[s] = most * total[s] if over else level * w[s]
        rest -= sum(target[s] for s in over)
        free = free - over if over else set()
    return total, target


def test_budgets_caps_and_ties(spark, prose, rng):
    rows = [(i, prose(int(rng.integers(0, 60))), ["b", "a", "c", None, "é"][int(i % 9) % 5]) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "b"), (None, "x y", "c"), (5, rows[5][1], rows[5][2]), (1002, "word " * 3000, "a")]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, source string, size int, bucket string")
    got = mix_sources(df).collect()
    total, target = brute(rows)
    assert len(got) == len(rows)
    for s in total:
        own = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in own} == {total[s]} and all(r["target"] == pytest.approx(target[s]) for r in own)
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 0.5
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, mix_sources(df.repartition(7)).collect())) == sorted(map(str, got))


def test_order_is_by_hash(spark):
    df = spark.createDataFrame([(i, "a b c d", "s") for i in range(50)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["taken"] for r in mix_sources(df, share=1.25).collect()}
    keys = sorted(got, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    assert [got[i] for i in keys] == sorted(got.values(), reverse=True) and sum(got.values()) == 250


def test_rows_of_one_id_are_cut_too(spark, rng):
    """A third of the rows without an id, many alike: budgets are met with up to five rows summed one by one in a task."""
    rows = [(None, "a b " * int(rng.integers(1, 4)), "s") for i in range(120)] + [(i, "c " * int(rng.integers(1, 9)), ["s", "t"][i % 2]) for i in range(200)] + [(7, "d e f", "t")] * 90
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total, target = brute(rows)
    few, many = (mix_sources(df, most_rows=n).collect() for n in (5, 50_000))
    for s in total:
        assert abs(sum(r["taken"] for r in few if r["source"] == s) - target[s]) <= 0.5
    assert sorted(map(str, few)) == sorted(map(str, many))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(df).count() == 0
    none = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mix_sources(none).collect()] == [(0, 0.0)] * 2
