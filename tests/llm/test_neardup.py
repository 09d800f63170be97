import itertools

import numpy as np
import pytest

from merset.llm import neardup
from merset.llm.common import LOWER
from merset.llm.components import components


def shingles(text, words):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def roots_of(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(texts, words, percent):
    sets = [shingles(t, words) for t in texts]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return roots_of(len(texts), pairs), [len(s) for s in sets]


def near_group(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for k in rng.choice(len(w), int(rng.integers(0, most)), replace=False):
            w[k] = f"new{int(rng.integers(1 << 30))}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("width,percent,leaf,block", [(3, 85, 256, 1024), (5, 80, 256, 1024), (3, 85, 4, 12), (5, 80, 4, 12)])
def test_against_brute_force(spark, rng, prose, monkeypatch, width, percent, leaf, block):
    """Also with small nodes and blocks, so that all levels run and dense nodes are joined exactly."""
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "BLOCK", block)
    line = prose(30)
    texts = [prose(int(rng.integers(3, 80))) for _ in range(150)] + [line + " " + prose(40) for _ in range(60)]
    texts += near_group(rng, prose(120), 120, 9) + near_group(rng, prose(60), 8, 3) + [prose(25)] * 30
    texts += [None, "", " \n ", "one", "ONE", "one two", "One  Two\t", "é É", "a b c", prose(3000), "x " * 500]
    texts[5] = texts[200].upper()
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    want, sizes = brute(texts, width, percent)
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, cls string, component_id int")
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df, width, percent).collect()}
    assert {i: (r["component_id"], r["n_shingles"], r["kept"]) for i, r in got.items()} == {i: (want[i], sizes[i], want[i] == i) for i in range(len(texts))}
    assert sorted(r["doc_id"] for r in neardup.drop_near_duplicates(df, width, percent).collect()) == sorted(set(want))


def templated(prose, n, fixed=182, tail=20, both=5):
    """Texts of one template; those of a pair share part of the rest and are linked, no others are."""
    template, texts = prose(fixed), []
    for k in range(n // 2):
        same = " ".join(f"s{k}x{i}" for i in range(both))
        texts += [f"{template} {same} " + " ".join(f"t{k}y{side}z{i}" for i in range(tail - both)) for side in range(2)]
    return texts


@pytest.mark.parametrize("n,leaf,block", [(600, 4, 16), (3000, 256, 1024)])
def test_links_within_a_template_are_found(spark, prose, monkeypatch, n, leaf, block):
    monkeypatch.setattr(neardup, "LEAF", leaf)
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = templated(prose, n)
    sets = [shingles(t, 3) for t in (texts[0], texts[1], texts[2])]
    like = lambda a, b: 100 * len(a & b) / len(a | b)
    assert like(sets[0], sets[1]) >= 85 > like(sets[0], sets[2])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert got == {i: i - i % 2 for i in range(n)}


@pytest.mark.parametrize("pairs_a_row", [1 << 13, 20])
def test_filled_in_forms_are_compared_in_full(spark, rng, prose, monkeypatch, pairs_a_row):
    """24 slots of four values, five of them changed in a pair; branching multiplies rows there. With few pairs a row, nodes branch once before."""
    monkeypatch.setattr(neardup, "BLOCK", 64)
    monkeypatch.setattr(neardup, "TILE", 100)
    monkeypatch.setattr(neardup, "PAIRS_A_ROW", pairs_a_row)
    n, rows, template, texts = 700, {}, prose(250).split(), []
    for _ in range(n // 2):
        x = rng.integers(0, 4, 24)
        y = x.copy()
        k = rng.choice(24, 5, replace=False)
        y[k] = (y[k] + rng.integers(1, 4, 5)) % 4
        for values in (x, y):
            words = list(template)
            for slot, v in enumerate(values):
                words[5 + 10 * slot] = f"v{slot}x{v}"
            texts.append(" ".join(words))
    cut = neardup.cut

    def counted(df, tag):
        out = cut(df, tag)
        if tag in ("dense-children", "dense-full"):
            rows.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "cut", counted)
    want, _ = brute(texts, 3, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 3, 85).collect()} == dict(enumerate(want))
    assert sum(rows["dense-full"]) >= 1 and max(rows["dense-children"]) <= 30 * n


def test_nodes_of_the_same_classes_are_merged(spark):
    rows = [(1, k) for k in range(40)] + [(2, k) for k in range(1, 39)] + [(3, k) for k in range(30, 90)] + [(4, k) for k in range(200, 230)]
    size = {1: 40, 2: 38, 3: 60, 4: 30}
    df = spark.createDataFrame([(g, bytes([k]), 7, size[g]) for g, k in rows], "node long, cls binary, n long, size long")
    nodes = {}
    for r in neardup.merge_nodes(df).collect():
        nodes.setdefault(r["node"], []).append(r["cls"][0])
        assert r["total"] == 7 * r["size"]
    assert sorted(sorted(x) for x in nodes.values()) == [list(range(40)), list(range(30, 90)), list(range(200, 230))]


def test_two_templates_and_near_copies_of_one(spark, rng, prose, monkeypatch):
    """A dense node with two templates, pairs in each, and copies with words missing."""
    monkeypatch.setattr(neardup, "LEAF", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    shared = prose(100)
    texts = [f"{shared} {t}" for t in templated(prose, 160, 120, 20, 6) + templated(prose, 100, 140, 24, 8)] + near_group(rng, f"{shared} {prose(140)}", 80, 14)
    want, _ = brute(texts, 3, 85)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, 3, 85).collect()} == dict(enumerate(want))


def test_null_and_repeated_ids(spark, prose):
    a, b = prose(50), prose(50)
    df = spark.createDataFrame([(None, a), (7, a), (7, a), (3, b), (3, a), (None, "zzz yyy"), (None, None)], "doc_id long, text string")
    got = sorted(map(str, ((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(None, 3, False), (7, 3, False), (7, 3, False), (3, 3, True), (3, 3, True), (None, None, True), (None, None, True)]))
    assert neardup.near_duplicates(df.limit(0)).count() == 0 and neardup.drop_near_duplicates(df.limit(0)).count() == 0
    assert neardup.drop_near_duplicates(df).count() == 4


def test_components(spark, rng):
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(500, k) for k in range(501, 700)] + [(k, k + 1) for k in range(800, 860)] + [(5, 5)]
    want = roots_of(900, pairs)
    got = {r["vertex"]: r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: want[x] for x in {y for a, b in pairs if a != b for y in (a, b)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sketch_estimates_similarity(rng):
    a = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:4000], rng.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    x, y = (np.frombuffer(neardup.sketch(s), "<u4") for s in (a, b))
    assert abs((x == y).mean() - true) < 0.25
