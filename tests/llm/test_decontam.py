from collections import Counter

import numpy as np

from merset.llm import decontam


def items_of(rng, prose, n):
    return [(i, f"{prose(int(rng.integers(16, 30))).capitalize()}. {prose(int(rng.integers(4, 9))).capitalize()}.") for i in range(n)]


def brute(docs, items, threshold, overlap, shingle):
    """BM25 of every passage against every item, without bounds."""
    texts = sorted({t for _, t in items if t and decontam.words_of(t.encode())})
    known = {t: (decontam.words_of(t.encode()), *decontam.parts_of(t.encode(), shingle)) for t in texts}
    df, mean, out = Counter(w for x in known.values() for w in set(x[0])), np.mean([len(x[0]) for x in known.values()]), {}
    for t, (words, question, answer) in known.items():
        w = {v: np.log(1 + (len(known) - df[v] + 0.5) / (df[v] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(words) / mean)) for v, c in Counter(words).items()}
        span, size = 32, len(next(iter(question)))
        while span < len(words):
            span *= 2
        for d, text in docs:
            all_words = decontam.words_of((text or "").encode())
            for at in range(0, len(all_words), span):
                own = all_words[at : at + 2 * span]
                score = sum(w.get(v, 0) for v in set(own)) / sum(w.values())
                there = {tuple(own[k : k + size]) for k in range(len(own) - size + 1)}
                q, a = len(question & there) / len(question), len(answer & set(own)) / len(answer)
                if score >= threshold and q >= overlap and a >= overlap:
                    for i in (i for i, x in items if x == t):
                        out[d, i] = max(out.get((d, i), (0, 0, 0)), (round(score, 9), round(q, 9), round(a, 9)))
    return out


def found_in(df, bench, **how):
    return {(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"], r["answer_overlap"]) for r in decontam.find_leaks(df, bench, **how).collect()}


def test_against_brute_force(spark, rng, prose):
    items = items_of(rng, prose, 60) + [(90, None), (91, ""), (92, "..."), (93, "Short one."), (94, "Repeat me well. Repeat me well."), (95, f"{prose(70)}. {prose(8)}."), (96, f"{prose(300)}. {prose(30)}.")]
    items += [(97, items[3][1]), (None, items[3][1])]
    docs = [(i, prose(int(rng.integers(1, 300)))) for i in range(60)]
    for k in range(20):
        text = items[k][1]
        if k % 3 == 0:
            text = text.upper().replace(" ", "  ")
        if k % 4 == 1:
            w = text.split()
            w[len(w) // 3] = "other"
            text = " ".join(w)
        docs.append((100 + k, f"{prose(int(rng.integers(0, 90)))} {text} {prose(int(rng.integers(0, 90)))}"))
    docs += [(300, None), (301, ""), (302, items[3][1]), (302, items[3][1]), (None, items[4][1]), (303, items[5][1] + " " + items[6][1]), (304, prose(4000) + " " + items[7][1]), (305, f"{prose(33)} {items[65][1]} {prose(50)}"), (306, f"{prose(700)} {items[66][1]}")]
    df = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, extra string")
    found = decontam.find_leaks(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"], r["answer_overlap"]) for r in found}
    want = brute(docs, items, 0.6, 0.5, 5)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert sum(r["doc_id"] == 302 for r in found) == 2 * len({k for k in want if k[0] == 302}) and {(100 + k, k) for k in range(20)} <= got.keys()
    assert {(305, 95), (306, 96), (302, 97), (302, None)} <= got.keys()
    for most in (12, 30):
        parts = found_in(df, bench, most_items=most)
        assert parts.keys() == got.keys() and all(np.allclose(got[k], parts[k], atol=2e-9) for k in got)
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0 and decontam.find_leaks(df.limit(0), bench).count() == 0


def test_what_is_found_depends_on_no_other_item(spark, prose):
    """Items whose answer stands far from the question are found or not, whatever other items and shards there are."""
    items = [(k, f"{prose(20)}. {prose(5)}.") for k in range(8)]
    apart = [(k, t.replace(". ", f". {prose(150)} ", 1)) for k, t in items]
    near = [(10 + k, t.replace(". ", f". {prose(6)} ", 1)) for k, t in items]
    df = spark.createDataFrame(apart + near, "doc_id long, text string")
    table = lambda rows: spark.createDataFrame(rows, "item_id long, text string")
    long_one = (50, f"{prose(580)}. {prose(20)}.")
    want = {(10 + k, k) for k in range(8)}
    for rows in (items, [*items, long_one]):
        assert found_in(df, table(rows)).keys() == brute(apart + near, rows, 0.6, 0.5, 5).keys() == want
        for most in (1, 3, 5):
            assert found_in(df, table(rows), most_items=most).keys() == want
