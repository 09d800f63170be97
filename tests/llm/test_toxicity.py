import pytest
import numpy as np
from merset.llm import toxicity
from merset.llm.toxicity import folded


def test_folding():
    assert folded("Yоu 1D10T!! ｉｄｉｏｔ stu​pid @ss a$$et".encode()) == [b"you", b"idiot", b"idiot", b"stupid", b"ss", b"asset"]
    assert folded(b"\xff\xfe ok") and folded(b"") == []


def made(rng, prose, n):
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = prose(int(rng.integers(20, 200)))
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(int(rng.integers(0, len(w))), ["zorgat", "Z0rgat", "blixxen!"][int(rng.integers(0, 3))])
            text = " ".join(w)
        elif i % 7 == 0:
            text += " mount blixxen " + prose(5)
        docs.append((i, text))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_and_exceptions(spark, rng, prose):
    docs, labels = made(rng, prose, 700)
    d = spark.createDataFrame([(*x, 0.5) for x in docs], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (99999, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(d, lab.where("doc_id % 4 <> 0"), least_weight=1.0)
    assert any(k.startswith(b"zorg") for k in lexicon.weights) and b"mount blixxen" in lexicon.exceptions
    got = {r["doc_id"]: r for r in toxicity.score_texts(d, lexicon).collect()}
    held = [i for i in range(700) if i % 4 == 0]
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in held) / len(held) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "ZORGAT " * 50000), (3, "ZORGAT " * 50000), (4, "zоrgat")], "doc_id long, text string")
    told = [(r["doc_id"], r["predicted"]) for r in toxicity.score_texts(odd, lexicon).collect()]
    assert sorted(told) == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 1)]
    assert toxicity.score_texts(odd.limit(0), lexicon).count() == 0


def test_one_kind_of_label(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    lexicon = toxicity.learn(d, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert {r["predicted"] for r in toxicity.score_texts(d, lexicon).collect()} == {0}


def brute_total(words, weights, exceptions):
    """The longest lexicon entry at each word, unless the word lies in an exception phrase that it does not begin after."""
    total = 0.0
    for i, w in enumerate(words):
        best = max((k for k in weights if (w + b" ").startswith(k)), key=len, default=None)
        rest = b" ".join(words[i:]) + b" "
        spared = any(rest.startswith(p) for p in exceptions) or (i and any((words[i - 1] + b" " + rest).startswith(p) for p in exceptions))
        total += weights[best] if best is not None and not spared else 0
    return total


def test_matching_against_brute_force(rng):
    weights = {b"bad": 3.0, b"badly": 1.5, b"worse ": 2.0, b"cur": 4.0, b"curse": 5.0}
    exceptions = {b"not bad", b"the curse"}
    automaton = toxicity.Lexicon(weights, exceptions, np.zeros(4)).automaton()
    vocabulary = [b"bad", b"badly", b"badge", b"worse", b"worsen", b"cur", b"curse", b"cursed", b"not", b"the", b"a", b"xbad"]
    for _ in range(300):
        words = [vocabulary[i] for i in rng.integers(0, len(vocabulary), int(rng.integers(0, 12)))]
        total = brute_total(words, weights, exceptions)
        got = toxicity.features(words, automaton)
        assert got == (np.log1p(total), np.log1p(100 * total / max(len(words), 20)), np.log1p(len(words)))


def test_repeated_labels_and_clashes(spark, prose):
    docs = spark.createDataFrame([(i, prose(20) + (" rotten" if i % 2 else "")) for i in range(40)] + [(1, "rotten " + prose(9))] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 5 + [(None, 1), (3, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    once = toxicity.learn(docs, labels.distinct())
    assert lexicon.weights == once.weights and np.allclose(lexicon.curve, once.curve) and any(k.startswith(b"rot") for k in lexicon.weights)
    with pytest.raises(ValueError):
        toxicity.score_texts(docs.withColumn("Score", docs["doc_id"]), lexicon, keep=("doc_id", "Score"))
