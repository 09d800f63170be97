import numpy as np

from merset.llm import language

SAMPLES = {"en": "the house and the river were in the old town that we have seen with them", "de": "das haus und der fluss waren in der alten stadt die wir mit ihnen gesehen haben", "fr": "la maison et la rivière étaient dans la vieille ville que nous avons vue avec eux"}


def corpus(rng, n):
    return [(i, " ".join(rng.choice(SAMPLES[x].split(), int(rng.integers(3, 40)))), x, "s") for i in range(n) for x in [list(SAMPLES)[i % 3]]]


def test_held_out_accuracy_and_edge_cases(spark, rng):
    rows = corpus(rng, 600)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    code = language.fit(df.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in language.identify(df.where("doc_id % 5 = 0"), code).collect()}
    assert np.mean([got[i]["lang_pred"] == x for i, _, x, _ in rows if i % 5 == 0]) > 0.97
    odd = [(1, None), (2, ""), (3, "123 -- 4_5"), (4, "é"), (5, "the river " * 200000), (5, "the river " * 200000), (6, "Ⅷ"), (7, "中文")]
    told = language.identify(spark.createDataFrame(odd, "doc_id long, text string"), code).collect()
    by = {r["doc_id"]: r for r in told}
    assert len(told) == len(odd) and [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by[1]["score"] == 0
    assert by[5]["lang_pred"] == "en" and by[5]["score"] > 0.99 and not by[5]["ambiguous"]
    assert by[4]["lang_pred"] in SAMPLES and by[7]["lang_pred"] in SAMPLES and by[6]["lang_pred"] == "und"
    kept = language.identify(df, code, keep=("doc_id", "text", "lang"))
    assert kept.columns[:3] == ["doc_id", "text", "lang"] and kept.where("text is null").count() == 0


def test_chunks_do_not_matter(rng, monkeypatch, spark):
    df = spark.createDataFrame(corpus(rng, 60), "doc_id long, text string, lang string, source string")
    code = language.fit(df)
    text = " ".join(SAMPLES.values()) * 50
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = code.weights[language.trigrams(raw)].sum(0)
    parts = sum(code.weights[language.trigrams(raw[a : a + 102])].sum(0) for a in range(0, len(raw), 100))
    assert np.allclose(whole, parts, rtol=1e-4)


def test_few_languages(spark):
    one = spark.createDataFrame([(1, "abc", "en"), (2, None, "de"), (3, "x", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(one.where("doc_id = 1"), language.fit(one)).collect()} == {"en"}
    none = language.fit(one.limit(0))
    assert [r["lang_pred"] for r in language.identify(one, none).collect()] == ["und"] * 3
    assert language.identify(one.limit(0), none).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 6, 7, 40):
        c = language.codewords(n)
        apart = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
        assert apart >= (1 if n < 3 else 2) and (np.abs(c.sum(0)) < n).all()


def test_decoding_against_brute_force(spark, prose, rng):
    """Every text by plain sums, one trigram and codeword at a time."""
    letters = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "pqrstuvw", "dd": "aeimquyz"}
    made = lambda lang, n: " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(n))
    rows = [(i, made(lang, int(rng.integers(1, 40))), lang) for i in range(40) for lang in letters]
    rows += [(900, "ab hi", None), (901, "", "aa"), (902, "12 34", None), (903, None, "bb"), (904, "a", "aa"), (905, "\u4e16\u754c", None), (906, made("aa", 3) + made("bb", 3), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    code = language.fit(df)
    counts = {lang: {} for lang in letters}
    hashed = lambda raw: [int(language._T[0][a] ^ language._T[1][b] ^ language._T[2][c]) for a, b, c in zip(raw, raw[1:], raw[2:], strict=False)]
    for _, text, lang in rows:
        for f in hashed((text or "").encode()) if lang else ():
            counts[lang][f] = counts[lang].get(f, 0) + 1
    share = lambda lang, f: (counts[lang].get(f, 0) + 0.5) / (sum(counts[lang].values()) + 0.5 * 2**14)
    names, words = sorted(letters), language.codewords(4)
    assert code.languages == names
    side = lambda f, b, sign: np.mean([share(x, f) for x, w in zip(names, words, strict=True) if w[b] == sign])
    got = {(r["doc_id"], r["lang_pred"]): r for r in language.identify(df, code).collect()}
    for i, text, _ in rows:
        raw, seen = (text or "").encode(), hashed((text or "").encode())
        if not any(c.isalpha() for c in text or ""):
            assert got[i, "und"]["score"] == 0
            continue
        z = [sum(np.log(side(f, b, 1) / side(f, b, -1)) for f in seen) / max(len(seen), 1) * min(len(seen), 64) / 4 for b in range(words.shape[1])]
        loss = [sum(a * np.logaddexp(0, -x * w) for a, x, w in zip(code.alpha, z, word, strict=True)) for word in words]
        belief = np.exp(min(loss) - np.array(loss))
        belief /= belief.sum()
        best = int(np.argmin(loss))
        r = got[i, names[best]]
        assert abs(r["score"] - belief[best]) < 1e-4 and r["ambiguous"] == (2 * r["score"] - 1 < 0.2)
