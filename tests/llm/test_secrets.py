import re

from merset.llm import secrets

PATTERNS = {"assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), "access": (r"AKIA[A-Z0-9]+", 0, 18), "hex": (r"[0-9a-f]+", 0, 16)}
TEXTS = [
    None, "", "nothing", "token = 'abcdefghijkl'", "TOKEN=abcdefghijk", "token=secret: abcdefghijklmnop", "token=ab secret=abcdefghijkl", "apikey:0123456789abcdef0 api_KEY : \"zzzzzzzzzzzzzz\"",
    "é token=" + "deadbeef" * 4 + " AKIA" + "A1" * 8 + " AKIAAKIA12 " + "f" * 15 + " " + "f" * 16, "passwd=pass.word=token=xxxxxxxxxxxxxxxx", "toKen=aaaaaaaaaaaaaaaa ſecret=bbbbbbbbbbbbbbbb", "x" * 300000 + "secret=" + "0" * 20,
]


def brute(text):
    out = []
    for rank, (kind, (p, g, n)) in enumerate(PATTERNS.items()):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text or "") if len(m[g]) >= n]
    return [s for _, _, s in sorted(out)]


def test_base_spans():
    for t in TEXTS:
        assert [f"{k}:{a}:{b}" for k, a, b in secrets.find_spans(t or "") if k in PATTERNS] == brute(t)


def test_ledger_scans_a_blob_once(spark, tmp_path, monkeypatch):
    rows = [(i, t, "b") for i, t in enumerate(TEXTS)] + [(100 + i, TEXTS[3], "b") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, blob string")
    path = f"file://{tmp_path}/ledger"
    got = secrets.scan_versions(df, path).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [s for s in r["spans"].split(",") if s and s.split(":")[0] in PATTERNS]
        assert spans == brute(r["text"]) and r["n_assign"] == sum(s.startswith("assign") for s in spans)
    assert secrets.open_ledger(spark, path).count() == len({t or "" for t in TEXTS})
    more = spark.createDataFrame([(500, TEXTS[3]), (501, "secret=newnewnewnew")], "doc_id long, text string")
    versions = secrets.with_blob(more)
    assert secrets.scan_unseen(versions, secrets.open_ledger(spark, path)).count() == 1
    assert secrets.scan_unseen(versions, secrets.open_ledger(spark, path), rule_version="2").count() == 2
    assert {r["doc_id"]: r["n_assign"] for r in secrets.scan_versions(more, path).collect()} == {500: 1, 501: 1}
    assert secrets.open_ledger(spark, path).count() == len({t or "" for t in TEXTS}) + 1
    assert secrets.scan_versions(more.limit(0)).count() == 0
    secrets.open_ledger(spark, path).limit(30).coalesce(1).write.mode("append").parquet(path)  # as two runs at once leave it
    assert secrets.scan_versions(df, path).count() == len(rows) and secrets.scan_versions(more, path).count() == 2
    assert secrets.redact_secrets(df, path).count() == len(rows)


def test_redaction(spark):
    hot = [(9, "same token=abcdefghijklmnop", 27, 4)] * 40
    df = spark.createDataFrame([*hot, (1, "a token=abcdefghijklmnop z", 26, 1), (2, "clean", 5, 2), (3, None, None, 3)], "doc_id long, text string, n_chars long, spans int")
    got = {r["doc_id"]: r for r in secrets.redact_secrets(df).collect()}
    assert got[1]["text"] == "a [SECRET] z" and got[1]["n_chars"] == 12 and got[1]["spans"] == 1
    assert got[2]["text"] == "clean" and got[2]["n_chars"] == 5 and got[3]["text"] is None
    assert secrets.redact_secrets(df).where("text = 'same [SECRET]'").count() == 40 and secrets.redact_secrets(df.limit(0)).count() == 0
    assert secrets.redact_secrets(df).columns == df.columns
    assert secrets.redact("abcdefgh", "x:1:4,y:2:6") == "a[SECRET]gh"
