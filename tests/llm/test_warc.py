import gzip
import hashlib
import os

import pytest

from merset.llm import warc


def pages(spark, rng, n=120):
    rows = [(i, f"http://h/{i}", "<p>" + "x" * int(rng.integers(0, 30)) + str(i) * 60 + "</p>", 0) for i in range(n)]
    rows += [(1000 + i, "http://c", "copy " * 40, 0) for i in range(30)] + [(2000 + i, None, "tiny", 0) for i in range(3)]
    rows += [(3000, "http://n\r\nx: y", None, 0), (3001, "http://é/", "é" * 80, 0), (None, "http://none", "copy " * 40, 0), (3002, "u", "y" * 2_000_000, 0), (3003, "", "empty url", 0), (5, rows[5][1], rows[5][2], 0)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, shard int")


def test_round_trip_and_revisits(spark, rng, tmp_path):
    rows, df = pages(spark, rng)
    folder = warc.write_warc(df, f"file://{tmp_path}/a", shard_bytes=300_000, roll_bytes=4_000)
    got = warc.read_warc(spark, folder, with_payload=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    html = {}
    for i, u, h, _ in rows:
        html.setdefault(i, (u, h or ""))
    for r in got:
        u, h = html[r["page_id"]]
        raw = h.encode()
        again = len(raw) >= 100 and first[h] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[h]) if again else ("response", None))
        assert r["payload"] is None if again else bytes(r["payload"]) == raw
        assert r["url"] == (None if u is None else u.replace("\r", "%0D").replace("\n", "%0A"))
    assert not os.path.exists(tmp_path / "a/_temporary")
    for f in (tmp_path / "a").glob("*.warc.gz"):
        assert gzip.open(f).read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_same_input_gives_same_files(spark, rng, tmp_path):
    _, df = pages(spark, rng)
    names = []
    for x, rows in (("a", df), ("b", df.repartition(5))):
        warc.write_warc(rows, f"file://{tmp_path}/{x}", shard_bytes=300_000, roll_bytes=4_000)
        names.append({f.name: hashlib.sha256(f.read_bytes()).hexdigest() for f in (tmp_path / x).glob("*.warc.gz")})
    assert names[0] == names[1] and len(names[0]) > 5


def test_other_attempts_never_touch_a_file_of_the_manifest(spark, rng, tmp_path):
    """A second attempt that ends, one that dies before its move and one that dies while moving; with the same and with other content."""
    rows, df = pages(spark, rng, 30)
    folder = warc.write_warc(df, f"file://{tmp_path}/a", shard_bytes=300_000, roll_bytes=4_000)
    before = {f.name: f.read_bytes() for f in (tmp_path / "a").glob("*.warc.gz")}

    def attempt(data, dies=None):
        files = warc._Files(folder, 4, 1000, "2000-01-01T00:00:00Z")
        files.write(0, data)
        if dies == "moving":
            files.fs = type("Broken", (), {"get_file_info": files.fs.get_file_info, "move": staticmethod(lambda a, b: (_ for _ in ()).throw(OSError("lost")))})()
        if dies != "writing":
            files.close()
        return files.done

    names = [attempt(data)[0][0] for data in (b"one", b"one", b"two")]
    assert names[0] == names[1] != names[2] and not set(names) & set(before)
    assert attempt(b"one", "moving")[0][0] == names[0]  # it is there already
    with pytest.raises(OSError):
        attempt(b"three", "moving")
    attempt(b"four", "writing")
    assert {n: (tmp_path / "a" / n).read_bytes() for n in before} == before
    assert warc.read_warc(spark, folder).count() == len(rows)


def test_damage_is_noticed_and_empty_is_fine(spark, rng, tmp_path):
    _, df = pages(spark, rng, 10)
    warc.write_warc(df, f"file://{tmp_path}/a")
    file = next((tmp_path / "a").glob("*.warc.gz"))
    file.write_bytes(file.read_bytes()[:-3])
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read_warc(spark, f"file://{tmp_path}/a").collect()
    assert warc.read_warc(spark, warc.write_warc(df.limit(0), f"file://{tmp_path}/e")).count() == 0
