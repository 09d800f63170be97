import hashlib
import struct
import zlib

import numpy as np
import pytest

from merset.llm import jpeg


def test_payload_round_trip(rng):
    for n in (0, 1, 63, 64, 65, 4096, jpeg.ROW * jpeg.MOST_ROWS + 100):
        raw = rng.integers(0, 256, n, dtype=np.uint8)
        p = jpeg.padded(raw)
        media = jpeg.encode([p, jpeg.padded(raw[: n // 2])])
        images = jpeg.thumbnails(media)
        assert b"".join(g.tobytes() for _, g in images[0]) == p.tobytes()
        assert len(images[0]) == -(-len(p) // (jpeg.ROW * jpeg.MOST_ROWS))


def bits_of(dc_and_ac, dc, ac):
    """Entropy-coded bits of blocks given as (dc difference, [(run, value), ...])."""
    out = ""
    mag = lambda v: format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b") if v else ""
    code = lambda t, s: format(t[s][0], f"0{t[s][1]}b")
    for d, coefficients in dc_and_ac:
        out += code(dc, abs(d).bit_length()) + mag(d)
        for run, v in coefficients:
            while run > 15:
                out += code(ac, 0xF0)
                run -= 16
            out += code(ac, run << 4 | abs(v).bit_length()) + mag(v)
        out += code(ac, 0)
    out += "1" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8, "big").replace(b"\xff", b"\xff\x00")


def test_general_baseline_scan():
    """Three components, 2x1 sampling, AC coefficients with long runs, a restart interval and an APP marker."""
    rng = np.random.default_rng(2)
    dc_l, ac_l = [(s, 4) for s in range(12)], [(s, 7) for s in (0, 0xF0, *[r << 4 | z for r in range(16) for z in range(1, 6)])]
    dc, ac = jpeg.canonical(dc_l), jpeg.canonical(ac_l)
    across, down = 3, 2
    levels = {c: rng.integers(-60, 60, across * down * (2 if c == 0 else 1)) for c in range(3)}
    segments, last = [], {}
    for m in range(across * down):
        if m % 2 == 0:
            last, blocks = dict.fromkeys(range(3), 0), []
        for c, k in ((0, 2 * m), (0, 2 * m + 1), (1, m), (2, m)):
            v = int(levels[c][k])
            blocks.append((v - last[c], [(int(rng.integers(0, 30)), int(rng.integers(1, 20)) * (-1) ** k) for _ in range(int(rng.integers(0, 2)))]))
            last[c] = v
        if m % 2 == 1:
            segments.append(bits_of(blocks, dc, ac))
    head = b"\xff\xd8\xff\xe0\x00\x06abcd\xff\xdb\x00\x43\x00" + bytes([4] + [1] * 63)
    head += b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 16, 45, 3) + bytes([1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0])
    head += jpeg._dht(0, dc_l) + jpeg._dht(0x10, ac_l) + b"\xff\xdd\x00\x04\x00\x02" + b"\xff\xda\x00\x0c\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00"
    body = segments[0] + b"\xff\xd0" + segments[1] + b"\xff\xd1" + segments[2]
    (image, grid), = jpeg.thumbnails([head + body + b"\xff\xd9"])[0]
    assert (image.width, image.height, grid.shape) == (45, 16, (2, 6))
    want = levels[0].reshape(down, across * 2)
    assert (grid == np.clip(np.floor(want * 4 / 8 + 128.5), 0, 255)).all()


@pytest.mark.parametrize("bad", [None, b"", b"GIF89a", b"\xff\xd8\xff", b"\xff\xd8\xff\xc2\x00\x0b\x08\x00\x08\x00\x08\x01\x01\x11\x00"])
def test_not_baseline(bad):
    assert jpeg.thumbnails([bad]) == [None]


def test_broken_scan_spares_others():
    good = jpeg.encode([jpeg.padded(np.arange(100, dtype=np.uint8))])[0]
    cut = good[: len(good) - 40]
    a, b = jpeg.thumbnails([cut, good])
    assert a is None and b is not None


def test_query_columns(spark):
    texts = [None, "", "abc", "é" * 100, "x" * 64, "x" * 64, "long " * 30000]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r["doc_id"]: r for r in jpeg.store_and_read(df, with_media=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\x00")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
    assert got[0]["feature"] == got[1]["feature"] and got[4]["media_sha256"] == got[5]["media_sha256"]
    told = {r["doc_id"]: r for r in jpeg.describe(spark.createDataFrame([(1, bytes(got[2]["media"])), (2, b"no"), (3, None)], "doc_id long, media binary")).collect()}
    assert told[1]["thumbnail"][:3] == b"abc" and (told[1]["width"], told[1]["height"]) == (512, 8) and told[2]["width"] is None and told[3]["thumbnail_hash"] is None
    assert jpeg.store_and_read(df.limit(0)).count() == 0


def test_features_are_of_all_images(spark):
    """Texts alike in their first image only differ in their features, which tell the whole size."""
    most = jpeg.ROW * jpeg.MOST_ROWS
    texts = ["ab" * (most // 2) + tail * most for tail in ("a ", " a")] + ["ab" * (most // 2)]
    texts[1] = texts[1][: most * 2] + "~" * most
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jpeg.store_and_read(df, with_media=True)
    got = {r["doc_id"]: r for r in rows.collect()}
    told = {r["doc_id"]: r for r in jpeg.describe(rows).collect()}
    assert len({r["feature"] for r in got.values()}) == 3
    for i, t in enumerate(texts):
        assert got[i]["feature"] == f"{told[i]['width']}x{told[i]['height']}:{told[i]['thumbnail_hash']}"
        assert (told[i]["width"], told[i]["height"]) == (512, 8 * len(t) // jpeg.ROW) and bytes(told[i]["thumbnail"]) == t.encode()


def test_joined_images_of_different_widths():
    a, b = (np.full(s, 9, np.uint8) for s in ((2, 3), (1, 5)))
    image = lambda w, h: type("I", (), {"width": w, "height": h})()
    width, height, grid = jpeg.joined([(image(24, 16), a), (image(40, 8), b)])
    assert (width, height) == (40, 24) and grid.tolist() == [[9, 9, 9, 0, 0]] * 2 + [[9] * 5]


def test_long_texts_go_image_by_image(rng):
    """Same media and thumbnails as all images at once, in less memory than their coded bits would take."""
    import tracemalloc

    payload = jpeg.padded(rng.integers(32, 120, 3 * jpeg.ROW * jpeg.MOST_ROWS + 777).astype(np.uint8))
    pieces, images = next(jpeg._stored([payload]))
    assert b"".join(pieces) == jpeg.encode([payload])[0] and np.array_equal(jpeg.joined(images)[2].ravel(), payload)
    long = jpeg.padded(rng.integers(32, 120, 8 << 20).astype(np.uint8))
    tracemalloc.start()
    for _ in jpeg._stored([long]):
        pass
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", 2)], "doc_id long, text string, Feature int")
    with pytest.raises(ValueError):
        jpeg.store_and_read(df, keep=("doc_id", "Feature"))
    with pytest.raises(ValueError):
        jpeg.describe(df.withColumnRenamed("Feature", "width"), media="text", keep=("width",))
    assert jpeg.describe(jpeg.store_and_read(df, with_media=True).limit(0)).count() == 0
