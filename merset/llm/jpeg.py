"""Baseline JPEG as a media column: a lossless flat-block writer and a DC-only reader.

The writer stores bytes as the samples of flat 8x8 blocks: with a DC quantiser
of 8 a block whose DC coefficient is ``byte - 128`` has that byte as all its
samples, so the image's 1/8 thumbnail is the payload, exactly. Rows are 64
blocks wide and end with a restart marker.

The reader parses markers, Huffman-decodes the scans of any baseline JPEG
(several components, sampling factors, AC coefficients, restart intervals) and
rebuilds only the DC luminance thumbnail. Restart intervals are independent, so
those of all images of a batch with the same tables are decoded side by side,
one symbol a step, in numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merset.llm.common import flat, no_clash, slices
from merset.session import spread

ROW = 64
MOST_ROWS = 8191
CHUNK = 1 << 21
#: Huffman code lengths of the writer's DC categories; short for the differences that text has. Fixed values.
DC_LENGTHS = {4: 2, 7: 2, 2: 3, 3: 3, 5: 3, 0: 4, 1: 5, 6: 6, 8: 7}


def canonical(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length) of the canonical code for (symbol, length) in order of length."""
    code, last, out = 0, 0, {}
    for symbol, length in lengths:
        code <<= length - last
        out[symbol] = (code, length)
        code, last = code + 1, length
    return out


def _dht(kind: int, lengths: list[tuple[int, int]]) -> bytes:
    counts = bytes(sum(n == i for _, n in lengths) for i in range(1, 17))
    body = bytes([kind]) + counts + bytes(s for s, _ in lengths)
    return b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


_DC = sorted(DC_LENGTHS.items(), key=lambda x: (x[1], x[0]))
_TABLES = b"\xff\xdb\x00\x43\x00" + bytes([8] + [1] * 63), _dht(0x00, _DC) + _dht(0x10, [(0, 1)]) + b"\xff\xdd" + struct.pack(">HH", 4, ROW)


def _header(rows: int) -> bytes:
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, rows * 8, ROW * 8, 1) + b"\x01\x11\x00"
    return b"\xff\xd8" + _TABLES[0] + frame + _TABLES[1] + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00"


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and length by difference + 255: DC category, its bits, and end of block (one 0 bit)."""
    table, codes, lengths = canonical(_DC), np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        code, n = table[s]
        codes[d + 255] = ((code << s) | (d if d > 0 else d + (1 << s) - 1)) << 1
        lengths[d + 255] = n + s + 1
    return codes, lengths


_CODE, _LEN = _codes()


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """Media bytes of each payload (a positive multiple of 64 bytes): one JPEG, or several in a row if it is higher than one may be."""
    parts = [(k, p[a : a + ROW * MOST_ROWS]) for k, p in enumerate(payloads) for a in range(0, len(p), ROW * MOST_ROWS)]
    rows = np.array([len(p) // ROW for _, p in parts])
    values = np.concatenate([p for _, p in parts]).astype(np.int16).reshape(-1, ROW) - 128
    index = np.diff(values, axis=1, prepend=np.int16(0)) + 255
    code, length = _CODE[index], _LEN[index]
    end = np.cumsum(length, axis=1)
    n_bytes = (end[:, -1] + 7) >> 3
    first = np.cumsum(n_bytes) - n_bytes
    at = (first[:, None] * 8 + end - length).ravel()
    word = (code.ravel() << (24 - (at & 7) - length.ravel()).astype(np.uint32)).astype(np.uint32)
    total = int(n_bytes.sum())
    bits = np.zeros(total + 3)
    for k in range(3):
        bits += np.bincount((at >> 3) + k, weights=(word >> np.uint32(16 - 8 * k)) & np.uint32(255), minlength=total + 3)
    data = bits[:total].astype(np.uint8)
    data[first + n_bytes - 1] |= ((1 << (-end[:, -1] & 7)) - 1).astype(np.uint8)
    full = data == 255
    stuffed = np.cumsum(full)
    row_of = np.repeat(np.arange(len(n_bytes)), n_bytes)
    out = np.zeros(total + int(stuffed[-1]) + 2 * len(n_bytes), np.uint8)
    out[np.arange(total) + 2 * row_of + stuffed - full] = data
    row_end = first + n_bytes + stuffed[first + n_bytes - 1] + 2 * np.arange(len(n_bytes))
    last = np.cumsum(rows) - 1
    mark = 0xD0 + (np.arange(len(n_bytes)) - np.repeat(last - rows + 1, rows)) % 8
    mark[last] = 0xD9
    out[row_end], out[row_end + 1] = 255, mark
    media: dict[int, list[bytes]] = defaultdict(list)
    start = 0
    for (k, _), n, stop in zip(parts, rows, row_end[last] + 2, strict=True):
        media[k] += [_header(int(n)), out[start:stop].tobytes()]
        start = stop
    return [b"".join(media[k]) for k in range(len(payloads))]


@dataclass
class Image:
    """What the markers of one baseline JPEG say, and its entropy-coded intervals."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quant: dict[int, int] = field(default_factory=dict)  # DC quantiser by table
    huffman: dict[int, bytes] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component's index, DC table, AC table
    interval: int = 0
    segments: list[np.ndarray] = field(default_factory=list)
    end: int = 0

    def blocks(self) -> tuple[list[tuple[int, int, int]], int, int]:
        """The blocks of an MCU as (component, dx, dy), and how many MCUs there are across and down."""
        h_max, v_max = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.scan) == 1:
            _, h, v, _ = self.components[self.scan[0][0]]
            return [(self.scan[0][0], 0, 0)], -(-self.width * h // (8 * h_max)), -(-self.height * v // (8 * v_max))
        mcu = [(c, x, y) for c, _, _ in self.scan for y in range(self.components[c][2]) for x in range(self.components[c][1])]
        return mcu, -(-self.width // (8 * h_max)), -(-self.height // (8 * v_max))


def parse(data: bytes, at: int = 0) -> Image:
    """Markers of the JPEG at ``at``, up to the end of its first scan that has the first component."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, p = Image(), at + 2
    while True:
        while data[p : p + 1] == b"\xff" and data[p + 1 : p + 2] == b"\xff":
            p += 1
        if len(data) < p + 4 or data[p] != 255:
            raise ValueError("marker expected")
        kind, size = data[p + 1], struct.unpack(">H", data[p + 2 : p + 4])[0]
        body = data[p + 4 : p + 2 + size]
        p += 2 + size
        if kind == 0xDB:
            q = 0
            while q < len(body):
                wide = body[q] >> 4
                image.quant[body[q] & 15] = struct.unpack(">H", body[q + 1 : q + 3])[0] if wide else body[q + 1]
                q += 129 if wide else 65
        elif kind == 0xC4:
            q = 0
            while q < len(body):
                n = sum(body[q + 1 : q + 17])
                image.huffman[body[q]] = body[q + 1 : q + 17 + n]
                q += 17 + n
        elif kind == 0xC0:
            bits, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not image.width or not image.height:
                raise ValueError("not 8-bit baseline with a size")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("not baseline")
        elif kind == 0xDD:
            image.interval = struct.unpack(">H", body[:2])[0]
        elif kind == 0xDA:
            ids = [c[0] for c in image.components]
            image.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            rest = np.frombuffer(data, np.uint8, offset=p)
            full = np.flatnonzero(rest[:-1] == 255)
            after = rest[full + 1]
            stop = full[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 255)]
            end = int(stop[0]) if len(stop) else len(rest)
            full, after = full[full < end], after[: np.searchsorted(full, end)]
            if not any(c == 0 for c, _, _ in image.scan):
                p += end
                continue
            kept = np.ones(end, bool)
            kept[full[after == 0] + 1] = False
            cuts = full[(after >= 0xD0) & (after <= 0xD7)]
            a = 0
            for b in [*cuts, end]:
                image.segments.append(rest[a:b][kept[a:b]])
                a = b + 2
            image.end = p + end + 2 if len(stop) and rest[end + 1] == 0xD9 else p + end
            return image


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol by the next 16 bits; length 0 where no code begins so."""
    lengths, symbols = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    listed = [(s, n) for s, n in zip(table[16:], [n for n in range(1, 17) for _ in range(table[n - 1])], strict=True)]
    for symbol, (code, n) in canonical(listed).items():
        lengths[code << (16 - n) : (code + 1) << (16 - n)] = n
        symbols[code << (16 - n) : (code + 1) << (16 - n)] = symbol
    return lengths, symbols


def _decode_alike(images: list[Image]) -> list[np.ndarray]:
    """DC luminance thumbnails of images with the same components and tables, all intervals side by side."""
    mcu = images[0].blocks()[0]
    tables = {c: (_lookup(images[0].huffman[d]), _lookup(images[0].huffman[16 + a])) for c, d, a in images[0].scan}
    sizes = [i.blocks()[1:] for i in images]
    pieces = [s for i in images for s in i.segments]
    lengths = np.array([len(s) for s in pieces])
    data = np.concatenate([*[x for s in pieces for x in (s, np.full(8, 255, np.uint8))], np.zeros(16, np.uint8)])
    pos = (np.cumsum(lengths + 8) - lengths - 8) * 8
    limit = pos + lengths * 8
    windows = np.ndarray(shape=(len(data) - 8,), dtype=">u8", buffer=data, strides=(1,))
    todo = np.concatenate([np.minimum(i.interval or a * b, a * b - (i.interval or a * b) * np.arange(len(i.segments))) for i, (a, b) in zip(images, sizes, strict=True)])
    n_luma = sum(c == 0 for c, _, _ in mcu)
    dc = {c: np.zeros(len(pieces), np.int64) for c, _, _ in images[0].scan}
    out = np.zeros((len(pieces), max(todo.max(initial=0), 0), n_luma), np.int16)

    def symbol(rows: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = pos[rows]
        w = windows[p >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)
        head = (w >> np.uint64(48)).astype(np.int64)
        n, s = table[0][head], table[1][head]
        if not n.all() or (p >= limit[rows]).any():
            raise ValueError("corrupt scan")
        return w, n.astype(np.uint64), s

    for m in range(int(todo.max(initial=0))):
        rows, luma = np.flatnonzero(todo > m), 0
        for c, _, _ in mcu:
            w, n, s = symbol(rows, tables[c][0])
            s64 = s.astype(np.uint64)
            bits = ((w << n) >> np.uint64(1) >> (np.uint64(63) - s64)).astype(np.int64)
            s = s.astype(np.int64)
            dc[c][rows] += np.where(bits >= (1 << s) >> 1, bits, bits - (1 << s) + 1)
            pos[rows] += n.astype(np.int64) + s
            if c == 0:
                out[rows, m, luma] = dc[c][rows]
                luma += 1
            left, k = rows, np.ones(len(rows), np.int64)
            while len(left):
                _, n, s = symbol(left, tables[c][1])
                run, size = (s >> 4).astype(np.int64), (s & 15).astype(np.int64)
                pos[left] += n.astype(np.int64) + size
                k = k + run + 1
                on = ((size > 0) | (run == 15)) & (k < 64)
                left, k = left[on], k[on]
    thumbs, at = [], 0
    for image, (across, down) in zip(images, sizes, strict=True):
        _, h, v, q = image.components[0]
        n = len(image.segments)
        flat_blocks = np.concatenate([out[i, : max(todo[i], 0)] for i in range(at, at + n)]) if n > 1 and image.interval != out.shape[1] else out[at : at + n].reshape(-1, n_luma)
        flat_blocks, at = flat_blocks[: across * down], at + n
        if len(flat_blocks) < across * down:
            raise ValueError("scan ends early")
        if n_luma > 1:
            grid = flat_blocks.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        else:
            grid = flat_blocks.reshape(down, across)
        samples = np.clip(np.floor(grid.astype(np.int32) * image.quant[q] / 8 + 128.5), 0, 255).astype(np.uint8)
        h_max, v_max = max(c[1] for c in image.components), max(c[2] for c in image.components)
        thumbs.append(samples[: -(-image.height * v // (8 * v_max)), : -(-image.width * h // (8 * h_max))])
    return thumbs


def thumbnails(media: list[bytes | None]) -> list[list[tuple[Image, np.ndarray]] | None]:
    """The images of each value with their DC luminance thumbnails; None if it isn't baseline JPEG throughout."""
    found: list[list[Image] | None] = []
    for value in media:
        images: list[Image] | None = []
        try:
            at = 0
            while value and at < len(value):
                images.append(parse(value, at))
                at = images[-1].end
        except (ValueError, IndexError, KeyError, struct.error):
            images = None
        found.append(images or None)
    alike: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for i, images in enumerate(found):
        for j, x in enumerate(images or ()):
            alike[(tuple(x.components), tuple(x.scan), tuple(sorted(x.huffman.items())), bool(len(x.segments) > 1))].append((i, j))
    grids: dict[tuple[int, int], np.ndarray] = {}
    for keys in alike.values():
        try:
            grids |= dict(zip(keys, _decode_alike([found[i][j] for i, j in keys]), strict=True))
        except (ValueError, IndexError, KeyError):
            for key in keys:  # one of them is broken: each alone
                try:
                    grids[key] = _decode_alike([found[key[0]][key[1]]])[0]
                except (ValueError, IndexError, KeyError):
                    found[key[0]] = None
    return [[(x, grids[i, j]) for j, x in enumerate(images)] if images else None for i, images in enumerate(found)]


def joined(images: list[tuple[Image, np.ndarray]]) -> tuple[int, int, np.ndarray]:
    """Pixels across and down and the thumbnail of all images of a value, one below the other; narrower ones get zeros to their right."""
    if len(images) == 1:
        return images[0][0].width, images[0][0].height, images[0][1]
    across = max(g.shape[1] for _, g in images)
    whole = np.concatenate([g if g.shape[1] == across else np.pad(g, ((0, 0), (0, across - g.shape[1]))) for _, g in images])
    return max(x.width for x, _ in images), sum(x.height for x, _ in images), whole


def average_hash(grid: np.ndarray) -> str:
    """64 bits: which cells of the thumbnail, cut into 8 by 8 cells, are lighter than their mean. Cells of small images repeat."""
    cell = lambda n: np.arange(8) * n // 8
    h, w = grid.shape
    sums = np.add.reduceat(np.add.reduceat(grid, cell(h), axis=0, dtype=np.int64), cell(w), axis=1)
    size = lambda n: np.maximum(np.diff(np.append(cell(n), n)), 1)
    means = sums / np.outer(size(h), size(w))
    return np.packbits(means > means.mean()).tobytes().hex()


def padded(raw: np.ndarray) -> np.ndarray:
    """Zeros appended up to a positive multiple of 64 bytes."""
    return np.concatenate([raw, np.zeros(max(ROW, -(-len(raw) // ROW) * ROW) - len(raw), np.uint8)])


def _stored(payloads: list[np.ndarray]) -> Iterator[tuple[list[bytes], list[tuple[Image, np.ndarray]]]]:
    """The media of each payload, in pieces, and its images as read back; a payload of several images goes through image by image."""
    most = ROW * MOST_ROWS
    short = [p for p in payloads if len(p) <= most]
    media = encode(short) if short else []
    together = iter(zip(media, thumbnails(media), strict=True))
    for p in payloads:
        if len(p) <= most:
            stored, images = next(together)
            yield [stored], images
        else:
            pieces, images = [], []
            for a in range(0, len(p), most):
                pieces += encode([p[a : a + most]])
                image, grid = thumbnails(pieces[-1:])[0][0]
                image.segments.clear()
                images.append((image, grid))
            yield pieces, images


STORED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_and_read(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_media: bool = False) -> DataFrame:
    """The ``keep`` columns, what reading each stored text back gives, and the media itself if asked for.

    A text is stored as UTF-8, zero-padded to a positive multiple of 64 bytes,
    and every column but n_bytes, media_bytes and media_sha256 comes from the
    bytes decoded out of the stored image. feature: pixels across and down, and
    the thumbnail's average hash, of all images below each other. Null and empty texts are
    64 zero bytes. Texts of more than 524,224 bytes take several images.
    Repeated rows stay; equal texts give equal values; an empty table gives an
    empty result. ``keep`` with a name of the results is an error. A long text
    is held a few times over, but never all its coded bits.
    """
    no_clash(keep, tuple(x.strip().split(" ")[0] for x in STORED.split(",")) + ("media",) * with_media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, ends = flat(batch.column(batch.num_columns - 1))
            for i, j in slices(starts, ends, CHUNK):
                rows, media = [], []
                for (pieces, images), n in zip(_stored([padded(raw[a:b]) for a, b in zip(starts[i:j], ends[i:j], strict=True)]), ends[i:j] - starts[i:j], strict=True):
                    width, height, grid = joined(images)
                    back, sha = grid.tobytes(), hashlib.sha256()
                    for piece in pieces:
                        sha.update(piece)
                    rows.append((int(n), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), sum(map(len, pieces)), sha.hexdigest(), f"{width}x{height}:{average_hash(grid)}"))
                    if with_media:
                        media.append(b"".join(pieces))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                kept = [batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)]
                yield pa.record_batch([*kept, *cols, *([pa.array(media, pa.binary())] if with_media else [])], names=[f.strip().split(" ")[0].strip("`") for f in schema.split(", ")])

    schema = ", ".join([*[f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep], STORED, *(["media binary"] if with_media else [])])
    return spread(docs.select(*keep, F.col(text).alias("_text"))).mapInArrow(run, schema)


def describe(rows: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """width, height, thumbnail (its bytes, row by row) and thumbnail_hash of a column of baseline JPEGs, several in a value one below the other; null where a value is null or isn't one.

    One row a row; an empty table gives no rows; ``keep`` with a name of the results is an error.
    """
    no_clash(keep, ("width", "height", "thumbnail", "thumbnail_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = thumbnails(batch.column(batch.num_columns - 1).to_pylist())
            whole = [joined(x) if x else None for x in found]
            told = [(x[0], x[1], x[2].tobytes(), average_hash(x[2])) if x else (None,) * 4 for x in whole]
            cols = [pa.array(c, t) for c, t in zip(zip(*told, strict=True), [pa.int32(), pa.int32(), pa.binary(), pa.string()], strict=True)] if told else []
            if told:
                yield pa.record_batch([*[batch.column(k) for k in range(batch.num_columns - 1)], *cols], names=[*keep, "width", "height", "thumbnail", "thumbnail_hash"])

    schema = ", ".join([*[f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keep], "width int, height int, thumbnail binary, thumbnail_hash string"])
    return rows.select(*keep, F.col(media).alias("_media")).mapInArrow(run, schema)
