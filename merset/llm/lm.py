"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is lower-cased bytes and an end. Each byte is the bits of a Huffman code,
made from the training fold's bytes. Each bit is predicted from several
contexts (two, three and five bytes, the word so far). A predictor is a table
of stretched probabilities by hashed context and node of the code, made from
counts over the training fold. The predictions of a bit are mixed by the
weights of a gate: how often the longer contexts were seen. Each gate's weights
are fitted on the whole training fold, each half of its texts with tables of
the other half; the tables that score are of all its texts. Each text then
refines its own copy, by a gradient step after every block of its bytes, so a
block is coded with weights that only its past has shaped.

After the mix comes a second one, over words: a word with the blank after it
also has a probability from the corpus's token counts. The share of that
expert follows how well it did on the text's words so far. Costs add up to
total bits, and bits per byte.

Token counts grow with the corpus and are never broadcast: documents are dealt
into blocks of bounded size, each block's distinct tokens meet the corpus counts
in a shuffle by token, and come back to the block that asked. They serve the
baseline too, which is of whole tokens.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merset.llm.common import LOWER, flat, slices
from merset.session import cut

#: Slots, in bits, of each context table: two, three and five bytes, word so far. A slot has 64 cells.
SLOT_BITS = (16, 16, 18, 18)
CELL_BITS = 6
#: Nodes of the code with a cell of their own, the commonest; the others share what is left. Cell 0 says how often the slot was seen.
OWN = 55
PARTS = 64
FAN = 64
CHUNK = 1 << 19
#: Bytes whose slots are worked out at once.
STRETCH = 1 << 15
#: A slot's first cells, the commonest nodes, are fetched at once; more where a depth of the code needs them.
LINES = (16, 32, 64)
#: Bits whose costs are multiplied before one logarithm is taken; none is above 1 + e ** 14, so single precision holds them.
AT_ONCE = 6
#: Bytes of text whose words are counted at once.
TOKENS_BYTES = 1 << 23
#: Bytes of training text, about, whose weights the fit on all of it starts from, and the longest text among them.
FIT_BYTES = 1 << 18
LONGEST_FIT = 1 << 15
#: The fit ends with the Newton step that promises less than this share of the cost.
LITTLE = 1e-3
#: Bytes of text whose equal contexts are fitted as one, and bits of their numbers.
ALIKE_BITS = 21
#: Fractions of a unit that sums of the fit are counted in, so that they are exact in any order.
FINE = float(1 << 18)
#: Where the classes of how often a context was seen begin; a gate is a class of five bytes and one of the word.
SEEN = (1, 4, 32)
GATES = (len(SEEN) + 1) ** 2
#: A text's step for a gate is its gradient over STIFF + GAIN times the bits it has coded there. First and last block's bytes; blocks double.
STIFF = 100.0
GAIN = 0.5
FIRST_BLOCK = 32
LAST_BLOCK = 1 << 13
DELTA = 0.2
SCALE = 12.0
#: Words that token counts and bytes have been right about before a text begins, as it were; and how often the share is worked out anew from itself.
BELIEF = (0.2, 2.0)
ROUNDS = 3
PAD = 5
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_P32 = np.uint32(0x9E3779B1)
#: A byte that UTF-8 never has; in texts it is read as 254, which UTF-8 never has either.
END = 255
_LOWER = np.minimum(np.frombuffer(LOWER, np.uint8), END - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LAST = _SPACE | (np.arange(256) == END)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_P, STRETCH), _powers(_INV, STRETCH)


@dataclass
class Code:
    """A binary code of bytes: lengths, and at each depth the sign of the bit (1 or -1) and the cell of the node."""

    length: np.ndarray
    sign: np.ndarray
    cell: np.ndarray


def code_of(counts: np.ndarray) -> Code:
    """The Huffman code for counts of 256 bytes; each counts as one in 4,096 at least, so no code is very long."""
    heap = [(max(int(c), int(counts.sum()) // 4096, 1), b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    children: list[tuple[int, int]] = []
    while len(heap) > 1:
        (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
        children.append((a, b))
        heapq.heappush(heap, (x + y, 255 + len(children)))
    paths: dict[int, list[tuple[int, int]]] = {255 + len(children): []}
    for rank in range(len(children)):  # from the root down: the commonest nodes first
        node = 255 + len(children) - rank
        cell = 1 + rank if rank < OWN else 1 + OWN + rank % ((1 << CELL_BITS) - 1 - OWN)
        for sign, child in zip((-1, 1), children[node - 256], strict=True):
            paths[child] = [*paths[node], (sign, cell)]
    depth = max(len(paths[b]) for b in range(256))
    sign, cell = np.zeros((depth, 256), np.float32), np.zeros((depth, 256), np.int64)
    for b in range(256):
        for d, (s, c) in enumerate(paths[b]):
            sign[d, b], cell[d, b] = s, c
    return Code(np.array([len(paths[b]) for b in range(256)], np.uint8), sign, cell)


def _laid_out(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one array, each with PAD blanks before and the end after; where what is coded starts and ends."""
    n = ends - starts
    size = n + PAD + 1
    first = np.cumsum(size) - n - 1
    data = np.full(int(size.sum()), 32, np.uint8)
    if (starts[1:] == ends[:-1]).all():  # one after another, as Arrow has them
        source = raw[starts[0] : ends[-1]] if len(n) else raw[:0]
    else:
        source = raw[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    text = np.zeros(len(data), np.int8)
    text[first] = 1
    text[first + n] -= 1
    data[np.cumsum(text, dtype=np.int8).view(bool)] = _LOWER.take(source)
    data[first + n] = END
    return data, first, first + 1 + n


def _slots(data: np.ndarray) -> list[np.ndarray]:
    """For each byte from the PAD-th on: its slot in each table."""
    out = [np.empty(len(data) - PAD, np.int32) for _ in SLOT_BITS]
    so_far = 0  # the hash of the word that a stretch begins in
    for a in range(0, len(data) - PAD, STRETCH):
        b = data[a : a + STRETCH + PAD - 1].astype(np.uint32) if a + STRETCH + PAD < len(data) else data[a:-1].astype(np.uint32)
        two = (b[PAD - 2 : -1] << np.uint32(8)) | b[PAD - 1 :]
        three = two | (b[PAD - 3 : -2] << np.uint32(16))
        five = (three | (b[PAD - 4 : -3] << np.uint32(24))) * np.uint32(0x85EBCA6B) ^ b[: 1 - PAD] * np.uint32(0xC2B2AE35)
        part = data[a + PAD - 1 : a + PAD - 1 + len(two)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(b[PAD - 1 :].astype(np.uint64) * _DOWN[: len(part)] + _DOWN[: len(part)], out=sums[1:])
        sums[1:] += np.uint64(so_far * int(_P) % 2**64)
        last = np.maximum.accumulate(np.where(_SPACE.take(part, mode="clip"), np.arange(1, len(part) + 1), 0))
        word = (sums[1:] - sums.take(last, mode="clip")) * _UP[: len(part)]
        so_far = int(word[-1])
        for slots, x, bits in zip(out, (two, three, five, (word >> np.uint64(32)).astype(np.uint32)), SLOT_BITS, strict=True):
            slots[a : a + len(part)] = (x * _P32) >> np.uint32(32 - bits)
    return out


def _coded(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which bytes from the PAD-th on are coded."""
    on = np.zeros(len(data) + 1, np.int8)
    on[first] = 1
    on[last] -= 1
    return np.cumsum(on[:-1], dtype=np.int8)[PAD:] > 0


def _pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted cells as differences, and their counts, compressed: first bytes of all, second bytes of all and so on."""
    parts = np.diff(cells, prepend=cells.dtype.type(0)).astype("<u4"), counts.astype("<i8")
    planes = b"".join(x.view(np.uint8).reshape(len(x), -1 if len(x) else x.itemsize).T.tobytes() for x in parts)
    return len(cells).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], 12 * n), np.uint8)
    cells, counts = (np.ascontiguousarray(x.reshape(-1, n).T if n else x).view(t).ravel() for x, t in ((raw[: 4 * n], "<u4"), (raw[4 * n :], "<i8")))
    return np.cumsum(cells, dtype=np.int64), counts


def _summed(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal cells as one, in order."""
    if not len(cells):
        return cells, counts
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    return cells[first], np.add.reduceat(counts, first)


COUNTS = "task long, table int, part int, cells binary"


def context_counts(docs: DataFrame, other: Column, text: str = "text", most: int = 1_000_000) -> DataFrame:
    """task, table, part, cells: how often each byte follows each hashed context, as packed cells and counts; and, as table -1, how often each byte and (as 256) word occurs.

    Texts of the ``other`` half count in tables of their own, which follow those
    of the first. A task sums up to ``most`` codes of a table before it sends
    their cells on, in PARTS pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        waiting: list[list[np.ndarray]] = [[] for _ in SLOT_BITS * 2]
        none = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        held, bytes_seen = [none for _ in SLOT_BITS * 2], np.zeros(257, np.int64)

        def merge(k: int) -> None:
            cells, counts = np.unique(np.concatenate(waiting[k]), return_counts=True)
            waiting[k].clear()
            held[k] = _summed(np.concatenate([held[k][0], cells]), np.concatenate([held[k][1], counts]))

        def rows(k: int, parts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
            n = len(parts)
            return pa.record_batch({"task": pa.array([task] * n, pa.int64()), "table": pa.array([k] * n, pa.int32()), "part": pa.array(parts, pa.int32()), "cells": pa.array(blobs, pa.binary())})

        def out(k: int) -> pa.RecordBatch:
            (cells, counts), held[k] = held[k], none
            cuts = np.searchsorted(cells, np.arange(PARTS + 1, dtype=np.int64) << (SLOT_BITS[k % len(SLOT_BITS)] + 8 - 6))
            return rows(k, list(range(PARTS)), [_pack(cells[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])

        for batch in batches:
            for half, mine in enumerate((pc.invert(batch.column(1)), batch.column(1))):
                raw, starts, ends = flat(batch.column(0).filter(mine))
                for i, j in slices(starts, ends, CHUNK):
                    data, first, last = _laid_out(raw, starts[i:j], ends[i:j])
                    on, blank = _coded(data, first, last), _SPACE.take(data)
                    bytes_seen[:256] += np.bincount(data[PAD:], minlength=256)
                    bytes_seen[32] -= PAD * (len(first) - 1)  # blanks between texts, which begin no word
                    bytes_seen[256] += np.count_nonzero(blank[PAD - 1 : -1] > blank[PAD:])
                    bytes_seen[256] -= np.count_nonzero(blank[last - 2])  # an end after a blank begins no word
                    for k, s in enumerate(_slots(data), half * len(SLOT_BITS)):
                        waiting[k].append(((s.view(np.uint32) << np.uint32(8)) | data[PAD:])[on])
                        if sum(map(len, waiting[k])) > most:
                            merge(k)
                            if len(held[k][0]) > most:
                                yield out(k)
        for k in range(2 * len(SLOT_BITS)):
            if waiting[k]:
                merge(k)
            if len(held[k][0]):
                yield out(k)
        yield rows(-1, [0], [_pack(np.arange(257), bytes_seen)])

    counts = cut(docs.select(text, other.alias("other")).where(F.col(text).isNotNull()).mapInArrow(run, COUNTS), "lm-counts")
    while (counts.agg(F.max("task")).first()[0] or 0) >= FAN:  # at most about FAN pieces meet in a group
        counts = cut(counts.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task", "table", "part").applyInArrow(_merged, COUNTS), "lm-counts")
    return counts


def _merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    pairs = [_unpack(blob) for blob in table.column("cells").to_pylist()]
    cells = _pack(*_summed(np.concatenate([c for c, _ in pairs]), np.concatenate([n for _, n in pairs])))
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int32()), pa.array([cells], pa.binary())], names=["task", "table", "part", "cells"])


def byte_counts(counts: DataFrame) -> np.ndarray:
    """How often each byte and (at 256) word occurs: 257 numbers, of up to FAN tasks."""
    out = np.zeros(257, np.int64)
    for row in counts.where("table = -1").select("cells").collect():
        cells, n = _unpack(bytes(row["cells"]))
        out[cells] += n
    return out


def stretch_tables(counts: DataFrame, code: Code) -> tuple[list[list[bytes]], list[list[bytes]]]:
    """Tables of 64 stretched predictions a slot, as scaled bytes, in compressed pieces; their size is fixed by SLOT_BITS (40 MB unpacked).

    Those of all texts, and those of each half.
    """
    tables = len(SLOT_BITS)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        k, part = key[0].as_py(), key[1].as_py()
        slots = 1 << (SLOT_BITS[k] - 6)
        size = slots << CELL_BITS
        ns, seen = np.zeros((2, 2, size)), np.zeros((2, slots))
        for half in (0, 1):
            pairs = [_unpack(blob) for of, blob in zip(table.column("table").to_pylist(), table.column("cells").to_pylist(), strict=True) if of // tables == half]
            if not pairs:
                continue
            cells, sums = _summed(np.concatenate([c for c, _ in pairs]), np.concatenate([n for _, n in pairs]))
            slot, byte = np.divmod(cells - (part * slots << 8), 256)
            seen[half] = np.bincount(slot, sums, slots)
            for d in range(len(code.sign)):
                for bit, s in enumerate((-1, 1)):
                    on = code.sign[d][byte] == s
                    ns[half, bit] += np.bincount((slot[on] << CELL_BITS) + code.cell[d][byte[on]], sums[on], size)
        pieces = []
        for n, times in ((ns.sum(0), seen.sum(0)), *zip(ns, seen, strict=True)):
            out = np.clip(np.rint(np.log((n[1] + DELTA) / (n[0] + DELTA)) * SCALE), -127, 127).astype(np.int8)
            out[:: 1 << CELL_BITS] = np.searchsorted(SEEN, times, side="right")
            pieces.append(zlib.compress(out.tobytes(), 1))
        return pa.table({"table": pa.array([k, k + tables, k + 2 * tables], pa.int32()), "part": pa.array([part] * 3, pa.int32()), "piece": pa.array(pieces, pa.binary())})

    pieces = [[b""] * PARTS for _ in range(3 * tables)]
    for row in counts.where("table >= 0").groupBy((F.col("table") % tables).alias("k"), "part").applyInArrow(run, "table int, part int, piece binary").toLocalIterator():
        pieces[row["table"]][row["part"]] = bytes(row["piece"])
    return pieces[:tables], pieces[tables:]


_unpacked: dict[int, list[np.ndarray]] = {}


def unpack(key: int, pieces: list[list[bytes]]) -> list[np.ndarray]:
    """The tables, unpacked once a worker; only the latest model is held."""
    if key not in _unpacked:
        _unpacked.clear()
        tables = [np.zeros(1 << (bits + CELL_BITS), np.int8) for bits in SLOT_BITS * (len(pieces) // len(SLOT_BITS))]
        for table, parts in zip(tables, pieces, strict=True):
            size = len(table) // PARTS
            for k, piece in enumerate(parts):
                if piece:
                    table[k * size : (k + 1) * size] = np.frombuffer(zlib.decompress(piece), np.int8)
        _unpacked[key] = tables
    return _unpacked[key]


def byte_nats(data: np.ndarray, first: np.ndarray, last: np.ndarray, code: Code, tables: list[np.ndarray], start: np.ndarray, seen: list | None = None) -> np.ndarray:
    """Cost of each byte from the PAD-th on (0 where none is coded). start: weights by gate and table. seen: collects predictions, signs and gates."""
    base = _slots(data)
    for s in base:
        s <<= CELL_BITS
    target, first, last = data[PAD:], first - PAD, last - PAD
    nats = np.zeros(len(target), np.float32)
    weights = np.repeat(start[None].astype(np.float32) / np.float32(SCALE), len(first), axis=0)
    bits, live, done, size = np.zeros((len(first), GATES)), np.arange(len(first)), 0, FIRST_BLOCK
    while len(live):
        left = last[live] - first[live] - done
        for own, refine in ((live[left <= size], False), (live[left > size], seen is None)):
            n = np.minimum(last[own] - first[own] - done, size)
            for a, b in _runs(np.cumsum(n), 1 << 15):
                _code_block(own[a:b], n[a:b], first, done, target, base, code, tables, weights, bits, nats, refine, seen)
        live, done, size = own, done + size, min(2 * size, LAST_BLOCK)
    return nats


def _runs(total: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(total):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + size, side="right")))
        yield i, j
        i = j


def _lines(tables: list[np.ndarray], rows: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The first cells of some rows of each table, one row after another."""
    return [t.view(np.int64).reshape(-1, size // 8).take(r // size, axis=0, mode="clip").view(np.int8).ravel() for t, r in zip(tables, rows, strict=True)]


def _line_sizes(code: Code) -> list[int]:
    """How many cells, for each depth of the code, reach its nodes and those above."""
    return [next(n for n in LINES if n > c) for c in np.maximum.accumulate(code.cell.max(1))]


def _multiplied(cost: np.ndarray, odds: np.ndarray, more: np.ndarray, d: int) -> None:
    """Multiplies the odds of the first positions by those of their bit at depth d; after AT_ONCE bits their logarithm becomes cost."""
    own = odds[: len(more)]
    own *= more
    if d % AT_ONCE == AT_ONCE - 1:
        cost[: len(more)] += np.log(own)
        own[:] = 1


def _code_block(live, n, first, done, target, base, code, tables, weights, bits, nats, refine, seen) -> None:
    """One block of each of some texts: its costs and, unless it is their last, the gradient step that follows it."""
    at = np.repeat(first[live] + done - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    short = 255 - code.length.take(target.take(at, mode="clip"), mode="clip")
    order = np.argsort(short, kind="stable")  # longest codes first: what is left at a depth is a slice
    left = np.searchsorted(short[order], 255 - np.arange(len(code.sign) + 1))  # lengths above 0, 1, ...
    at, key = at.take(order, mode="clip"), np.repeat(np.arange(len(live)) * GATES, n).take(order, mode="clip")
    byte = target.take(at, mode="clip").astype(np.int64)
    rows = [x.take(at, mode="clip") for x in base]
    sizes = _line_sizes(code)
    size = sizes[0]
    lines, near = _lines(tables, rows, size), np.arange(0, len(at) * size, size)
    key += lines[-2][::size] * np.int64(len(SEEN) + 1)
    key += lines[-1][::size]
    own = np.ascontiguousarray(weights[live].reshape(-1, len(tables)).T)
    w = [x.take(key, mode="clip") for x in own]
    cost, odds, steps = np.zeros(len(at), np.float32), np.ones(len(at), np.float32), [np.zeros(len(at), np.float32) for _ in tables] if refine else []
    for d in range(len(code.sign)):
        m = int(left[d])
        if not m:
            break
        cell, sign = code.cell[d].take(byte[:m], mode="clip"), code.sign[d].take(byte[:m], mode="clip")
        if sizes[d] > size:
            size = sizes[d]
            lines, near = _lines(tables, [r[:m] for r in rows], size), np.arange(0, m * size, size)
        cell += near[:m]
        x = [line.take(cell, mode="clip").astype(np.float32) for line in lines]
        if seen is not None:
            seen.append((np.stack(x, 1), sign, key[:m] % GATES))
        dot = x[0] * w[0][:m]
        for k in range(1, len(x)):
            dot += x[k] * w[k][:m]
        dot *= -sign
        np.clip(dot, -14, 14, out=dot)
        e = np.exp(dot, out=dot)
        more = e + np.float32(1)
        _multiplied(cost, odds, more, d)
        if refine:
            e /= more
            e *= sign
            for k, v in enumerate(x):
                v *= e
                steps[k][:m] += v
    nats[at] = cost + np.log(odds)
    if refine:
        size = len(live) * GATES
        sums = np.stack([np.bincount(key, s, size) for s in steps], 1).reshape(len(live), GATES, -1)
        bits[live] += np.bincount(key, code.length.take(byte, mode="clip"), size).reshape(len(live), GATES)
        weights[live] += (sums / (SCALE**2 * (STIFF + GAIN * bits[live]))[:, :, None]).astype(np.float32)


def fit_weights(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: Code, tables: list[np.ndarray]) -> np.ndarray:
    """Weights by gate and table: each gate's logistic regression, by Newton steps, with a ridge towards an even mix."""
    even = np.full((GATES, len(tables)), 1.2 / len(tables))
    seen: list = []
    byte_nats(*_laid_out(raw, starts, ends), code, tables, even, seen)
    if not seen:
        return even
    x, y, gate = np.concatenate([a for a, _, _ in seen]) / np.float32(SCALE), np.concatenate([b for _, b, _ in seen]), np.concatenate([c for _, _, c in seen])
    for g in range(GATES):
        own, sign, w, ridge = x[gate == g].astype(float), y[gate == g], even[g].copy(), 20.0
        cost = lambda w: np.logaddexp(0, -sign * (own @ w)).sum() + ridge / 2 * ((w - even[g]) ** 2).sum()  # noqa: B023, E731
        now = cost(w)
        for _ in range(12):
            p = 1 / (1 + np.exp(np.clip(sign * (own @ w), -30, 30)))
            step = np.linalg.solve((own * (p * (1 - p))[:, None]).T @ own + ridge * np.eye(len(w)), (own * (sign * p)[:, None]).sum(0) - ridge * (w - even[g]))
            while (then := cost(w + step)) > now and np.abs(step).max() > 1e-6:
                step /= 2
            if then >= now:
                break
            w, now = w + step, then
        even[g] = w
    return even


def _alike(slots: list[np.ndarray], byte: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each group of positions with equal slots, byte and kind (below 4), and how many it stands for, by the slots of five bytes; a group may come in parts. At most 2 ** ALIKE_BITS positions."""
    known, order = np.empty(len(byte), np.uint64), np.empty(len(byte), np.uint64)
    u = np.uint64
    for a in range(0, len(byte), STRETCH):
        two, three, five, word = (x[a : a + STRETCH].astype(u) for x in slots)
        rest = five | word << u(18) | byte[a : a + STRETCH].astype(u) << u(36) | kind[a : a + STRETCH].astype(u) << u(44) | two << u(46)
        known[a : a + STRETCH] = rest
        mixed = ((rest * _P) >> u(64 - 25)) + (three << u(9))  # where all else is equal, three slots differ in these 25 bits
        mixed &= u((1 << 25) - 1)
        order[a : a + STRETCH] = five << u(46) | mixed << u(ALIKE_BITS) | np.arange(a, a + len(rest), dtype=u)
    order.sort()
    at = (order & u((1 << ALIKE_BITS) - 1)).view(np.int64)
    order >>= u(ALIKE_BITS)
    known = known.take(at, mode="clip")
    first = np.flatnonzero(np.concatenate([[True], (order[1:] != order[:-1]) | (known[1:] != known[:-1])]))
    return at.take(first, mode="clip"), np.diff(first, append=len(at))


SUMS = 2 + len(SLOT_BITS) + len(SLOT_BITS) ** 2


def _parts(begin: int, ends: list[int]) -> Iterator[tuple[int, list[int]]]:
    """Stretches of what begins and ends, at each depth, there."""
    for a in range(begin, ends[0], STRETCH // 2):
        b = min(a + STRETCH // 2, ends[0])
        yield a, [min(max(e, a), b) for e in ends]


def newton_sums(data: np.ndarray, first: np.ndarray, last: np.ndarray, other: np.ndarray, code: Code, tables: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    """By gate: cost, bits, gradient and curvature of the weights ``start`` over all bits of some texts, in whole numbers.

    tables: of each half; a text's predictions are those of the half it is not of (``other``: of the second).
    Predictions are in bytes as in the tables, all else in units of 1 / FINE, so sums do not depend on their order.
    """
    out, curve = np.zeros((GATES, SUMS), np.int64), np.zeros((GATES, len(SLOT_BITS), len(SLOT_BITS)), np.int64)  # curve: above the diagonal
    k, weights = len(SLOT_BITS), start.astype(np.float32) / np.float32(SCALE)
    slots = _slots(data)  # kind: the half that a byte is of, 2 where none is coded
    kind = np.repeat(np.stack([other.astype(np.int8), np.full(len(other), 2, np.int8)], 1).ravel(), np.stack([last - first, np.full(len(other), PAD)], 1).ravel())[: len(data) - PAD]
    sizes = _line_sizes(code)
    classes = [np.concatenate([tables[i + k][:: 1 << CELL_BITS], tables[i][:: 1 << CELL_BITS]]) for i in (k - 2, k - 1)]  # of slots, by half
    for a in range(0, len(kind), 1 << ALIKE_BITS):
        b = a + (1 << ALIKE_BITS)
        at, times = _alike([s[a:b] for s in slots], data[PAD:][a:b], kind[a:b])
        at += a
        half = kind.take(at, mode="clip").astype(np.int64)
        seen = [c.take(slots[i].take(at, mode="clip") + (half << SLOT_BITS[i]), mode="clip") for i, c in zip((k - 2, k - 1), classes, strict=True)]
        group = (half * GATES + seen[0] * np.int64(len(SEEN) + 1) + seen[1]) * 64 + (63 - code.length.take(data[PAD:].take(at, mode="clip"), mode="clip").astype(np.int64))
        order = np.argsort(group.astype(np.uint16), kind="stable")  # by half and gate, longest codes first
        at, times, group = at.take(order), times.take(order).astype(float), group.take(order)
        byte, rows, until = data[PAD:].take(at, mode="clip").astype(np.int64), [s.take(at, mode="clip").astype(np.int64) << CELL_BITS for s in slots], np.cumsum(times) - times
        for h, g in np.ndindex(2, GATES):
            begin, *ends = np.searchsorted(group, (h * GATES + g) * 64 + np.array([0, *(63 - np.arange(len(code.sign)))])).tolist()
            mine = tables[k * (1 - h) : k * (2 - h)]
            for begin, ends in _parts(begin, ends):
                size = 0
                cost, odds = np.zeros(ends[0] - begin, np.float32), np.ones(ends[0] - begin, np.float32)
                for d, end in enumerate(ends):
                    if end <= begin:
                        break
                    n, own = times[begin:end], byte[begin:end]
                    cell, sign = code.cell[d].take(own, mode="clip"), code.sign[d].take(own, mode="clip")
                    x = np.empty((k, end - begin))
                    if sizes[d] > size:
                        size = sizes[d]
                        lines, near = _lines(mine, [r[begin:end] for r in rows], size), np.arange(0, (end - begin) * size, size)
                    cell += near[: end - begin]
                    for i, line in enumerate(lines):
                        x[i] = line.take(cell, mode="clip")
                    e = x[0] * weights[g, 0]
                    for i in range(1, k):
                        e += x[i] * weights[g, i]
                    e = e.astype(np.float32)
                    e *= -sign
                    e = np.exp(np.clip(e, -14, 14, out=e), out=e)
                    more = e + np.float32(1)
                    e /= more
                    _multiplied(cost, odds, more, d)
                    out[g, 1] += int(until[end - 1] + times[end - 1] - until[begin])
                    out[g, 2 : 2 + k] += (x @ (np.rint(e * sign * FINE).astype(float) * n)).astype(np.int64)
                    e *= 1 - e
                    bend = np.rint(e * FINE).astype(float) * n
                    for i in range(k):
                        curve[g, i, i:] += (x[i:] @ (x[i] * bend)).astype(np.int64)
                out[g, 0] += int(np.rint((cost + np.log(odds)) * FINE) @ times[begin : ends[0]])
    out[:, 2 + k :] = (curve + np.triu(curve, 1).transpose(0, 2, 1)).reshape(GATES, -1)
    return out


def mixed_nats(data: np.ndarray, first: np.ndarray, last: np.ndarray, nats: np.ndarray, counts: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Cost of each text once its words are mixed with what their counts say. counts: of each word, in order; seen: of bytes and words, in training.

    A word with what ends it (a blank or the end) costs what its bytes do, or
    what its share of all words and its end's share of all ends say; the two
    are mixed by how much each was to be believed on the text's words before.
    """
    target, first, last = data[PAD:], first - PAD, last - PAD
    ending = _LAST.take(target)
    ending[(last[:-1, None] + np.arange(PAD)).ravel()] = False  # blanks between texts
    stop = np.flatnonzero(ending)
    at = np.searchsorted(stop, first)
    text = np.repeat(np.arange(len(first)), np.diff(at, append=len(stop)))
    begin = np.concatenate([[0], stop[:-1] + 1])
    begin[at] = first
    a = np.add.reduceat(nats, np.stack([begin, stop + 1], 1).ravel()[:-1], dtype=np.float64)[::2] if len(stop) else np.zeros(0)
    if not seen[256]:
        return np.bincount(text, a, len(first))
    ends = seen[:256] * _LAST
    likely = np.zeros(len(stop))
    likely[stop > begin] = counts
    with np.errstate(divide="ignore"):
        b = -np.log(likely / max(int(seen[256]), 1)) - np.log(ends / max(int(ends.sum()), 1))[target[stop]]
        least = np.minimum(a, b)
        p, q = np.exp(least - a), np.exp(least - b)  # over the greater of the two, so that neither is too great or both too small
        begun = at[text]
        place, share = np.arange(len(stop)) - begun + sum(BELIEF), np.full(len(stop), BELIEF[0] / sum(BELIEF))
        for _ in range(ROUNDS):
            right = share * q
            right /= right + (1 - share) * p
            sums = np.cumsum(right) - right
            share = (BELIEF[0] + sums - sums[begun]) / place
        return np.bincount(text, least - np.log(share * q + (1 - share) * p), len(first))


@dataclass
class Model:
    """What scoring needs: the code, tables in pieces, weights and counts of bytes and words."""

    code: Code
    pieces: list[list[bytes]]
    start: np.ndarray
    seen: np.ndarray


def learn(docs: DataFrame, text: str = "text") -> Model:
    """A model of all texts of ``docs``. Mixing weights maximise the likelihood of all of them, each predicted from the half of the texts that it is not of."""
    spark = docs.sparkSession
    other = F.coalesce(F.pmod(F.xxhash64(text, F.lit(3)), F.lit(2)) == 1, F.lit(False))
    counts = context_counts(docs, other, text)
    seen = byte_counts(counts)
    code = code_of(seen[:256])
    pieces, halves = stretch_tables(counts, code)
    shared = spark.sparkContext.broadcast((code, halves))
    return Model(code, pieces, fit_all(docs, other, shared, _first_weights(docs, other, shared, text), text), seen)


def _first_weights(docs: DataFrame, other: Column, shared: Broadcast, text: str) -> np.ndarray:
    """Weights that suit about FIT_BYTES of the first half, fitted in one task: where the fit on all texts starts, so that it takes few steps."""
    total = docs.where(~other).agg(F.sum(F.octet_length(text))).first()[0] or 0
    share = min(1.0, FIT_BYTES / max(total, 1))
    some = docs.where(~other & (F.pmod(F.xxhash64(text, F.lit(4)), F.lit(1 << 30)) < int(share * (1 << 30))) & (F.octet_length(text) <= LONGEST_FIT))
    key = -1 - shared._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, halves = shared.value
        texts = sorted(t for batch in batches for t in batch.column(0).to_pylist())
        if texts:
            ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
            w = fit_weights(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends, code, unpack(key, halves)[len(SLOT_BITS) :])
            yield pa.record_batch({"w": pa.array(w.ravel())})

    w = [r["w"] for r in some.select(F.col(text).cast("binary").alias("text")).repartition(1).mapInArrow(run, "w double").collect()]
    return np.array(w).reshape(GATES, -1) if w else np.full((GATES, len(SLOT_BITS)), 1.2 / len(SLOT_BITS))


def fit_all(docs: DataFrame, other: Column, shared: Broadcast, start: np.ndarray, text: str = "text") -> np.ndarray:
    """Weights by gate and table that all texts of ``docs`` are likeliest with, by Newton steps from ``start``, each of sums over all texts; a ridge towards an even mix.

    Steps go on until one promises less than LITTLE of the cost; one that raised the cost is halved.
    """
    key, k = -1 - shared._jbroadcast.id(), len(SLOT_BITS)

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code, halves = shared.value
            out = np.zeros((GATES, SUMS), np.int64)
            for batch in batches:
                raw, starts, ends = flat(batch.column(0))
                others = batch.column(1).to_numpy(zero_copy_only=False)
                for i, j in slices(starts, ends, 1 << ALIKE_BITS):
                    out += newton_sums(*_laid_out(raw, starts[i:j], ends[i:j]), others[i:j], code, unpack(key, halves), w)
            yield pa.record_batch({"i": pa.array(np.arange(out.size), pa.int32()), "v": pa.array(out.ravel())})

        rows = docs.select(text, other.alias("other")).where(F.col(text).isNotNull()).mapInArrow(run, "i int, v long")
        out = np.zeros(GATES * SUMS)
        for r in rows.groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("v")).collect():
            out[r["i"]] = float(r["v"])
        return out.reshape(GATES, SUMS)

    even, ridge = np.full((GATES, k), 1.2 / k), 20.0
    w, before, cost = start, start, np.inf
    for _ in range(40):
        s = sums(w) / FINE
        now = s[:, 0].sum() + ridge / 2 * ((w - even) ** 2).sum()
        if now > cost:
            w = (w + before) / 2
            continue
        slope = s[:, 2 : 2 + k] / SCALE - ridge * (w - even)
        step = np.linalg.solve(s[:, 2 + k :].reshape(GATES, k, k) / SCALE**2 + ridge * np.eye(k), slope[:, :, None])[:, :, 0]
        before, cost, w = w, now, w + step
        if (slope * step).sum() / 2 <= LITTLE * now:
            break
    return w


def _dealt(docs: DataFrame, keep: str, train: Column, text: str, block_bytes: int) -> DataFrame:
    """Rows by block of about ``block_bytes``; equal rows of different scan splits are dealt apart."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    block = F.pmod(F.xxhash64(F.col(keep), F.col(text), F.spark_partition_id()), F.lit(blocks)).cast("int")
    return docs.select(F.col(keep), train.alias("train"), body.alias("body"), block.alias("block")).repartition(blocks, "block")


def _words(body: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, A-Z lower-cased, and the number of the text that each is of."""
    if isinstance(body, pa.ChunkedArray):
        body = body.combine_chunks()
    words = pc.ascii_split_whitespace(pc.ascii_lower(body.cast(pa.binary()).view(pa.string())))
    of, flat_words = pc.list_parent_indices(words), words.flatten()
    some = pc.not_equal(flat_words, "")
    return flat_words.filter(some).view(pa.binary()), of.filter(some).to_numpy()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, token, n: distinct tokens of a block, with their counts in training texts; a token may come more than once."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        held.clear()
        blocks = table.column("block").to_numpy()
        for block in np.unique(blocks):
            rows = table.filter(pa.array(blocks == block))
            learned, others = (_words(rows.filter(on).column("body"))[0] for on in (rows.column("train"), pc.invert(rows.column("train"))))
            counts, more = learned.value_counts(), others.unique()
            more = more.filter(pc.invert(pc.is_in(more, value_set=counts.field(0))))
            for token, n in ((counts.field(0), counts.field(1)), (more, pa.array(np.zeros(len(more), np.int64)))):
                yield pa.record_batch({"block": pa.array(np.full(len(token), block, np.int32)), "token": token, "n": n})

    for batch in batches:
        held.append(batch.select(["train", "body", "block"]))
        if sum(b.nbytes for b in held) > TOKENS_BYTES:
            yield from out()
    if held:
        yield from out()


def score_texts(docs: DataFrame, train: Column, keep: str = "doc_id", text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The ``keep`` column, train, n_tokens, n_known, train_tokens, base_score, score, total_bits and bits_per_byte.

    train: which rows are learned from (null: not). base_score is the sum over
    a text's tokens of log10((c + 1) / (N + V + 1)), with c the token's count,
    N all and V the distinct tokens of the training texts; tokens are words,
    A-Z lower-cased, and one end. score is the mixing model's log10 probability
    of the lower-cased text, white space included, and its end; total_bits is
    the same in bits, and bits_per_byte divides it by bytes and end. Null texts
    are empty: one end.

    Without training rows, N is 0 and all bits are even. Equal texts score
    alike; repeated rows stay; an empty table gives no rows. Texts are whole,
    however long; blocks of about ``block_bytes`` bound what a task holds,
    beyond its longest text. Other columns are not read.
    """
    spark = docs.sparkSession
    train = F.coalesce(train, F.lit(False))
    model = spark.sparkContext.broadcast(learn(docs.where(train), text))
    model_id = model._jbroadcast.id()
    rows = _dealt(docs, keep, train, text, block_bytes)
    words = rows.mapInArrow(_tokens, "block int, token binary, n long")
    of = Window.partitionBy("token").orderBy("block")  # one sort for both
    asked = words.select("block", "token", F.sum("n").over(of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("c"), "n", (F.row_number().over(of) == 1).alias("once"))
    kind = docs.schema[keep].dataType.simpleString()
    schema = f"`{keep}` {kind}, train boolean, n_tokens long, n_known long, n_end long, log_counts double, nats double, n_bytes long, sum_n long, sum_v long"

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        words, of = _words(docs.column("body"))
        c = asked.column("c").to_numpy()[pc.index_in(words, value_set=asked.column("token").combine_chunks().cast(pa.binary())).to_numpy()] if len(words) else np.zeros(0, np.int64)
        raw, starts, ends = flat(docs.column("body"))
        it: Model = model.value
        tables = unpack(model_id, it.pieces)
        n, hit, logs, nats = np.bincount(of, minlength=len(starts)), np.bincount(of[c > 0], minlength=len(starts)), np.bincount(of, np.log10(c + 1.0), len(starts)), np.zeros(len(starts))
        until = np.concatenate([[0], np.cumsum(n)])
        for i, j in slices(starts, ends, CHUNK):
            laid = _laid_out(raw, starts[i:j], ends[i:j])
            nats[i:j] = mixed_nats(*laid, byte_nats(*laid, it.code, tables, it.start), c[until[i] : until[j]], it.seen)
        m, once = len(n), asked.column("once").to_numpy().astype(bool)
        sums = [int(np.sum(asked.column("n").to_numpy())), int((once & (asked.column("c").to_numpy() > 0)).sum())] if asked.num_rows else [0, 0]
        ints = lambda x: pa.array(x, pa.int64())
        first = [k == 0 for k in range(m)]
        cols = [ints(n), ints(hit), ints([int(t) for t in docs.column("train").to_pylist()]), pa.array(logs), pa.array(nats), ints(ends - starts), ints([sums[0] if f else 0 for f in first]), ints([sums[1] if f else 0 for f in first])]
        return pa.table([docs.column(keep), docs.column("train"), *cols], names=[keep, "train", "n_tokens", "n_known", "n_end", "log_counts", "nats", "n_bytes", "sum_n", "sum_v"])

    scored = cut(rows.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, schema), "lm-scores")
    all_sums = scored.agg((F.sum("sum_n") + F.sum("n_end")).alias("n_all"), (F.sum("sum_v") + F.max(F.col("n_end"))).alias("v_all"), F.sum("n_end").alias("ends"))
    told = scored.crossJoin(F.broadcast(all_sums))  # one row
    n_tokens = F.col("n_tokens") + 1
    return told.select(
        keep, "train", n_tokens.alias("n_tokens"), (F.col("n_known") + (F.col("ends") > 0).cast("long")).alias("n_known"), F.col("n_all").alias("train_tokens"),
        (F.col("log_counts") + F.log10(F.col("ends") + 1.0) - n_tokens * F.log10(F.col("n_all") + F.col("v_all") + 1.0)).alias("base_score"),
        F.round(-F.col("nats") / F.lit(float(np.log(10))), 4).alias("score"), F.round(F.col("nats") / F.lit(float(np.log(2))), 4).alias("total_bits"),
        F.round(F.col("nats") / F.lit(float(np.log(2))) / (F.col("n_bytes") + 1), 6).alias("bits_per_byte"),
    )
