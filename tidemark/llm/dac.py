"""Directly addressable codes: each id in levels of a few bits, so that any id can be read without decoding a block.

Level k holds bits [k*b, (k+1)*b) of every id that has them. A continuation bitmap per level says which ids go on to
the next level; a rank directory over it gives their place there.

File, little-endian: magic 'TDAC', version u32, count of ids u64, chunk bits u32, levels u32; then for each level
its number of entries u64, the entries (u8 or u16), and, but for the last level, the bitmap padded to 64-bit words
and the u32 count of ones before each word (so a file holds fewer than 2**32 ids).

Behind them may stand a directory of documents: for each its id i64, where its ids end u64, and whether its id is null
u8, one array after the other; then the number of documents u64, the place of the directory u64 and the magic 'TDIR'.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"TDAC"
HEAD = struct.Struct("<4sIQII")
TAIL = struct.Struct("<QQ4s")
TAIL_MAGIC = b"TDIR"


def encode(ids: np.ndarray, bits: int = 8) -> bytes:
    if bits not in (8, 16):
        raise ValueError("chunks have 8 or 16 bits")
    kind = np.dtype("<u1" if bits == 8 else "<u2")
    rest, parts = ids.astype(np.uint64), []
    while True:
        parts.append((rest & np.uint64((1 << bits) - 1)).astype(kind))
        more = rest >> np.uint64(bits) != 0
        if not more.any():
            break
        padded = np.zeros(-(-len(rest) // 64) * 64, dtype=np.uint8)
        padded[: len(rest)] = more
        words = np.packbits(padded, bitorder="little")
        ones = np.bitwise_count(words.view("<u8"))
        parts.append((words, np.concatenate(([0], np.cumsum(ones, dtype=np.uint64)))[:-1].astype("<u4")))
        rest = rest[more] >> np.uint64(bits)
    out = [HEAD.pack(MAGIC, 1, len(ids), bits, (len(parts) + 1) // 2)]
    for k, part in enumerate(parts):
        out += [struct.pack("<Q", len(part)), part.tobytes()] if k % 2 == 0 else [part[0].tobytes(), part[1].tobytes()]
    return b"".join(out)


def directory(keys: list[int | None], sizes: np.ndarray, at: int) -> bytes:
    """The directory of documents of ``sizes`` ids each, to be written at byte ``at``."""
    null = np.array([k is None for k in keys], dtype=np.uint8)
    ids = np.array([k or 0 for k in keys], dtype="<i8")
    return b"".join([ids.tobytes(), np.cumsum(sizes).astype("<u8").tobytes(), null.tobytes(), TAIL.pack(len(keys), at, TAIL_MAGIC)])


class Whole:
    """A file in memory, read like a file of ranges."""

    def __init__(self, raw):
        self.raw = memoryview(raw)

    def size(self) -> int:
        return len(self.raw)

    def read_at(self, n: int, at: int):
        return self.raw[at : at + n]


def documents(file) -> tuple[list[int | None], np.ndarray]:
    """Document ids, and where the ids of each end: two reads at the end of a file with ``size`` and ``read_at``."""
    end = file.size()
    n, at, magic = TAIL.unpack(file.read_at(TAIL.size, end - TAIL.size))
    if magic != TAIL_MAGIC:
        raise ValueError("no directory of documents")
    raw = file.read_at(17 * n, at)
    ids, ends, null = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n, 8 * n), np.frombuffer(raw, np.uint8, n, 16 * n)
    return [None if x else k for k, x in zip(ids.tolist(), null.tolist())], ends.astype(np.int64)


class Stored:
    """An array in a file: a slice is one read, and elements at any places are a read for each run of near ones."""

    #: Elements between two that are read along rather than skipped.
    NEAR = 512

    def __init__(self, file, kind: str, n: int, at: int):
        self.file, self.kind, self.n, self.at = file, np.dtype(kind), n, at

    @property
    def end(self) -> int:
        return self.at + self.n * self.kind.itemsize

    def __getitem__(self, which):
        size = self.kind.itemsize
        if isinstance(which, slice):
            a, b, _ = which.indices(self.n)
            return np.frombuffer(self.file.read_at(max(0, b - a) * size, self.at + a * size), self.kind)
        places = np.atleast_1d(np.asarray(which, dtype=np.int64))
        out = np.empty(len(places), dtype=self.kind)
        order = np.argsort(places, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(places[order]) > self.NEAR) + 1):
            if len(run):
                a, b = places[run[0]], places[run[-1]] + 1
                out[run] = self[int(a) : int(b)][places[run] - a]
        return out if np.ndim(which) else out[0]


class Reader:
    """Random access to the ids of one file, bytes or with ``size`` and ``read_at``: nothing but the heads of the levels is read
    before ids are asked for, and then what they need of each level."""

    def __init__(self, file):
        file = file if hasattr(file, "read_at") else Whole(file)
        magic, version, self.count, self.bits, levels = HEAD.unpack(file.read_at(HEAD.size, 0))
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        at = HEAD.size
        self.levels: list[tuple] = []
        for k in range(levels):
            (n,) = struct.unpack("<Q", file.read_at(8, at))
            entries = Stored(file, "<u1" if self.bits == 8 else "<u2", n, at + 8)
            at = entries.end
            if k == levels - 1:
                self.levels.append((entries, None, None))
                break
            words = Stored(file, "<u8", -(-n // 64), at)
            before = Stored(file, "<u4", words.n, words.end)
            at = before.end
            self.levels.append((entries, words, before))

    def __len__(self) -> int:
        return self.count

    def take(self, positions: np.ndarray) -> np.ndarray:
        """The ids at any positions."""
        at, out, live = np.asarray(positions, dtype=np.int64), np.zeros(len(positions), dtype=np.uint32), np.arange(len(positions))
        for level, (entries, words, before) in enumerate(self.levels):
            out[live] |= entries[at].astype(np.uint32) << np.uint32(level * self.bits)
            if words is None:
                break
            if not len(at):
                break
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            goes = (word >> bit) & np.uint64(1) != 0
            rank = before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            live, at = live[goes], rank[goes].astype(np.int64)
        return out

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids of a stretch: each level's part is contiguous, so one rank at either end finds it."""
        spans = []
        for entries, words, before in self.levels:
            if words is None:
                spans.append((start, stop, None))
                break
            if start == stop:
                spans.append((0, 0, np.zeros(0, dtype=bool)))
                start = stop = 0
                continue
            first = start >> 6
            own = words[first : -(-stop // 64)]
            bits = np.unpackbits(own.view(np.uint8), bitorder="little")[start - first * 64 : stop - first * 64].view(bool)
            spans.append((start, stop, bits))
            start = int(before[first]) + int(np.bitwise_count(own[0] & ((np.uint64(1) << np.uint64(start & 63)) - np.uint64(1))))
            stop = start + int(np.count_nonzero(bits))
        out = np.zeros(0, dtype=np.uint32)
        for (a, b, bits), (entries, _, _) in zip(reversed(spans), reversed(self.levels)):
            low = entries[a:b].astype(np.uint32)
            if bits is not None:
                low[bits] |= out << np.uint32(self.bits)
            out = low
        return out
