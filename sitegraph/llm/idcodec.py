"""Token ids as compressed frames: an adaptive context-mixing range coder.

An id's chance is a mixture of three predictions. The order-2 model names the id
that followed the last two ids before, the order-1 model the one that followed
the last id, each with a confidence; the order-0 model spreads the rest over all
ids, by classes of their rank in the frame. How much weight each prediction and
each class gets is learned, apart for every pair of confidences. One step of the
range coder takes the share, a second one the id's place in its class.

A frame holds whole documents, and the ids it uses by falling frequency. Its ids
are cut in blocks of ``BLOCK``, each coded from a fresh model and with its own
checksum, so that no block needs another one, and damage is found in its block.
Model and coder work on all blocks of a frame in step, one id of each at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: ids per block; ids per frame at least (a frame ends with a document)
BLOCK, FRAME = 2048, 1 << 23
#: ids are below this
LIMIT = 1 << 16
_MAGIC = b"IDF4"
_HEAD = "<4sIQIII"

_SLOTS = 1 << 8  # of each order, in each block
_SHARES = 16
_STATES = 32
_UNIT = 15  # shares sum to 2**15
_ROOM, _HALF = np.uint64(1 << 32), np.uint64((1 << 32) - 1)
_W15, _W32 = np.uint64(_UNIT), np.uint64(32)
_PLACE = np.arange(_SHARES, dtype=np.int16)
#: a row of shares, moved as one value
_ROW = np.dtype("V32")
#: what the shares' lower ends move towards when a share was taken; every share keeps a part
_AIM = np.ascontiguousarray(np.where(_PLACE[None, :] > _PLACE[:, None], (1 << _UNIT) - _SHARES + _PLACE, _PLACE).astype(np.int16)).view(_ROW).reshape(-1)
#: share of a rank that was not guessed (ranks 0 and 1 have one), and the bits of a rank's place in a share
_CLASS = (np.clip(np.frexp(np.arange(LIMIT))[1], 1, _SHARES - 2) + 1).astype(np.uint8)
_BITS = np.array([0, 0, 1, *range(1, _SHARES - 3), 16], dtype=np.uint64)
_MASK = ((1 << _BITS) - 1).astype(np.uint64)
#: the lowest rank of a share; the last share holds whole ranks
_FIRST = np.array([0, 0, 0, *(1 << k for k in range(1, _SHARES - 3)), 0], dtype=np.uint64)
_SIZE = np.int16((1 << _UNIT) - 1)
_LAST = np.uint64((1 << _UNIT) - 1)
_HASH = np.array([[0x9E3779B1], [0]], dtype=np.uint32), np.uint32(0x85EBCA77)
_TOP = np.uint32(24)
#: a slot is a guess, below 2**14, and two bits of its confidence above it; higher ranks are no guess's
_CONF = np.uint16(14)
_GUESS, _NONE, _FULL = np.uint16((1 << _CONF) - 1), np.uint16(1 << _CONF), np.uint16(3 << _CONF)
_FOURFOLD = np.uint64(0x0001000100010001)


class _Blocks:
    """The models of all blocks of a frame, and their coders' states."""

    def __init__(self, n: int) -> None:
        # by order, slot and block, so that what many blocks use lies together
        self.slots = np.zeros(n * 2 * _SLOTS, np.uint16)
        even = (np.arange(_SHARES) * ((1 << _UNIT) // _SHARES)).astype(np.int16)
        # by state and block
        self.shares = np.tile(even, (_STATES * n, 1)).view(_ROW).reshape(-1)
        # the rows at work, and a zero behind: the lower end of a row is 0, or 2**15 for the row before
        self.now = np.zeros((n + 1) * _SHARES, np.int16)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
        self.spots = np.zeros((n, _SHARES // 4), np.uint64)
        self.every, self.place = np.arange(n), np.arange(n) * _SHARES
        self.wide = np.uint32(n)
        self.base = self.every + np.array([[0], [_SLOTS * n]])

    def step(self, n: int, pace: int, before: np.ndarray, last: np.ndarray, ranks: np.ndarray | None, share: np.ndarray | None) -> np.ndarray:
        """Code one rank of each of the first ``n`` blocks, or read it, after the two ranks ahead.

        ``share``: where each rank lies if it is not guessed.
        """
        key = before * _HASH[0]
        key ^= last * _HASH[1]
        key >>= _TOP
        key *= self.wide
        key = key + self.base[:, :n]
        slots = self.slots.take(key)
        guess, sure = slots & _GUESS, (slots >> _CONF).astype(np.uint8)
        state = sure[0] * np.uint8(4)
        state += sure[1]
        state += (guess[0] == guess[1]).view(np.uint8) * np.uint8(16)
        row = state * self.wide
        row = row + self.every[:n]
        flat = self.now[:(n + 1) * _SHARES]
        rows = flat[:-_SHARES].view(_ROW)
        self.shares.take(row, out=rows, mode="clip")
        low, wide = self.low[:n], self.range[:n]
        unit = wide >> _W15
        if ranks is None:
            ahead = self.code[:n] - low
            spot = np.minimum(ahead // unit, _LAST) * _FOURFOLD
            spots = self.spots[:n]
            for k in range(_SHARES // 4):
                spots[:, k] = spot
            below = np.bitwise_count((flat[:-_SHARES] <= spots.view(np.int16).reshape(-1)).view(np.uint64)).reshape(n, 2)
            share = np.add(below[:, 0], below[:, 1], dtype=np.int64)
            share -= 1
        else:
            hit = guess == ranks
            share = share.copy()
            np.copyto(share, 1, where=hit[1])
            np.copyto(share, 0, where=hit[0])
            share = share.astype(np.int64)
        at = share + self.place[:n]
        begin = flat.take(at)
        at += 1
        size = flat.take(at)
        size -= begin
        size &= _SIZE
        below = begin.astype(np.uint64)
        below *= unit
        low += below
        unit *= size.astype(np.uint64)
        unit >>= _BITS.take(share)
        mask = _MASK.take(share)
        if ranks is None:
            ahead -= below
            place = np.minimum(ahead // unit, mask)
            ranks = (place + _FIRST.take(share)).astype(np.uint16)
            np.copyto(ranks, guess[1], where=share == 1)
            np.copyto(ranks, guess[0], where=share == 0)
            hit = guess == ranks
        else:
            place = mask
            place &= ranks.astype(np.uint64)
        place *= unit
        low += place
        wide[:] = unit
        self.settle(n)
        move = _AIM.take(share).view(np.int16)
        move -= flat[:-_SHARES]
        move >>= pace
        flat[:-_SHARES] += move
        self.shares[row] = rows
        # a guess that held gains confidence, another loses it and goes when it has none
        move = (hit & (slots < _FULL)).view(np.int8) + hit.view(np.int8)
        move -= np.int8(1)
        new = move.astype(np.uint16)
        new <<= _CONF
        new += slots
        np.copyto(new, ranks & _GUESS, where=(slots < _NONE) > hit)
        self.slots[key] = new
        return ranks

    def settle(self, n: int) -> None:
        """Make room where the range has become small, by moving out the upper half of the low end.

        Where the range reaches over a change of that half it is cut off there:
        now and then a bit is lost, and no carry can ever reach what is out. A rank
        takes 31 bits at most, so there is room enough behind.
        """
        blocks = np.flatnonzero(self.range[:n] < _ROOM)
        if not len(blocks):
            return
        low, wide = self.low.take(blocks), self.range.take(blocks)
        rest = _ROOM - (low & _HALF)
        np.minimum(wide, rest, out=wide)
        wide <<= _W32
        self.shift(blocks, low)
        low <<= _W32
        self.low[blocks], self.range[blocks] = low, wide


class _Writer(_Blocks):
    def __init__(self, n: int) -> None:
        super().__init__(n)
        self.log: list[tuple[np.ndarray, np.ndarray]] = []

    def shift(self, blocks: np.ndarray, low: np.ndarray) -> None:
        self.log.append((blocks.astype(np.uint32), (low >> _W32).astype(np.uint32)))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """How many words each block has, and all words, block after block."""
        for k in range(2):
            self.shift(self.every, self.low << np.uint64(32 * k))
        blocks, words = (np.concatenate(x) for x in zip(*self.log, strict=True))
        return np.bincount(blocks, minlength=len(self.every)), words[np.argsort(blocks, kind="stable")]


class _Reader(_Blocks):
    def __init__(self, counts: np.ndarray, words: np.ndarray) -> None:
        super().__init__(len(counts))
        self.words = np.concatenate([words, np.zeros(8, np.uint32)])
        self.at = np.cumsum(counts) - counts
        self.code = np.zeros(len(counts), np.uint64)
        for _ in range(2):
            self.shift(self.every, self.code)

    def shift(self, blocks: np.ndarray, low: np.ndarray) -> None:
        at = self.at.take(blocks)
        code = self.code.take(blocks)
        code <<= _W32
        code |= self.words.take(at, mode="clip")
        self.code[blocks] = code
        at += 1
        self.at[blocks] = at


def _sizes(n: int) -> np.ndarray:
    return np.minimum(BLOCK, n - np.arange(0, n, BLOCK)) if n else np.zeros(0, np.int64)


def _run(coder: _Blocks, sizes: np.ndarray, ranks: np.ndarray | None) -> np.ndarray:
    n, steps = len(sizes), int(sizes.max())
    out = np.zeros((steps, n), np.uint16) if ranks is None else ranks
    share = None if ranks is None else _CLASS[ranks]
    before, last = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for t in range(steps):
        # only the last block may be shorter; models learn slower as they learn
        m = n if sizes[-1] > t else n - 1
        pace = 3 if t < 32 else 4 if t < 256 else 5
        if ranks is None:
            out[t, :m] = coder.step(m, pace, before[:m], last[:m], None, None)
        else:
            coder.step(m, pace, before[:m], last[:m], ranks[t, :m], share[t, :m])
        before, last = last, before
        last[:m] = out[t, :m]
    return out


def encode_frame(doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Documents (``known`` is false where the id is null) with so many ids each, as one frame."""
    if len(ids) and int(ids.max()) >= LIMIT:
        raise ValueError(f"ids must be below {LIMIT}")
    sizes = _sizes(len(ids))
    times = np.bincount(ids, minlength=LIMIT)
    used = np.argsort(-times, kind="stable")[:np.count_nonzero(times)]
    rank = np.zeros(LIMIT, np.uint16)
    rank[used] = np.arange(len(used))
    counts, words = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if len(sizes):
        padded = np.zeros(len(sizes) * BLOCK, np.uint16)
        padded[:len(ids)] = rank[ids]
        coder = _Writer(len(sizes))
        _run(coder, sizes, np.ascontiguousarray(padded.reshape(len(sizes), BLOCK).T)[:int(sizes.max())])
        counts, words = coder.words()
    raw = ids.astype("<u4")
    sums = [zlib.crc32(raw[k:k + BLOCK].tobytes()) for k in range(0, len(ids), BLOCK)]
    head = struct.pack(_HEAD, _MAGIC, len(doc_ids), len(ids), len(sizes), BLOCK, len(used))
    head += doc_ids.astype("<i8").tobytes() + known.astype("<u1").tobytes() + lengths.astype("<u4").tobytes()
    head += used.astype("<u2").tobytes() + counts.astype("<u4").tobytes() + np.array(sums, dtype="<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + words.astype("<u4").tobytes()


def decode_frame(frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``doc_ids, known, lengths, ids`` of a frame; a wrong checksum is an error that names the block."""
    magic, docs, n, blocks, block, distinct = struct.unpack_from(_HEAD, frame)
    if magic != _MAGIC or block != BLOCK:
        raise ValueError("not a frame of ids")
    at, parts = struct.calcsize(_HEAD), []
    for kind, count in (("<i8", docs), ("<u1", docs), ("<u4", docs), ("<u2", distinct), ("<u4", blocks), ("<u4", blocks)):
        if at + np.dtype(kind).itemsize * count > len(frame):
            raise ValueError("the frame's head is damaged")
        parts.append(np.frombuffer(frame, kind, count, at))
        at += parts[-1].nbytes
    doc_ids, known, lengths, used, counts, sums = parts
    if frame[at:at + 4] != struct.pack("<I", zlib.crc32(frame[:at])):
        raise ValueError("the frame's head is damaged")
    ids = np.zeros(0, np.uint16)
    if blocks:
        counts = counts.astype(np.int64)
        out = _run(_Reader(counts, np.frombuffer(frame, "<u4", int(counts.sum()), at + 4)), _sizes(n), None)
        # ranks beyond the last come from damage only, which the checksum finds
        ids = used[np.minimum(np.ascontiguousarray(out.T).reshape(-1)[:n], distinct - 1)]
        raw = ids.astype("<u4")
        for k in range(blocks):
            if zlib.crc32(raw[k * BLOCK:(k + 1) * BLOCK].tobytes()) != sums[k]:
                raise ValueError(f"block {k} is damaged")
    return doc_ids, known.astype(bool), lengths.astype(np.int64), ids


def frames(docs: Iterator[tuple[int | None, np.ndarray]]) -> Iterator[tuple[int, bytes]]:
    """Documents one after another as frames of about ``FRAME`` ids, each with its number of ids."""
    ids, rows, total = [], [], 0

    def done() -> tuple[int, bytes]:
        return total, encode_frame(np.array([d or 0 for d in rows], np.int64), np.array([d is not None for d in rows]),
                                   np.array([len(x) for x in ids], np.int64), np.concatenate(ids))

    for doc, x in docs:
        rows.append(doc)
        ids.append(x)
        total += len(x)
        if total >= FRAME:
            yield done()
            ids, rows, total = [], [], 0
    if rows:
        yield done()
