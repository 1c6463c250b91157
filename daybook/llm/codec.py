"""A coder of token ids: context mixing, arithmetic coding, blocks that can be read alone.

An id is first guessed: what most often follows the last two ids (order 2) or, where that says
nothing, what follows the last one (order 1). The chance that the guess holds is a logistic mix of
how often guesses of order 2, of order 1 and guesses at all (order 0, by the last two) held in the
like state. A missed guess is coded by the frequency of the id among missed ones, and an id that is
hardly ever missed by its digits.

Guesses, chances, weights of the mix and frequencies are learnt from all ids of a file before any is
coded, and stand in the file once. All blocks start from them and carry a checksum of their ids, so any
of them can be read alone. The model of all ids is then worked out at once, and blocks are coded
in step, one numpy lane a block; chances are in whole numbers, so a lane does not depend on its neighbours.
"""

from __future__ import annotations

import struct
import zlib
from functools import cached_property

import numpy as np

BLOCK = 4096
SHORT_BLOCK = 512
LANES = 512
MOST = 1 << 14  # missed ids in the table of frequencies
DENSE = 1 << 20  # ids below are looked up by place, others by search
MAGIC = b"DAYIDS02"
_PROB = 16  # bits of a probability
_CHUNK = 1 << 17  # ids looked at together, so that arrays stay in the processor's cache
_HASH1, _HASH2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_WHOLE, _LEAST, _LOW32 = 1 << 48, 1 << 32, (1 << 32) - 1

# Logistic function and its inverse on 12 bits, as whole numbers.
_X = np.arange(-2047, 2048) / 256.0
_SQUASH = np.clip(np.round(4096 / (1 + np.exp(-_X))), 1, 4095).astype(np.int32)
_P = (np.arange(4096) + 0.5) / 4096
_STRETCH = np.clip(np.round(np.log(_P / (1 - _P)) * 256), -2047, 2047).astype(np.int32)


def _slots(one: np.ndarray, two: np.ndarray, bits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the last id and of the last two; ids are unsigned 32-bit."""
    mixed = one * _HASH1
    return mixed >> np.uint32(32 - bits[0]), (two * _HASH1 + one * _HASH2) >> np.uint32(32 - bits[1])


def _before(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands one place and two places before each entry; nothing stands before a block."""
    one, two = np.zeros_like(ids), np.zeros_like(ids)
    one[1:], two[2:] = ids[:-1], ids[:-2]
    one[starts], two[starts] = 0, 0
    two[starts[starts + 1 < len(ids)] + 1] = 0
    return one, two


def _best(slots: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(most frequent id, how often, number of all ids) by slot."""
    wide = np.uint64 if ids.max(initial=0) >> 16 else np.uint32
    shift = wide(32 if wide is np.uint64 else 16)
    key = np.sort((slots.astype(wide) << shift) | ids.astype(wide))
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(at, len(key)))
    slot, own = (key[at] >> shift).astype(np.int64), (key[at] & wide((1 << int(shift)) - 1)).astype(np.int64)
    order = np.argsort((slot << 32) | count, kind="stable")  # the last of a slot is its best
    last = order[np.append(slot[order][1:] != slot[order][:-1], True)]
    best, often = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    best[slot[last]], often[slot[last]] = own[last], count[last]
    return best, often, np.bincount(slot, count, n).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte by byte, which packs better."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


class Learned:
    """Guesses, chances and frequencies, learnt from the ids of some blocks and kept beside their payloads."""

    def __init__(self, bits, guesses, hits, weights, ids, sizes):
        self.bits, self.guesses, self.hits, self.weights, self.ids, self.sizes = bits, guesses, hits, weights, ids, sizes
        cell = np.arange(2048)
        inputs = self._inputs(cell)
        dot = (inputs * weights).sum(1) >> 16
        self.chance = _SQUASH[np.clip(dot, -2047, 2047) + 2047].astype(np.int64) << (_PROB - 12)
        # Of missed ids those in the table by frequency; the last entry stands for all others.
        self.starts = np.cumsum(sizes) - sizes
        self.which = np.repeat(np.arange(len(sizes)), sizes)

    def _inputs(self, cell: np.ndarray) -> np.ndarray:
        p2, p1, p0 = self.hits[:16], self.hits[16:48], self.hits[48:]
        return np.stack([_STRETCH[p0[cell & 3]], _STRETCH[p1[((cell >> 3) & 15) << 1 | ((cell >> 2) & 1)]], _STRETCH[p2[cell >> 7]]], axis=1).astype(np.int64)

    @cached_property
    def _place(self) -> np.ndarray | None:
        """The place in the table of each id up to the largest there, if that is not too many."""
        if not len(self.ids) or self.ids[-1] >= DENSE:
            return None
        place = np.full(int(self.ids[-1]) + 2, len(self.ids), dtype=np.int64)
        place[self.ids] = np.arange(len(self.ids))
        return place

    def _listed(self, ids: np.ndarray) -> np.ndarray:
        """Places in the table of frequencies, its length for ids not there."""
        if self._place is not None:
            return self._place[np.minimum(ids, len(self._place) - 1)]
        at = np.searchsorted(self.ids, ids)
        return np.where(np.append(self.ids, -1)[at] == ids, at, len(self.ids))

    def guess(self, one: np.ndarray, two: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(guessed id, cell of its chance); the order 2 guess if there is one, else that of order 1."""
        at1, at2 = _slots(one, two, self.bits)
        e1, e2 = self.guesses[0][at1], self.guesses[1][at2]
        c2 = e2 & 15
        guess = np.where(c2 > 0, e2, e1) >> 4
        return guess, (c2 << 7) | ((e1 & 15) << 3) | (((e1 >> 4) == guess).astype(np.int64) << 2) | past

    @classmethod
    def of(cls, ids: np.ndarray, starts: np.ndarray) -> Learned:
        """Learn from all ids of blocks that begin at ``starts``."""
        n, even = len(ids), np.full(52, 2048, dtype=np.int64)
        if not n:
            return cls((1, 1), [np.zeros(2, dtype=np.int64)] * 2, even, np.zeros(3, dtype=np.int64), np.zeros(0, dtype=np.int64), np.array([1 << _PROB]))
        bits = (min(16, max(1, (n // 4).bit_length())), min(16, max(1, (n // 16).bit_length())))
        one, two = _before(ids, starts)
        at1, at2 = _slots(one, two, bits)
        first, second = _best(at1, ids, 1 << bits[0]), _best(at2, ids, 1 << bits[1])
        # A guess of order 2 is kept where it holds more often than that of order 1 does.
        plain = np.bincount(at2, first[0][at1] == ids, 1 << bits[1])
        tables = []
        for (best, often, total), kept in ((first, first[1] > 1), (second, second[1] > plain + 2)):
            odds = np.log((often + 0.4) / (total - often + 0.4))
            tables.append(np.where(kept, (best << 4) | np.clip(np.round(odds) + 8, 1, 15).astype(np.int64), 0))
        del at1, at2
        model = cls(bits, tables, even, np.zeros(3, dtype=np.int64), np.zeros(0, dtype=np.int64), np.array([1 << _PROB]))
        cells, held = [], []
        for lo in range(0, n, _CHUNK):
            guess, cell = model.guess(one[lo : lo + _CHUNK], two[lo : lo + _CHUNK], np.int64(0))
            cells.append(cell.astype(np.uint16))
            held.append(guess == ids[lo : lo + _CHUNK])
        held = np.concatenate(held)
        h1, h2 = _before(held.astype(np.uint8), starts)
        cell = np.concatenate(cells) | h1 | (h2 << 1)
        seen, good = np.bincount(cell, minlength=2048), np.bincount(cell[held], minlength=2048)
        every = np.arange(2048)
        for lo, size, at in ((0, 16, every >> 7), (16, 32, ((every >> 3) & 15) << 1 | ((every >> 2) & 1)), (48, 4, every & 3)):
            share = (np.bincount(at, good, size) + 0.4) / (np.bincount(at, seen, size) + 0.8)
            even[lo : lo + size] = np.clip(share * 4096, 1, 4095)
        weights = cls._weights(model._inputs(every) / 256.0, seen, good)
        missed, count = np.unique(ids[~held], return_counts=True)
        often = np.sort(np.argsort(-count, kind="stable")[:MOST][: int((count > 1).sum())])
        listed = np.append(count[often], count.sum() - count[often].sum())
        sizes = 1 + listed * ((1 << _PROB) - len(listed)) // max(1, int(listed.sum()))
        sizes[-1] += (1 << _PROB) - sizes.sum()
        return cls(bits, tables, even, weights, missed[often].astype(np.int64), sizes)

    @staticmethod
    def _weights(inputs: np.ndarray, seen: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Weights of the mix under which the guesses that held and those that did not are likeliest, by Newton's method."""
        w = np.full(3, 0.4)
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(inputs @ w, -8, 8)))
            slope = inputs.T @ (good - seen * p) - 0.5 * w
            bend = (inputs * (seen * p * (1 - p))[:, None]).T @ inputs + 0.5 * np.eye(3)
            w = np.clip(w + np.clip(np.linalg.solve(bend, slope), -1, 1), -8, 8)
        return np.round(w * 65536).astype(np.int64)

    def dumps(self) -> bytes:
        parts = [self.hits.astype("<u2").tobytes(), self.weights.astype("<i4").tobytes()]
        for table in self.guesses:
            parts += [(table & 15).astype("u1").tobytes(), _planes(table[table > 0] >> 4)]
        parts += [_planes(np.diff(self.ids, prepend=0)), _planes(self.sizes[:-1])]
        body = zlib.compress(b"".join(parts))
        return struct.pack("<IBBI", len(body), *self.bits, len(self.ids)) + body

    @classmethod
    def loads(cls, raw: bytes) -> tuple[Learned, int]:
        """What ``dumps`` wrote at the front of ``raw``, and how many bytes that is."""
        size, bits1, bits2, n = struct.unpack_from("<IBBI", raw)
        end = struct.calcsize("<IBBI") + size
        body, at = zlib.decompress(raw[end - size : end]), 0

        def take(kind, count):
            nonlocal at
            at += (got := np.frombuffer(body, kind, count, at)).nbytes
            return got

        whole = lambda count: np.ascontiguousarray(take("u1", 4 * count).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)
        hits, weights, guesses = take("<u2", 52).astype(np.int64), take("<i4", 3).astype(np.int64), []
        for bits in (bits1, bits2):
            table = take("u1", 1 << bits).astype(np.int64)
            used = np.flatnonzero(table)
            table[used] |= whole(len(used)) << 4
            guesses.append(table)
        ids, sizes = np.cumsum(whole(n)), whole(n)
        return cls((bits1, bits2), guesses, hits, weights, ids, np.append(sizes, (1 << _PROB) - sizes.sum())), end

    def plan(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What the arithmetic coder needs of each id: chance, whether the guess held, start, size - 1, whether it is not in the table."""
        one, two = _before(ids, starts)
        out = np.empty(len(ids), dtype=np.int64)
        held = np.empty(len(ids), dtype=bool)
        for lo in range(0, len(ids), _CHUNK):
            some = slice(lo, lo + _CHUNK)
            guess, out[some] = self.guess(one[some], two[some], np.int64(0))
            held[some] = guess == ids[some]
        h1, h2 = _before(held.astype(np.uint8), starts)
        for lo in range(0, len(ids), _CHUNK):
            some = slice(lo, lo + _CHUNK)
            out[some] = self.chance[out[some] | h1[some] | (h2[some] << 1)] | (held[some].astype(np.int64) << 16)
            miss = lo + np.flatnonzero(~held[some])
            own = ids[miss].astype(np.int64)
            at = self._listed(own)
            out[miss] |= (self.starts[at] << 17) | ((self.sizes[at] - 1) << 33) | ((at == len(self.ids)).astype(np.int64) << 49)
        return out


class _Encoder:
    """Ranges of up to 48 bits; 16 bits go out when a range is below 32. Carries are added at the end."""

    def __init__(self, lanes: int, width: int):
        self.low = np.zeros(lanes, dtype=np.int64)
        self.range = np.full(lanes, _WHOLE, dtype=np.int64)
        self.out = np.zeros(lanes * width, dtype=np.uint32)
        self.begin = np.arange(lanes) * width
        self.at = self.begin.copy()

    def emit(self, lanes: np.ndarray) -> None:
        low, at = self.low[lanes], self.at[lanes]
        self.out[at] = low >> 32
        self.at[lanes] = at + 1
        self.low[lanes] = (low & _LOW32) << 16
        self.range[lanes] <<= 16

    def flag(self, m: int, held: np.ndarray, chance: np.ndarray) -> None:
        low, wide = self.low[:m], self.range[:m]
        step = wide >> _PROB
        part = step * chance
        low += part * ~held
        wide[:] = np.where(held, part, (step << _PROB) - part)
        self.emit(np.flatnonzero(wide < _LEAST))

    def put(self, lanes: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> None:
        step = self.range[lanes] >> _PROB
        self.low[lanes] += step * start
        self.range[lanes] = wide = step * size
        self.emit(lanes[wide < _LEAST])

    def finish(self) -> list[bytes]:
        for shift in (32, 16, 0):
            self.out[self.at] = (self.low >> shift) & (0x1FFFF if shift == 32 else 0xFFFF)
            self.at += 1
        grid = self.out.reshape(len(self.low), -1)
        words = np.ascontiguousarray(grid[:, : int((self.at - self.begin).max())].T)
        for k in range(len(words) - 1, 0, -1):
            words[k - 1] += words[k] >> 16
        lanes = np.ascontiguousarray(words.T.astype("<u2"))
        return [lanes[k, :n].tobytes() for k, n in enumerate((self.at - self.begin).tolist())]


class _Decoder:
    def __init__(self, payloads: list[bytes]):
        longest = max((len(p) for p in payloads), default=0) // 2 + 8
        self.words = np.zeros((len(payloads), longest), dtype="<u2")
        for k, p in enumerate(payloads):
            self.words[k, : len(p) // 2] = np.frombuffer(p, "<u2", len(p) // 2)
        self.code = np.zeros(len(payloads), dtype=np.int64)
        for k in range(3):
            self.code = (self.code << 16) | self.words[:, k]
        self.range = np.full(len(payloads), _WHOLE, dtype=np.int64)
        self.at = np.arange(len(payloads)) * longest + 3
        self.words = self.words.reshape(-1)

    def refill(self, lanes: np.ndarray) -> None:
        at = self.at[lanes]
        self.code[lanes] = (self.code[lanes] << 16) | self.words.take(at, mode="clip")  # beyond the end only if damaged
        self.at[lanes] = at + 1
        self.range[lanes] <<= 16

    def flag(self, m: int, chance: np.ndarray) -> np.ndarray:
        code, wide = self.code[:m], self.range[:m]
        step = wide >> _PROB
        part = step * chance
        held = code < part
        code -= part * ~held
        wide[:] = np.where(held, part, (step << _PROB) - part)
        self.refill(np.flatnonzero(wide < _LEAST))
        return held

    def value(self, lanes: np.ndarray) -> np.ndarray:
        self.step = self.range[lanes] >> _PROB
        return np.clip(self.code[lanes] // self.step, 0, (1 << _PROB) - 1)

    def take(self, lanes: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> None:
        self.code[lanes] -= self.step * start
        self.range[lanes] = wide = self.step * size
        self.refill(lanes[wide < _LEAST])


def _active(lengths: np.ndarray) -> np.ndarray:
    """For each step how many lanes are still on; lanes stand longest first."""
    return np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")


def encode_blocks(blocks: list[np.ndarray], digits: int, learned: Learned | None = None) -> list[bytes]:
    """One payload a block; blocks longest first. Without ``learned`` each block learns from itself and says so in its payload."""
    if learned is None:
        own = [Learned.of(b.astype(np.uint32), np.zeros(min(1, len(b)), dtype=np.int64)) for b in blocks]
        return [x.dumps() + encode_blocks([b], digits, x)[0] if len(b) else b"" for b, x in zip(blocks, own, strict=True)]
    lengths = np.array([len(b) for b in blocks], dtype=np.int64)
    if not len(blocks) or lengths[0] == 0:
        return [b""] * len(blocks)
    ids = np.concatenate(blocks).astype(np.uint32)
    begin = np.cumsum(lengths) - lengths
    plan = learned.plan(ids, begin[lengths > 0])
    # Words that a block can need: 12 bits for a flag, 16 for a missed id, and the digits of one not in the table.
    more = 1 - ((plan >> 16) & 1) + ((plan >> 49) & 1) * (2 if digits > 4 else 1)
    most = np.diff(np.append(0, np.cumsum(more))[np.append(begin, len(ids))])
    del more
    grid = np.zeros((len(blocks), int(lengths[0])), dtype=np.int64)
    for k, (lo, n) in enumerate(zip(begin.tolist(), lengths.tolist(), strict=True)):
        grid[k, :n] = plan[lo : lo + n]
    del plan
    grid = np.ascontiguousarray(grid.T)
    coder = _Encoder(len(blocks), int((lengths * 3 // 4 + most).max()) + 16)
    for i, m in enumerate(_active(lengths).tolist()):
        row = grid[i, :m]
        held = (row & 0x10000) != 0
        coder.flag(m, held, row & 0xFFFF)
        lanes = np.flatnonzero(~held)
        row = row[lanes]
        coder.put(lanes, (row >> 17) & 0xFFFF, ((row >> 33) & 0xFFFF) + 1)
        others = lanes[(row >> 49) != 0]
        if len(others):
            own = ids[begin[others] + i].astype(np.int64)
            for shift in (16, 0) if digits > 4 else (0,):
                coder.put(others, (own >> shift) & 0xFFFF, 1)
    return coder.finish()


def decode_blocks(payloads: list[bytes], lengths: list[int], digits: int, learned: Learned | None = None) -> list[np.ndarray]:
    """The ids of the blocks, given longest first."""
    sizes = np.array(lengths, dtype=np.int64)
    if not len(sizes) or sizes[0] == 0:
        return [np.zeros(0, dtype="<u4") for _ in lengths]
    if learned is None:
        read = [Learned.loads(p) if n else (None, 0) for p, n in zip(payloads, lengths, strict=True)]
        return [decode_blocks([p[at:]], [n], digits, x)[0] for (x, at), p, n in zip(read, payloads, lengths, strict=True)]
    grid = np.zeros((int(sizes[0]), len(sizes)), dtype=np.uint32)
    coder = _Decoder(payloads)
    one, two, past = np.zeros(len(sizes), dtype=np.uint32), np.zeros(len(sizes), dtype=np.uint32), np.zeros(len(sizes), dtype=np.int64)
    table = np.append(learned.ids, 0)
    for i, m in enumerate(_active(sizes).tolist()):
        guess, cell = learned.guess(one[:m], two[:m], past[:m])
        held = coder.flag(m, learned.chance[cell])
        lanes = np.flatnonzero(~held)
        at = learned.which[coder.value(lanes)]
        coder.take(lanes, learned.starts[at], learned.sizes[at])
        own = table[at]
        others = np.flatnonzero(at == len(learned.ids))
        if len(others):
            left, value = lanes[others], np.zeros(len(others), dtype=np.int64)
            for _ in range(2 if digits > 4 else 1):
                part = coder.value(left)
                coder.take(left, part, 1)
                value = (value << 16) | part
            own[others] = value
        guess[lanes] = own
        two, one = one, guess.astype(np.uint32)
        grid[i, :m] = one
        past = ((past[:m] << 1) | held) & 3
    grid = np.ascontiguousarray(grid.T)
    return [grid[k, :n].astype("<u4") for k, n in enumerate(lengths)]


def pack_file(part: int, ids: list[int | None], counts: list[int], tokens: np.ndarray, block: int | None = None) -> bytes:
    """A file: header, documents (id or none, number of tokens), block table, what was learnt, payloads.

    Blocks have ``BLOCK`` ids, or fewer in a small file, so that enough of them are coded in step.

    Header: magic, the file's place, digits of an id, documents, blocks; all little-endian. A
    block's entry: its number of ids, bytes of payload, and crc32 of the ids as unsigned 32-bit numbers.
    """
    block = block or min(BLOCK, max(SHORT_BLOCK, len(tokens) // LANES))
    digits = max(1, -(-int(tokens.max(initial=1)).bit_length() // 4))
    parts = [tokens[i : i + block] for i in range(0, len(tokens), block)]
    learned = Learned.of(tokens.astype(np.uint32), np.arange(0, len(tokens), block))
    payloads = encode_blocks(parts, digits, learned)  # only the last can be shorter
    model = learned.dumps()
    head = struct.pack("<8sQIQQ", MAGIC, part, digits, len(ids), len(parts))
    docs = np.array([0 if i is None else i for i in ids], dtype="<i8").tobytes() + np.array([i is None for i in ids], dtype="u1").tobytes() + np.array(counts, dtype="<u8").tobytes()
    entries = b"".join(struct.pack("<III", len(p), len(x), zlib.crc32(p.astype("<u4").tobytes())) for p, x in zip(parts, payloads, strict=True))
    return b"".join([head, docs, entries, struct.pack("<II", len(model), zlib.crc32(model)), model, *payloads])


def unpack_file(raw: bytes) -> tuple[int, list[int | None], list[int], np.ndarray]:
    """(place, ids, counts, tokens) of a file; a wrong checksum raises."""
    magic, part, digits, n, n_blocks = struct.unpack_from("<8sQIQQ", raw)
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    at = struct.calcsize("<8sQIQQ")
    ids = np.frombuffer(raw, "<i8", n, at).tolist()
    null = np.frombuffer(raw, "u1", n, at + 8 * n).tolist()
    counts = np.frombuffer(raw, "<u8", n, at + 9 * n).tolist()
    at += 17 * n
    entries = [struct.unpack_from("<III", raw, at + 12 * k) for k in range(n_blocks)]
    at += 12 * n_blocks
    size, check = struct.unpack_from("<II", raw, at)
    model = raw[at + 8 : at + 8 + size]
    if zlib.crc32(model) != check:
        raise ValueError("what was learnt is damaged")
    learned, at = Learned.loads(model)[0], at + 8 + size
    payloads = []
    for _, size, _ in entries:
        payloads.append(raw[at : at + size])
        at += size
    blocks = decode_blocks(payloads, [e[0] for e in entries], digits, learned)
    for k, (e, b) in enumerate(zip(entries, blocks, strict=True)):
        if zlib.crc32(b.tobytes()) != e[2]:
            raise ValueError(f"block {k} is damaged")
    tokens = np.concatenate([*blocks, np.zeros(0, dtype="<u4")]).astype("<u4")
    return part, [None if z else i for i, z in zip(ids, null, strict=True)], counts, tokens
