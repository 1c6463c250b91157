"""Token ids of whole texts, with each distinct piece encoded once a worker.

Both tokenizers cut a text at white space before they merge anything, so a text that is cut
where a single space or line feed stands between two other characters has the ids of its pieces
one after the other. Pieces repeat, their ids are kept. Where white space stands in any other
way, or a text holds the string of one of the tokenizer's added tokens, it is encoded whole.
A piece that ends in punctuation after a letter has the ids of the two parts: both tokenizers cut
there, too, and a word is then encoded once for all the marks that follow it.

Texts are cut many at a time, on their bytes, and Arrow tells the pieces apart, so that Python
sees each distinct piece of a group of texts and not each occurrence.
"""

from __future__ import annotations

import os
from string import punctuation

import numpy as np
import pyarrow as pa

# Pieces kept by a worker, in two generations: when the younger one has half of them the older one
# goes, and pieces in use have moved on by then. It bounds memory, not results.
KEPT = 800_000
JOINED = 50
_OTHER_SPACE = [c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n"]
_ASCII_SPACE = sum(c < "\x80" for c in _OTHER_SPACE)
_TWO_SPACES = ["  ", " \n", "\n ", "\n\n"]
_GROUP = 4_000_000  # characters cut at a time; a longer text is a group of its own
_TAIL = 8  # marks in a row up to which pieces are cut on bytes; longer ones when they are learnt
_BYTES = np.arange(256)
_CUT = (_BYTES == 32) | (_BYTES == 10)
_MARK = np.isin(_BYTES, np.frombuffer(punctuation.encode(), dtype=np.uint8))
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122) & (_BYTES < 128)


def _plainly_spaced(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between two other characters."""
    if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _TWO_SPACES):
        return False
    return not any(c in text for c in (_OTHER_SPACE[:_ASCII_SPACE] if text.isascii() else _OTHER_SPACE))


class WordIds:
    """Ids, as little-endian unsigned 32-bit bytes, by one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.store: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.feed = self._whole("\n")
        # Bytes that an id stands for; a tokenizer that drops white space has none for it.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, k in vocabulary.items():
            self.width[k] = len(token.removesuffix("</w>"))
        self.spaced = bool(self._whole(" "))
        self.lowers = self._whole("A") == self._whole("a")

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _ends(self, joined: str) -> np.ndarray:
        """How many bytes the ids of each word of a text and those before stand for; a space is before each word."""
        if self.lowers and not joined.isascii():
            joined = joined.replace("\u03a3", "\u03c3").lower()  # the one letter that Python lowers by what is around it
        raw = np.frombuffer(joined.encode(), dtype=np.uint8)
        spaces = np.flatnonzero(raw == 32)
        ends = np.append(spaces[1:], len(raw))
        return ends if self.spaced else ends - np.arange(1, len(ends) + 1)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces. Those that follow a space are encoded many at a time and parted by
        the bytes that the ids stand for; where these do not fit, one at a time."""
        lone = [p for p in pieces if p[0] in "\0\n"]
        encoded = self.tokenizer.encode_batch_fast([p[1:] for p in lone], add_special_tokens=False)
        for p, e in zip(lone, encoded, strict=True):
            self.store[p] = (self.feed if p[0] == "\n" else b"") + np.array(e.ids, dtype="<u4").tobytes()
        after = [p for p in pieces if p[0] not in "\0\n"]
        groups = [after[i : i + JOINED] for i in range(0, len(after), JOINED)]
        joined = [" " + " ".join(g) for g in groups]
        encoded = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        for group, text, e in zip(groups, joined, encoded, strict=True):
            ids = np.array(e.ids, dtype="<u4")
            reach = np.cumsum(self.width[ids])
            ends = self._ends(text)
            at = np.searchsorted(reach, ends)
            if len(ids) and reach[-1] == ends[-1] and (reach[at] == ends).all():
                raw, cuts = ids.tobytes(), ((at + 1) * 4).tolist()
                for p, lo, hi in zip(group, [0, *cuts], cuts, strict=False):
                    self.store[p] = raw[lo:hi]
            else:
                for p in group:
                    self.store[p] = self._whole(" " + p)

    def _add(self, pieces: set[str]) -> None:
        """Put pieces into the store that are not there."""
        store, older = self.store, self.older
        wanted, heads, parted = set(), set(), []
        for p in pieces:
            if p in older:
                store[p] = older[p]
                continue
            head = p.rstrip(punctuation)
            # The cut is sure to be the tokenizer's after a letter that every version of Unicode knows
            # and whose lower case has no mark of its own.
            if len(head) < len(p) and head and head[-1] < "\u0250" and head[-1].lower().isalpha():
                parted.append((p, head))
                heads.add(head)
            else:
                wanted.add(p)
        heads.update({"\0" + p[len(head) :] for p, head in parted})
        for p in heads:
            if p in older:
                store[p] = older[p]
            elif p not in store:
                wanted.add(p)
        self._learn(list(wanted))
        for p, head in parted:
            store[p] = store[head] + store["\0" + p[len(head) :]]

    def _parts(self, text: str) -> bool:
        """Whether a text's pieces can be encoded apart."""
        return bool(text) and "\0" not in text and _plainly_spaced(text) and not any(t in text for t in self.added)

    def _ids(self, raw: bytes, starts: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(ids of texts that stand one after the other, the bytes before each text's and after the last's)."""
        own = np.frombuffer(raw, dtype=np.uint8)
        cut = _CUT[own]
        cut[starts] = True
        lo = np.flatnonzero(cut)
        # Marks at the end of a piece are a piece of their own if an ASCII letter stands before them.
        tail = hi = np.append(lo[1:], len(own))
        on = np.arange(len(lo))
        for _ in range(_TAIL):
            on = on[(tail[on] > lo[on]) & _MARK[own[tail[on] - 1]]]
            tail = tail.copy() if tail is hi else tail
            tail[on] -= 1
        cut[tail[(tail < hi) & (tail > lo) & _LETTER[own[tail - 1]]]] = True
        at = np.flatnonzero(cut)
        ends = np.append(at, len(own)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        names = [p[1:] if p[0] == " " else p if p[0] == "\n" else "\0" + p for p in pieces.dictionary.to_numpy(zero_copy_only=False).tolist()]
        found = list(map(self.store.get, names))
        gaps = [i for i, x in enumerate(found) if x is None]
        self._add({names[i] for i in gaps})
        for i in gaps:
            found[i] = self.store[names[i]]
        kept = pa.array(found, pa.large_binary()).take(pieces.indices)
        reach = np.frombuffer(kept.buffers()[1], dtype=np.int64, count=len(at) + 1)
        return kept.buffers()[2].to_pybytes(), reach[np.append(np.searchsorted(at, starts), len(at))]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        group, size = [], 0

        def finish():
            if len(self.store) > KEPT // 2:
                self.store, self.older = {}, self.store
            raw = [texts[k].encode() for k in group]
            length = np.cumsum([len(x) for x in raw])
            ids, ends = self._ids(b"".join(raw), np.append(0, length[:-1]))
            for k, lo, hi in zip(group, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out[k] = ids[lo:hi]

        for k, text in enumerate(texts):
            if self._parts(text):
                if group and size + len(text) > _GROUP:
                    finish()
                    group, size = [], 0
                group.append(k)
                size += len(text)
            elif text:
                out[k] = self._whole(text)
        if group:
            finish()
        return out


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own tokenizer for a file."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def forget() -> None:
    """Drop the tokenizers that this worker has loaded, with all pieces kept."""
    _LOADED.clear()
