"""Hierarchical Pitman-Yor language model, seated by Gibbs sampling, over all documents.

A word is predicted in the restaurant of the two words before it; after a text's first word in
that of this word, and before it in that of the start. Every word and every pair seen is a
context, so restaurants grow with the input; a ``share`` keeps those that make up so much of the
training tokens. Restaurants of (a, b) share the parent b, those of single words share the
restaurant without context, and below that every word and one unknown word are alike. A
customer that opens a table sits down in the parent, too.

Seating is kept as customers and tables of each dish in each restaurant. Taking a customer away
closes a table with the probability that the customer sat there alone; seating it anew may open
one. Both depend on customers and tables alone, table sizes being summed out, and their balance
gives the law of a dish's tables; a Gibbs step draws from it, which reseats all of its customers.
Words are dealt to shards with the word before them, so a shard holds a dish below (b, w) whole
and no word is the load of one shard. What shards share is added up by hash in homes: customers
and tables of each context, and the customers of each word in the restaurant without context,
which its home seats. A round samples given the sums of the round before and adds up new ones.
The last round's samples score: a text's probability averages over them, token by token.

Texts are read again for each of a few turns, in which only some of the shards get their words, so
that little lies in shuffles at a time. Numbers are written as byte planes, compressed (``pack``).

1. Blocks of texts send each shard their words once per context, with the training count. Where
   these occur stays with the block. A shard names its words and words before by hash.
2. Shards write to the homes of their contexts and words; a home answers with sums and the places
   of the keys that it goes on hearing of, by which shards name them from then on. Sums of other
   contexts never change: a context of two words in which no word comes twice has a table a dish.
3. Rounds read the shards' dishes; homes add up and answer every shard for its own contexts.
4. Shards send back a chance for each word and context of a block, which adds them up by document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import discard, map_batches, partitions, release, ship, table
from daybook.llm.words import chunks, hash_words
from daybook.session import materialize, scratch_path

SHARDS_A_PARTITION = 4
# Texts are read so often, for a part of the shards each time; fewer times if there are few input partitions.
TURNS = 4
# The first letters, which name keys in full, go to a part of the homes at a time.
HALVES = 2
# The shards of a turn meet the first answers in so many parts.
PIECES = 3
BLOCK_BYTES = 32_000_000
BLOCK_TEXTS = 60_000
ROUNDS = 2
BURN_IN = 3
SAMPLES = 3
WINDOW = 64
# Up to so many customers of a dish the law of its tables is exact, from a table of ratios.
LISTED = 256
STRENGTH = (1.0, 1.0, 1.0)
SEED = 20240229
END = np.uint64(0x454E44)  # no word has this hash but by a chance of 2**-64
ROOT, START = 0, 1


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers, several arrays in one: above their least value, or steps if they rise, as byte planes, compressed."""
    head, body = [struct.pack("<B", len(arrays))], []
    for x in arrays:
        x = np.ascontiguousarray(x)
        x = (x if x.dtype == np.uint64 else x.astype(np.int64)).view(np.uint64)
        rises = len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        if rises:
            least, x = x[0], np.diff(x, prepend=x[:1])
        elif len(x):
            least = x.view(np.int64).min().view(np.uint64)
            x = x - least
        else:
            least = np.uint64(0)
        width = (int(x.max(initial=0)).bit_length() + 7) // 8
        head.append(struct.pack("<IBQ", len(x), width + 16 * rises, int(least)))
        body.append(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
    raw = b"".join(head + body)
    return struct.pack("<I", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob, *which: int) -> list[np.ndarray]:
    """The arrays of ``pack``, or some of them, as unsigned 64-bit numbers; signed ones are their ``view``."""
    blob = memoryview(blob)
    raw = pa.decompress(blob[4:], struct.unpack("<I", blob[:4])[0], codec="zstd", asbytes=True)
    n, out = raw[0], []
    at = 1 + 13 * n
    for k in range(n):
        size, kind, least = struct.unpack_from("<IBQ", raw, 1 + 13 * k)
        width = kind % 16
        if which and k not in which:
            at += size * width
            continue
        planes = np.zeros((size, 8), dtype=np.uint8)
        planes[:, :width] = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size).T
        at += size * width
        x = planes.view("<u8").reshape(-1)
        out.append((np.cumsum(x, dtype=np.uint64) if kind >= 16 else x) + np.uint64(least))
    return out


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i in ids], dtype=bool)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, document of each token, whether it is a document's first): words, then one end, by document."""
    words, bounds = hash_words(texts, lower=True)
    count = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), count + 1)
    last = np.cumsum(count + 1) - 1
    out = np.full(len(doc), END, dtype=np.uint64)
    is_word = np.ones(len(doc), dtype=bool)
    is_word[last] = False
    out[is_word] = words
    first = np.zeros(len(doc), dtype=bool)
    first[last - count] = True
    return out, doc, first


@dataclass
class Contexts:
    """Frequent words, and frequent pairs of them as 65536 * first + second. Numbers: 0 none, 1 a text's start, words, pairs."""

    words: np.ndarray
    pairs: np.ndarray

    @property
    def parents(self) -> np.ndarray:
        """Of each context: pairs are below their second word, single words below the root."""
        return np.concatenate([np.zeros(2 + len(self.words), dtype=np.int64), self.pairs & 0xFFFF]).astype(np.int64)

    def singles(self, tokens: np.ndarray) -> np.ndarray:
        """The number of each token as a context of its own; 0 if it is none."""
        if not len(self.words):
            return np.zeros(len(tokens), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
        return np.where(self.words[at] == tokens, at + 2, 0)

    def before(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(context of each token, its pair key or -1)."""
        own = self.singles(tokens)
        one = np.concatenate([[START], own[:-1]]) if len(own) else own
        one = np.where(first, START, one)
        two = np.concatenate([[ROOT], one[:-1]]) if len(one) else one
        key = np.where((one > START) & (two > START), two * 65536 + one, -1)
        if not len(self.pairs):
            return one, key
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at + 2 + len(self.words), one), key


def _mix(two: np.ndarray, one: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint of two, which depends on their order."""
    x = (two * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) ^ (one + np.uint64(0x632BE59BD9B4E019))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _words_before(tokens: np.ndarray, first: np.ndarray, contexts: Contexts | None) -> tuple[np.ndarray, np.ndarray]:
    """(word before each token, word before that): of the longest context, 0 for none and 1 for a text's start."""
    if contexts is None:
        one = np.where(first, START, np.append(np.uint64(START), tokens[:-1])).astype(np.uint64)
        two = np.append(np.uint64(0), one[:-1])
        return one, np.where(first | (two == START), 0, two).astype(np.uint64)
    last = np.concatenate([np.array([ROOT, START], dtype=np.uint64), contexts.words, contexts.words[(contexts.pairs & 0xFFFF) - 2]])
    before = np.concatenate([np.zeros(2 + len(contexts.words), dtype=np.uint64), contexts.words[(contexts.pairs >> 16) - 2]])
    at = contexts.before(tokens, first)[0]
    return last[at], before[at]


def _blocks(batches: Iterator[pa.RecordBatch], id_at: int = 0, text_at: int = 1) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of about ``BLOCK_BYTES``, across batches."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(id_at).to_pylist(), b.column(text_at).cast(pa.binary()).to_pylist(), strict=True):
            raw = t or b""
            ids.append(i)
            texts.append(raw)
            size += len(raw) + 1
            if size >= BLOCK_BYTES or len(ids) >= BLOCK_TEXTS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _training(ids: list, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    kept = [t for t, out in zip(texts, held_out(ids).tolist(), strict=True) if not out]
    for lo, hi in chunks(kept):
        yield _tokens(kept[lo:hi])


def find_contexts(docs: DataFrame, share: float) -> Contexts:
    """Words that make up ``share`` of the training tokens, counted in blocks where they are at
    least half as frequent, then pairs of such words likewise. At most 1 / share of either, and
    a block sends at most 2 / share: these lists come to the driver whatever the input's size."""

    def counted(keys, number):
        def run(batches):
            for ids, texts in _blocks(batches):
                parts = [keys(*x) for x in _training(ids, texts)]
                n = sum(p[0] for p in parts)
                key, count = np.unique(np.concatenate([p[1] for p in parts] or [np.zeros(0, number)]), return_counts=True)
                often = count >= share / 2 * n
                key, count = key[often].view(np.int64), count[often]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(key, 0)), pa.array(np.append(count, 0)), pa.array(np.append(np.zeros(len(key), np.int64), n))], ["key", "n", "total"])

        found = map_batches(docs, run, "key bigint, n bigint, total bigint")
        total = found.agg(F.sum("total")).first()[0] or 0
        often = found.filter("n > 0").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= share * total)
        return np.array([r[0] for r in often.select("key").collect()], dtype=np.int64)

    words = np.sort(counted(lambda tokens, doc, first: (len(tokens), tokens[tokens != END]), np.uint64).view(np.uint64))
    alone = Contexts(words[:60_000], np.zeros(0, dtype=np.int64))

    def pair_keys(tokens, doc, first):
        key = alone.before(tokens, first)[1]
        return len(tokens), key[key >= 0]

    pairs = np.sort(counted(pair_keys, np.int64))
    return Contexts(alone.words, pairs[: 65_000 - len(alone.words)])


def _send(ids: list, texts: list[bytes], contexts: Contexts | None, shards: int, block: int, turn: int = 0, turns: int = 1) -> Iterator[dict]:
    """The block's words and contexts by shard of this turn, then where they occur, in the same order."""
    parts = []
    n_tokens = np.zeros(len(ids), dtype=np.int64)
    for lo, hi in chunks(texts):
        tokens, doc, first = _tokens(texts[lo:hi])
        n_tokens[lo:hi] = np.bincount(doc, minlength=hi - lo)
        one, two = _words_before(tokens, first, contexts)
        shard = (_mix(one, tokens) % np.uint64(shards)).astype(np.int64)
        part = (tokens, one, two, doc + lo, shard)
        if turns > 1:
            mine = np.flatnonzero(shard % turns == turn)
            part = tuple(x[mine] for x in part)
        parts.append(part)
    tokens, one, two, doc, shard = (np.concatenate(x) for x in zip(*parts, strict=True))
    out = held_out(ids)
    own = _context(one, two)
    order = np.lexsort((own, tokens, shard))
    tokens, own, doc = tokens[order], own[order], doc[order]
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    learn = np.add.reduceat((~out)[doc].astype(np.int64), at) if len(at) else at
    occurs = np.diff(np.append(at, len(tokens)))
    kept = order[at]
    tokens, one, two, shard = tokens[at], one[kept], two[kept], shard[kept]
    for s in np.unique(shard).tolist():
        a, b = np.searchsorted(shard, [s, s + 1])
        # Words before are sent once a block and named by their place there.
        before, places = np.unique(np.concatenate([one[a:b], two[a:b]]), return_inverse=True)
        yield {"shard": s, "block": block, "words": tokens[a:b], "before": before, "one": places[: b - a], "two": places[b - a :], "learn": learn[a:b]}
    yield {"shard": -1 - block, "block": block, "ids": ids, "n_tokens": n_tokens.tolist(), "held_out": out.tolist(), "occurs": occurs, "docs": doc}


def _context(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The key of the context of these words."""
    return np.where(two == 0, one, _mix(two, one))


_CELL = ("words", "before", "one", "two", "learn")
DISHES, PLACES, BLOCKS = 0, 1, 2
SEATS = -2  # in place of a block or home: the tables of the last round, by sample


def _merge(group: pa.Table) -> Iterator[dict]:
    """One shard: its dishes over all blocks by word and context, then a row a block with the dishes of its words."""
    cells = [unpack(x.as_buffer()) for x in group.column("cell")]
    sizes = [len(x[0]) for x in cells]
    words = np.concatenate([x[0] for x in cells])
    one, two = (np.concatenate([x[1][x[k]] for x in cells]) for k in (2, 3))
    learn = np.concatenate([x[4] for x in cells]).astype(np.int64)
    del cells
    own = _context(one, two)
    order = np.lexsort((own, words))
    a, b = words[order], own[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    first = order[new]
    names, runs = np.unique(a[new], return_counts=True)
    before, at = np.unique(np.concatenate([one[first], two[first]]), return_inverse=True)
    count = np.bincount(place, learn, len(first)).astype(np.int64)
    yield {"part": DISHES, "block": -1, "cell": pack(names, runs, before, at[: len(first)], at[len(first) :], count)}
    for block, mine in zip(group.column("block").to_pylist(), np.split(place, np.cumsum(sizes)[:-1]), strict=True):
        yield {"part": PLACES, "block": block, "cell": pack(mine)}


def _alone(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """How likely a table holds one customer, by the logarithm of customers per table.

    Table sizes given customers and tables follow the sizes of a stable law tilted to that mean.
    """
    z = 1 - np.logspace(-14, 0, 4000)[::-1]
    z = z[z > 0]
    total = 1 - (1 - z) ** discount
    mean = z * discount * (1 - z) ** (discount - 1) / total
    return np.concatenate([[0.0], np.log(mean)]), np.concatenate([[1.0], discount * z / total])


@cache
def _more_tables(discount: float) -> np.ndarray:
    """Logarithm of S(c, t + 1) / S(c, t) at [c, t], S(c, t) being the weight of all ways to seat c customers at t tables.

    Seats are taken one by one: a table with k customers weighs k - discount to the next one, a
    new one 1 (generalised Stirling numbers).
    """
    t = np.arange(LISTED + 2)
    ways = np.full(LISTED + 2, -np.inf)
    ways[1] = 0.0
    out = np.zeros((LISTED + 1, LISTED + 2))
    for c in range(2, LISTED + 1):
        with np.errstate(divide="ignore"):
            stay = ways + np.log(np.maximum(c - 1 - discount * t, 0.0))
        ways = np.logaddexp(stay, np.append(-np.inf, ways[:-1]))
        out[c, 1:c] = np.diff(ways[1 : c + 1])
        out[c, c:] = out[c, c - 1]
    return out


def _counted(at: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Whole numbers added up by place."""
    return np.bincount(at, weights, size).astype(np.int64)


class Seating:
    """The chains of one shard, given the totals of the restaurants (customers and tables)."""

    def __init__(self, word, context, count, parents: np.ndarray, discounts, strength=STRENGTH):
        word, context = word.astype(np.int64), context.astype(np.int64)
        level = np.where(context == ROOT, 0, np.where(parents[context] == ROOT, 1, 2))
        key = word * len(parents) + context
        above = np.searchsorted(key, word * len(parents) + parents[context])
        self._begin(context, count.astype(np.int64), [np.flatnonzero(level == d) for d in range(3)], above, discounts, strength)

    @classmethod
    def of_levels(cls, contexts: list[np.ndarray], counts: list[np.ndarray], above: list[np.ndarray], discounts, strength=STRENGTH) -> Seating:
        """Dishes without context, of single words and of pairs, one after the other; ``above`` names a place in the list before."""
        ends = np.cumsum([len(x) for x in contexts])
        at = [np.arange(e - len(x), e) for e, x in zip(ends, contexts, strict=True)]
        seat = cls.__new__(cls)
        seat._begin(np.concatenate(contexts), np.concatenate(counts), at, np.concatenate([at[0], above[0], above[1] + len(at[0])]), discounts, strength)
        return seat

    def _begin(self, context, count, at, above, discounts, strength) -> None:
        self.context, self.count, self.at, self.above = context, count, at, above
        self.discount, self.strength = discounts, strength
        self.alone = [_alone(d) for d in discounts]
        self.customers, self.tables = self.count.copy(), np.zeros_like(self.count)
        self.root = None  # the chance of each word without context, if it is seated elsewhere

    def parent_chance(self, d: int, chance: np.ndarray, base: float) -> np.ndarray:
        return np.full(len(self.at[d]), base) if d == 0 else chance[self.above[self.at[d]]]

    def chances(self, totals: np.ndarray, base: float) -> np.ndarray:
        """Predictive probability of each dish in its restaurant; totals are (customers, tables) by context."""
        out = np.zeros(len(self.context))
        for d in range(3):
            rows = self.at[d]
            if d == 0 and self.root is not None:
                out[rows] = self.root
                continue
            house, tables = totals[self.context[rows]].T
            dd, s = self.discount[d], self.strength[d]
            own = np.maximum(self.customers[rows] - dd * self.tables[rows], 0.0)
            out[rows] = (own + (s + dd * tables) * self.parent_chance(d, out, base)) / (s + house)
        return out

    def _ratio(self, d: int, c: np.ndarray, t: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Logarithm of how much likelier t + 1 tables are than t, for rows of c customers and opening weight a.

        Exact for up to ``LISTED`` customers (between whole numbers of tables on a line), of the
        tilted stable law beyond.
        """
        few = (c <= LISTED).reshape(-1)
        if few.all():
            return np.log(a) + self._listed_ratio(d, c, t)
        if not few.any():
            return np.log(a) + self._wide_ratio(d, c, t)
        out = np.empty(np.broadcast_shapes(c.shape, t.shape))
        out[few] = self._listed_ratio(d, c[few], t[few])
        out[~few] = self._wide_ratio(d, c[~few], t[~few])
        return np.log(a) + out

    def _listed_ratio(self, d: int, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        ratios = _more_tables(float(self.discount[d]))
        c, at = c.astype(np.int64), np.floor(t).astype(np.int64)
        low = ratios[c, at]
        return low + (t - at) * (ratios[c, at + 1] - low)

    def _wide_ratio(self, d: int, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        lonely = lambda t: (t - 1) / (c - 1) * np.interp(np.log(c / t), *self.alone[d])
        return np.log1p(-lonely(t)) - np.log(lonely(t + 1)) - np.log(c - 1 - self.discount[d] * t)

    def _balance(self, d: int, c: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Between 1 and c - 1, the place at which a table more is as likely as not, by bisection."""
        lo, hi = np.ones(len(c)), c - 1.0
        for _ in range(int(np.log2(c.max(initial=2))) + 8):
            mid = (lo + hi) / 2
            more = self._ratio(d, c, mid, a) > 0
            lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
        return (lo + hi) / 2

    def _full(self, d: int, customers: np.ndarray, opening: np.ndarray) -> np.ndarray:
        """About the number of tables at which openings and closings balance."""
        tables = np.minimum(customers, 1).astype(np.int64)
        many = np.flatnonzero(customers > 1)
        tables[many] = np.round(self._balance(d, customers[many].astype(float), opening[many]) + 0.5)
        return np.minimum(tables, customers)

    def _step(self, d: int, customers: np.ndarray, tables: np.ndarray, opening: np.ndarray, rng) -> np.ndarray:
        """All customers of each dish leave and sit down again: tables drawn from their law given the customers.

        The law is listed for every number of tables, or about its peak where it is wide; beyond
        a deviation of ``WINDOW`` / 8 tables it is a normal law to within rounding.
        """
        tables = np.minimum(customers, 1).astype(np.int64)
        for width, low, high in ((4, 1, 4), (16, 4, 16), (WINDOW, 16, np.inf)):
            rows = np.flatnonzero((customers > low) & (customers <= high))
            for at in np.array_split(rows, max(1, len(rows) * width // 1_000_000)):
                c, a = customers[at].astype(float), opening[at]
                if high < np.inf:
                    first, wide = np.ones(len(at)), np.zeros(len(at), dtype=bool)
                else:
                    peak = self._balance(d, c, a)
                    at_peak = np.clip(peak, 1, c - 2)
                    slope = self._ratio(d, c, at_peak + 1, a) - self._ratio(d, c, at_peak, a)
                    spread = 1 / np.sqrt(np.maximum(-slope, 1e-18))
                    wide = (spread > width / 8) & (c > width)
                    tables[at[wide]] = np.clip(np.round(peak + 0.5 + spread * rng.standard_normal(len(at)))[wide], 1, c[wide])
                    first = np.maximum(1, np.minimum(np.floor(peak) - width // 2 + 1, c - width + 1))
                    at, c, a, first = at[~wide], c[~wide], a[~wide], first[~wide]
                if not len(at):
                    continue
                t = first[:, None] + np.arange(width - 1)
                inside = t < c[:, None]
                step = self._ratio(d, c[:, None], np.minimum(t, c[:, None] - 1), a[:, None])
                law = np.concatenate([np.zeros((len(at), 1)), np.cumsum(np.where(inside, step, 0.0), axis=1)], axis=1)
                law = np.exp(law - law.max(axis=1, keepdims=True))
                law[:, 1:][~inside] = 0
                law = np.cumsum(law, axis=1)
                tables[at] = first.astype(np.int64) + (law < rng.random((len(at), 1)) * law[:, -1:]).sum(1)
        return tables

    def find_moving(self) -> None:
        """Dishes that can ever have two customers, with those above them; all others have as many tables as customers, one or none."""
        most = self.count.copy()
        for d in (2, 1):
            most += _counted(self.above[self.at[d]], most[self.at[d]], len(most))
        self.moving, self.up, self.fixed = [], [None], []
        place = np.zeros(len(most), dtype=np.int64)
        for d in range(3):
            moves = most[self.at[d]] >= 2
            if d == 0 and self.root is not None:
                moves[:] = True
            still, rows = self.at[d][~moves], self.at[d][moves]
            self.customers[still] = self.tables[still] = most[still]
            place[rows] = np.arange(len(rows))
            self.moving.append(rows)
            if d:
                self.up.append(place[self.above[rows]])
                held = still[most[still] > 0]  # customers above that never change
                seated = _counted(self.above[held], self.tables[held], len(most))
                self.fixed.append((self.count + seated)[self.moving[d - 1]])

    def sweep(self, totals: np.ndarray, base: float, rng) -> None:
        """All restaurants from the longest contexts up, so that new tables are customers above."""
        house = [totals[self.context[rows]] for rows in self.moving]
        parents = []  # the chance of each moving dish in the restaurant above
        for d in range(3):
            if d == 0:
                parents.append(np.full(len(self.moving[0]), base))
                continue
            parents.append(self._chance(d - 1, house[d - 1], parents[d - 1])[self.up[d]])
        for d in (2, 1, 0):
            rows = self.moving[d]
            if d < 2:
                below = self.moving[d + 1]
                self.customers[rows] = self.fixed[d] + _counted(self.up[d + 1], self.tables[below], len(rows))
            if d == 0 and self.root is not None:
                continue
            opening = (self.strength[d] + self.discount[d] * house[d][:, 1]) * parents[d]
            self.tables[rows] = self._step(d, self.customers[rows], self.tables[rows], opening, rng)

    def _chance(self, d: int, house: np.ndarray, parents: np.ndarray) -> np.ndarray:
        """Predictive probability of the moving dishes of a level."""
        if d == 0 and self.root is not None:
            return self.root
        rows = self.moving[d]
        dd, s = self.discount[d], self.strength[d]
        own = np.maximum(self.customers[rows] - dd * self.tables[rows], 0.0)
        return (own + (s + dd * house[:, 1]) * parents) / (s + house[:, 0])

    def samples(self, totals: np.ndarray, base: float, seed) -> Iterator[int]:
        self.find_moving()
        rng = np.random.default_rng(seed)
        for _ in range(BURN_IN):
            self.sweep(totals, base, rng)
        for k in range(SAMPLES):
            self.sweep(totals, base, rng)
            yield k

    def seats(self) -> np.ndarray:
        """Tables of the moving dishes that have a context, from which ``seat_again`` finds all."""
        return np.concatenate([self.tables[rows] for rows in self.moving[1:]])

    def seat_again(self, tables: np.ndarray) -> None:
        one, two = self.moving[1:]
        self.tables[one], self.tables[two] = tables[: len(one)], tables[len(one) :]
        self.customers[one] = self.fixed[1] + _counted(self.up[2], self.tables[two], len(one))

    def sums(self, kinds: int) -> np.ndarray:
        return np.stack([np.bincount(self.context, self.customers, kinds), np.bincount(self.context, self.tables, kinds)], axis=1)


@dataclass
class Homes:
    """Where sums by key are: a home has the keys of its remainder; some homes together are one group of rows."""

    homes: int

    @property
    def groups(self) -> int:
        return max(1, self.homes // 4, min(self.homes, 8))

    @property
    def shelves(self) -> int:
        """Homes in a group, at most."""
        return -(-self.homes // self.groups)

    def of(self, keys: np.ndarray, half: int, halves: int) -> Callable[[int], np.ndarray]:
        """The places of a group's keys of this half, in the order of the keys if these are."""
        home = (keys % np.uint64(self.homes)).astype(np.int64)
        group = np.where(home // self.groups % halves == half, home % self.groups, self.groups)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(self.groups + 1))
        return lambda g: order[bounds[g] : bounds[g + 1]]


class Opened:
    """The dishes of one shard by level, with the hashes that name words and contexts."""

    def __init__(self, cell):
        self.names, runs, before, one, two, count = unpack(cell)
        one, two, count = one.astype(np.int64), two.astype(np.int64), count.astype(np.int64)
        word = np.repeat(np.arange(len(self.names)), runs.astype(np.int64))
        n = len(self.names)
        first, second = before[one], before[two]
        pair, root = second != 0, first == ROOT
        self.kind = np.where(pair, 0, np.where(root, 2, 1))
        # Each dish is also one of the context's parent, which may not have been seen by itself.
        level, above = np.unique((word * len(before) + one)[~root], return_inverse=True)
        self.word1 = level // len(before)
        single = (~pair)[~root]
        self.direct1 = _counted(above[single], np.ones(single.sum()), len(level))
        self.count1 = _counted(above[single], count[~root][single], len(level))
        self.direct0, self.count0 = _counted(word[root], np.ones(root.sum()), n), _counted(word[root], count[root], n)
        self.word2, self.above2, self.count2 = word[pair], above[~single], count[pair]
        used, self.context1 = np.unique(level % len(before), return_inverse=True)
        self.ones = before[used]
        self.owns, self.first2, self.context2 = np.unique(_context(first[pair], second[pair]), return_index=True, return_inverse=True)
        self.seen = _counted(word, count, n)
        # One table a dish, as in Kneser-Ney smoothing: sums to begin with, and counts of counts.
        self.tables2 = np.minimum(1, self.count2)
        self.customers1 = self.count1 + _counted(self.above2, self.tables2, len(level))
        self.tables1 = np.minimum(1, self.customers1)
        self.customers0 = self.count0 + _counted(self.word1, self.tables1, n)

    def letters(self, homes: Homes, half: int, halves: int) -> Iterator[tuple[int, bytes]]:
        """A row a group: keys and sums of contexts, whether more than one table a dish may come, and words."""
        one, two = len(self.ones), len(self.owns)
        sums = [np.concatenate([_counted(self.context1, a, one), _counted(self.context2, b, two)]) for a, b in ((self.customers1, self.count2), (self.tables1, self.tables2))]
        moves = np.append(np.ones(one, dtype=np.int64), np.minimum(1, _counted(self.context2, self.count2 >= 2, two)))
        of = [homes.of(x, half, halves) for x in (self.ones, self.owns, self.names)]
        for g in range(homes.groups):
            a, b, c = (f(g) for f in of)
            mine = np.append(a, one + b)
            if len(mine) or len(c):
                yield g, pack(self.ones[a], self.owns[b], *(x[mine] for x in (*sums, moves)), self.names[c], self.seen[c], self.customers0[c])

    def once(self) -> np.ndarray:
        return np.array([(x == n).sum() for x in (self.customers1, self.count2) for n in (1, 2)])

    def settled(self, answers: list[tuple[int, int, bytes]], homes: Homes, halves: int) -> bytes:
        """The shard as it is kept: no hashes, but contexts in the order in which homes know them or first come."""
        one, two, n = len(self.ones), len(self.owns), len(self.names)
        known = [np.empty((k, w), dtype=np.int64) for k, w in ((one, 3), (two, 4), (n, 4))]
        for half in range(halves):
            of = [homes.of(x, half, halves) for x in (self.ones, self.owns, self.names)]
            for g, blob in ((g, x) for g, h, x in answers if h == half):
                a, b, c = (f(g) for f in of)
                customers, tables, moves, places, words, customers0, tables0, seen = (x.view(np.int64) for x in unpack(blob))
                name = np.int64(g << 40)
                known[0][a] = np.stack([name + places[: len(a)], customers[: len(a)], tables[: len(a)]], axis=1)
                known[1][b] = np.stack([name + places[len(a) :], customers[len(a) :], tables[len(a) :], moves[len(a) :]], axis=1)
                known[2][c] = np.stack([name + words, customers0, tables0, seen], axis=1)
        order1, order0 = np.argsort(known[0][:, 0]), np.argsort(known[2][:, 0])
        number1, number2 = np.empty(one, dtype=np.int64), np.empty(two, dtype=np.int64)
        number1[order1] = np.arange(one)
        come = np.argsort(self.first2)
        number2[come] = np.arange(two)
        moving = np.flatnonzero(known[1][:, 3])
        moving = moving[np.argsort(known[1][moving, 0])]
        new = np.zeros(len(self.context2), dtype=np.int64)
        new[self.first2] = 1
        back = np.where(new == 1, 0, np.cumsum(new) - number2[self.context2])
        runs1, runs2 = _counted(self.word1, np.ones(len(self.word1)), n), _counted(self.word2, np.ones(len(self.word2)), n)
        start = np.cumsum(runs1) - runs1
        return pack(
            runs1, number1[self.context1], self.count1, runs2, self.above2 - start[self.word2], back, self.count2, self.count0, known[2][:, 3],
            self.kind, self.direct1, self.direct0, known[0][order1, 0], known[1][moving, 0], known[2][order0, 0], number2[moving], order0,
            *known[0][order1, 1:].T, *known[1][come, 1:3].T, *known[2][:, 1:3].T,
        )


class Shard:
    """One shard as it is kept: its dishes, and what homes have told once for all."""

    def __init__(self, cell):
        (runs1, self.context1, self.count1, runs2, above2, back, self.count2, self.count0, self.seen, self.kind, self.direct1, self.direct0,
         *self.places, self.moving2, self.order0, customers1, tables1, customers2, tables2, customers0, tables0) = (x.view(np.int64) for x in unpack(cell))
        n = len(runs1)
        self.word1, self.word2 = np.repeat(np.arange(n), runs1), np.repeat(np.arange(n), runs2)
        self.above2 = above2 + (np.cumsum(runs1) - runs1)[self.word2]
        self.context2 = np.cumsum(back == 0) - np.where(back == 0, 1, back)
        self.n, self.ones = n, len(customers1)
        # By context: none, words, pairs. To begin with, of the only sample.
        self.totals = np.concatenate([np.zeros((1, 2)), np.stack([customers1, tables1], axis=1), np.stack([customers2, tables2], axis=1)]).astype(float)
        self.words = np.stack([customers0, tables0]).astype(float)

    def bounds(self, groups: int) -> list[np.ndarray]:
        return [np.searchsorted(x, np.arange(groups + 1) << 40) for x in self.places]

    def seating(self, discounts) -> Seating:
        contexts = [np.zeros(self.n, dtype=np.int64), 1 + self.context1, 1 + self.ones + self.context2]
        return Seating.of_levels(contexts, [self.count0, self.count1, self.count2], [self.word1, self.above2], discounts)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the dishes that texts name, in the order of ``_merge``: place among all dishes, and word."""
        row = np.empty(len(self.kind), dtype=np.int64)
        row[self.kind == 0] = self.n + len(self.word1) + np.arange(len(self.word2))
        row[self.kind == 1] = self.n + np.flatnonzero(self.direct1)
        row[self.kind == 2] = np.flatnonzero(self.direct0)
        return row, np.concatenate([np.arange(self.n), self.word1, self.word2])[row]

    def letters(self, sums: list[tuple[np.ndarray, np.ndarray]], groups: int) -> Iterator[tuple[int, bytes]]:
        """A row a group: places there, then sums of the first sample and how those of others differ."""
        bounds = self.bounds(groups)
        words = [w[self.order0] for _, w in sums]
        for g in range(groups):
            a, b, c = (slice(x[g], x[g + 1]) for x in bounds)
            if any(x[g] < x[g + 1] for x in bounds):
                each = [np.concatenate([*t[1 : 1 + self.ones][a].T, *t[1 + self.ones :][self.moving2[b]].T, w[c]]) for (t, _), w in zip(sums, words, strict=True)]
                yield g, pack(*(x[s] & ((1 << 40) - 1) for x, s in zip(self.places, (a, b, c), strict=True)), *_apart(each))

    def told(self, answers: list[tuple[int, bytes]], groups: int) -> tuple[np.ndarray, np.ndarray]:
        """Totals by sample, context and kind; customers and tables of words by sample."""
        bounds = self.bounds(groups)
        totals = words = None
        for g, blob in answers:
            each = _together(*unpack(blob))
            if totals is None:
                totals, words = np.repeat(self.totals[None], len(each), axis=0), np.zeros((len(each), 2, self.n))
            a, b, c = (slice(x[g], x[g + 1]) for x in bounds)
            own, two = a.stop - a.start, b.stop - b.start
            sizes = np.cumsum([own, own, two, two, c.stop - c.start])
            for k, x in enumerate(each):
                c1, t1, c2, t2, c0, t0 = np.split(x, sizes)
                totals[k, 1 : 1 + self.ones][a] = np.stack([c1, t1], axis=1)
                totals[k, 1 + self.ones + self.moving2[b]] = np.stack([c2, t2], axis=1)
                words[k][:, self.order0[c]] = c0, t0
        return totals, words


def _apart(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first sample, and how the others differ, which mostly is little."""
    return each[0], np.concatenate([x - each[0] for x in each[1:]] or [each[0][:0]])


def _together(first: np.ndarray, others: np.ndarray) -> list[np.ndarray]:
    first = first.view(np.int64)
    return [first, *(first + x for x in others.view(np.int64).reshape(-1, len(first)))] if len(first) else [first]


def _narrow(x: np.ndarray) -> np.ndarray:
    """In half the memory, if the numbers are that small."""
    return x.astype(np.int32 if x.max(initial=0) < 1 << 31 else np.int64)


def _chance(words: np.ndarray, house: np.ndarray, base: float, discount: float) -> np.ndarray:
    """Of each word without context, from its customers and tables and those of all words."""
    (c, t), s = words, STRENGTH[0]
    return (np.maximum(c - discount * t, 0.0) + (s + discount * house[1]) * base) / (s + house[0])


def _introduced(group: pa.Table, half: int, halves: int, homes: Homes) -> tuple[list[bytes], np.ndarray]:
    """The first answer of a group for each shard: sums of its keys, and the places by which to name them from now on.

    Also what the driver needs for the vocabulary: training tokens and words, words by one and two customers, customers and tables.
    """
    blobs = [x.as_buffer() for x in group.column("cell")]
    column = lambda *k: np.concatenate([y for x in blobs for y in unpack(x, *k)])  # noqa: E731  few at a time: a group is large
    sizes = np.array([(len(a) + len(b), len(c)) for a, b, c in (unpack(x, 0, 1, 5) for x in blobs)])
    keys, at = np.unique(column(0, 1), return_inverse=True)
    at = at.astype(np.int32)
    customers, tables, moves = (_counted(at, column(k), len(keys)) for k in (2, 3, 4))
    place = (np.cumsum(moves > 0) - 1) * halves + half
    del keys
    names, word = np.unique(column(5), return_inverse=True)
    seen, customers0 = (_counted(word, column(k), len(names)) for k in (6, 7))
    tables0 = np.minimum(1, customers0)
    # A word's place tells its home and how many lesser words there are at that.
    shelf = (names % np.uint64(homes.homes)).astype(np.int64) // homes.groups
    stand = np.empty(len(names), dtype=np.int64)
    for k in range(homes.shelves):
        own = shelf == k
        stand[own] = np.arange(own.sum()) * homes.shelves + k
    out = []
    ends = np.cumsum(sizes, axis=0) - sizes
    for (a, c), (n, w) in zip(ends.tolist(), sizes.tolist(), strict=True):
        x, y = at[a : a + n], word[c : c + w]
        moving = np.minimum(1, moves[x])
        out.append(pack(customers[x], tables[x], moving, np.where(moving == 1, place[x], 0), stand[y], customers0[y], tables0[y], seen[y]))
    return out, np.array([seen.sum(), (seen > 0).sum(), (customers0 == 1).sum(), (customers0 == 2).sum(), customers0.sum(), tables0.sum()])


def _answered(group: pa.Table, last: bool, homes: Homes, number: int, house: np.ndarray, base: float, discounts) -> tuple[list[bytes], np.ndarray]:
    """A group's answer for each shard, by sample or (if not the last) added up; customers and tables of all its words by sample."""
    blobs = [x.as_buffer() for x in group.column("cell")]
    each, sizes, at, word = [], [], [], []
    for x in blobs:
        one, two, words, *sums = unpack(x)
        each.append([_narrow(y) for y in _together(*sums)])
        sizes.append(np.cumsum([len(one), len(one), len(two), len(two)]))
        at.append(_narrow(np.concatenate([one, two])))
        word.append(_narrow(words))
    samples = max(len(x) for x in each)
    every, words = np.concatenate(at), np.concatenate(word)
    size, stands = (int(x.max()) + 1 if len(x) else 0 for x in (every, words))
    seat = Seating(*(np.zeros(1, dtype=np.int64),) * 3, np.zeros(1, dtype=np.int64), discounts)
    opening = (seat.strength[0] + discounts[0] * house[1]) * base
    draw = [np.random.default_rng([SEED, homes.homes + number + k * homes.groups]) for k in range(homes.shelves)]
    told, sums = np.zeros((samples, 2)), []
    for k in range(samples):
        split = [np.split(x[k], s) for x, s in zip(each, sizes, strict=True)]
        by_context = [_counted(every, np.concatenate([y for x in split for y in (x[c], x[2 + c])]), size) for c in (0, 1)]
        customers = _counted(words, np.concatenate([x[4] for x in split]), stands)
        tables = np.zeros_like(customers)
        for shelf, rng in enumerate(draw):
            own = customers[shelf :: homes.shelves]
            tables[shelf :: homes.shelves] = seat._step(0, own, own, np.full(len(own), opening), rng)
        told[k] = customers.sum(), tables.sum()
        sums.append((*by_context, customers, tables))
    if not last:
        sums = [tuple(sum(x) for x in zip(*sums, strict=True))]
    out = []
    for x, y, s in zip(at, word, sizes, strict=True):
        one, two = x[: s[0]], x[s[0] :]
        out.append(pack(*_apart([np.concatenate([c[one], t[one], c[two], t[two], w[y], v[y]]) for c, t, w, v in sums])))
    return out, told


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {c: b.column(i)[k].as_py() for i, c in enumerate(b.schema.names)}


class Kept:
    """Tables below the shared folder that are deleted as soon as the steps that read them are over."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, label: str, by: str | None = None) -> DataFrame:
        path = scratch_path(self.spark, label)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = found, path
        return found

    def drop(self, df: DataFrame, below: str = "") -> None:
        discard(self.spark, self.paths[id(df)][1] + below)


def _turns(docs: DataFrame) -> tuple[DataFrame, int]:
    """The texts in an order that stays, and how often to read them. What a shuffle puts out may come in
    another order each time: it is written first."""
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = materialize(docs, "texts")
    return docs, min(TURNS, max(1, docs.rdd.getNumPartitions() // 2))


def score_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", share: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    * Learns from rows whose crc32 of the id as text is not 1 modulo 5 (a null id is the empty text).
    * Every word and every pair of words is a context; with ``share``, those of ``find_contexts``.
    * Null and empty texts are one end. Repeated rows are separate texts and score alike.
    * A word never seen in training has the probability of the one unknown word.
    * An empty table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    chosen, turns = _turns(chosen)
    halves = HALVES if turns > 1 else 1
    contexts = None if share is None else find_contexts(chosen, share)
    shards = SHARDS_A_PARTITION * partitions(spark)
    homes = Homes(partitions(spark))
    kept = Kept(spark)
    schema = f"shard bigint, block bigint, cell binary, ids array<{kind}>, n_tokens array<bigint>, held_out array<boolean>, texts bigint"
    merged_schema = f"part int, {schema}"
    types, merged_types = _arrow(spark, schema), _arrow(spark, merged_schema)
    ship(spark)

    def send(turn):
        def run(batches):
            block = TaskContext.get().partitionId() << 24
            for ids, texts in _blocks(batches):
                for row in _send(ids, texts, contexts, shards, block, turn, turns):
                    if row["shard"] >= 0:
                        sent = {"shard": row["shard"], "block": block, "cell": pack(*(row[c] for c in _CELL))}
                    else:
                        mark = zlib.crc32(b"\0".join(texts))  # tells that all turns read the same
                        sent = {"shard": row["shard"], "block": block, "cell": pack(row["occurs"], row["docs"]), "texts": mark}
                        sent |= {c: row[c] for c in (("ids", "n_tokens", "held_out") if turn == 0 else ())}
                    yield pa.RecordBatch.from_pylist([sent], types)
                block += 1

        return run

    def merge(group):
        first = group.column("shard")[0].as_py()
        if first >= 0:
            return pa.Table.from_pylist([{"shard": first, **row} for row in _merge(group)], merged_types)
        return pa.Table.from_pylist([{"part": BLOCKS, **row} for row in group.to_pylist()], merged_types)

    everything = []
    for turn in range(turns):
        sent = map_batches(chosen, send(turn), schema)
        everything.append(kept.write(sent.groupBy("shard").applyInArrow(merge, merged_schema), "shards", "part"))
        del sent
        release(spark)
    dishes = [x.filter(F.col("part") == DISHES).select("shard", "block", "cell") for x in everything]
    letter, answer = "home bigint, shard bigint, cell binary", "shard bigint, home bigint, half int, cell binary"
    letter_types, answer_types = _arrow(spark, letter), _arrow(spark, answer)

    def ask(letters: DataFrame, home: Callable, label: str, half: int = 0) -> tuple[DataFrame, dict[int, np.ndarray]]:
        """The homes' answers by shard, and what each group tells the driver."""

        def run(group):
            number = group.column("home")[0].as_py()
            if number < 0:
                cells, told = [], np.sum([unpack(x)[0].astype(np.int64) for x in group.column("cell").to_pylist()], axis=0)
            else:
                cells, told = home(group, number)
            rows = [{"shard": -1, "home": number, "half": half, "cell": np.asarray(told, dtype="<f8").tobytes()}]
            rows += [{"shard": s, "home": number, "half": half, "cell": x} for s, x in zip(group.column("shard").to_pylist(), cells, strict=number >= 0)]
            return pa.Table.from_pylist(rows, answer_types)

        found = kept.write(letters.groupBy("home").applyInArrow(run, answer), label)
        told = {r[0]: np.frombuffer(r[1], dtype="<f8") for r in found.filter("shard = -1").select("home", "cell").collect()}  # a row a group
        return found, told

    def begin(half):
        def run(batches):
            for row in _rows(batches):
                opened = Opened(row["cell"])
                rows = [{"home": g, "shard": row["shard"], "cell": x} for g, x in opened.letters(homes, half, halves)]
                if half == 0:
                    rows.append({"home": -1, "shard": row["shard"], "cell": pack(opened.once())})
                yield pa.RecordBatch.from_pylist(rows, letter_types)

        return run

    introduced, vocabulary_told, once = [], np.zeros(6), np.zeros(4)
    for half in range(halves):
        found, told = ask(map_batches(_union(dishes), begin(half), letter), lambda g, _, half=half: _introduced(g, half, halves, homes), "totals", half)
        release(spark)  # only now does nothing name the letters
        introduced.append(found)
        once += told.pop(-1, 0)
        vocabulary_told += sum(told.values())
    train_tokens, vocabulary = int(vocabulary_told[0]), int(vocabulary_told[1])
    base = 1.0 / (vocabulary + 1)
    counts = [vocabulary_told[2:4], once[:2], once[2:]]
    discounts = tuple(min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2))) if n1 + n2 else 1 / 3 for n1, n2 in counts)
    house = vocabulary_told[None, 4:]

    def settle(left, right):
        opened = Opened(left.column("cell")[0].as_py())
        cell = opened.settled([(r["home"], r["half"], r["cell"]) for r in right.to_pylist()], homes, halves)
        return pa.Table.from_pylist([{"shard": left.column("shard")[0].as_py(), "block": -1, "cell": cell}], place_types)

    place_schema = "shard bigint, block bigint, cell binary"
    place_types = _arrow(spark, place_schema)

    def of_turn(df: DataFrame, turn: int) -> DataFrame:
        return df.filter((F.col("shard") >= 0) & (F.col("shard") % turns == turn))

    settled = []
    for turn in range(turns):
        pieces = []
        for piece in range(PIECES if turns > 1 else 1):
            some = F.expr(f"shard div {turns} % {PIECES if turns > 1 else 1} = {piece}")
            left, answers = dishes[turn].filter(some), of_turn(_union(introduced), turn).filter(some)
            pieces.append(kept.write(left.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(settle, place_schema), "dishes"))
            del left, answers
            release(spark)
        settled.append(_union(pieces))
        kept.drop(everything[turn], f"/part={DISHES}")
    for x in introduced:
        kept.drop(x)

    def given(shard: Shard, rows: list[dict], house: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals of contexts and the chances of words without context, as means of the samples before."""
        if not rows:
            return shard.totals, _chance(shard.words, house.mean(0), base, discounts[0])
        totals, words = shard.told([(r["home"], r["cell"]) for r in rows], homes.groups)
        totals[0, 1 : 1 + shard.ones] /= SAMPLES
        totals[0, 1 + shard.ones + shard.moving2] /= SAMPLES
        return totals[0], _chance(words[0] / SAMPLES, house.mean(0), base, discounts[0])

    def sampled(number: int, cell, rows: list[dict], house: np.ndarray, last: bool) -> pa.Table:
        shard = Shard(cell)
        seat = shard.seating(discounts)
        totals, seat.root = given(shard, rows, house)
        sums, seats = [], []
        for _ in seat.samples(totals, base, [SEED, number]):
            sums.append((seat.sums(len(totals)).astype(np.int64), seat.customers[seat.at[0]]))
            seats.append(seat.seats())
        out = [{"home": g, "shard": number, "cell": x} for g, x in shard.letters(sums, homes.groups)]
        return pa.Table.from_pylist([*out, *([{"home": SEATS, "shard": number, "cell": pack(*_apart(seats))}] if last else [])], letter_types)

    def first_round(house, last):
        def run(batches):
            for row in _rows(batches):
                yield from sampled(row["shard"], row["cell"], [], house, last).to_batches()

        return run

    def next_round(house, last):
        return lambda left, right: sampled(left.column("shard")[0].as_py(), left.column("cell")[0].as_py(), right.to_pylist(), house, last)

    after = None
    for k in range(rounds):
        before, last, letters = after, k == rounds - 1, []
        for turn in range(turns):
            if before is None:
                asked = map_batches(settled[turn], first_round(house, last), letter)
            else:
                asked = settled[turn].groupBy("shard").cogroup(of_turn(before, turn).groupBy("shard")).applyInArrow(next_round(house, last), letter)
            if turns > 1 or last:
                asked = kept.write(asked, "letters")
                release(spark)
            letters.append(asked)
        given_house = house.mean(0)
        after, told = ask(_union(letters).filter("home >= 0"), lambda g, h, last=last, house=given_house: _answered(g, last, homes, h, house, base, discounts), "totals")
        release(spark)
        house = sum((x.reshape(-1, 2) for x in told.values()), np.zeros((SAMPLES, 2)))
        for x in [before] if before is not None else []:
            kept.drop(x)
        for x in letters if turns > 1 and not last else []:
            kept.drop(x)

    def score(left, right):
        number = left.column("shard")[0].as_py()
        blocks = dict(zip(left.column("block").to_pylist(), left.column("cell").to_pylist(), strict=True))
        shard, seats = Shard(blocks.pop(-1)), _together(*unpack(blocks.pop(SEATS)))
        seat = shard.seating(discounts)
        drawn, words = shard.told([(r["home"], r["cell"]) for r in right.to_pylist()], homes.groups)
        chance = np.zeros(len(seat.context))
        for k in range(SAMPLES):
            seat.root = _chance(words[k], house[k], base, discounts[0])
            if k == 0:
                seat.find_moving()
            seat.seat_again(seats[min(k, len(seats) - 1)])  # once if no dish has a choice
            chance += seat.chances(drawn[k], base) / SAMPLES
        at, word = shard.rows()
        chance, seen = np.log10(chance[at]).astype("<f4"), shard.seen[word]
        out = []
        for block, cell in blocks.items():
            place = unpack(cell)[0].astype(np.int64)
            out.append({"block": block, "shard": number, "seen": pack(seen[place]), "score": chance[place].tobytes()})
        return pa.Table.from_pylist(out, part_types)

    part_schema = "block bigint, shard bigint, seen binary, score binary"
    part_types = _arrow(spark, part_schema)

    def add(left, right):
        own = left.to_pylist()[0]
        rows = sorted(right.to_pylist(), key=lambda r: r["shard"])
        occurs, doc = (x.astype(np.int64) for x in unpack(own["cell"]))
        seen = np.repeat(np.concatenate([np.zeros(0), *(unpack(r["seen"])[0].astype(float) for r in rows)]), occurs)
        chance = np.repeat(np.concatenate([np.zeros(0, "<f4"), *(np.frombuffer(r["score"], dtype="<f4") for r in rows)]), occurs)
        plain = np.log10((seen + 0.5) / (train_tokens + 0.5 * (vocabulary + 1)))
        n = int(doc.max(initial=-1)) + 1
        known, plain, scored = (np.bincount(doc, v, n).tolist() for v in (seen > 0, plain, chance))
        row = {"block": own["block"], "known": known, "plain": plain, "scored": scored}
        return pa.Table.from_pylist([row | {c: own[c] for c in ("ids", "n_tokens", "held_out", "texts")}], sum_types)

    sum_schema = f"block bigint, ids array<{kind}>, n_tokens array<bigint>, held_out array<boolean>, texts bigint, known array<double>, plain array<double>, scored array<double>"
    sum_types = _arrow(spark, sum_schema)
    parts = []
    for turn in range(turns):
        places = everything[turn].filter(F.col("part") == PLACES).select("shard", "block", "cell")
        seats = letters[turn].filter(F.col("home") == SEATS).select("shard", F.lit(SEATS).cast("bigint").alias("block"), "cell")
        part = _union([settled[turn], seats, places]).groupBy("shard").cogroup(of_turn(after, turn).groupBy("shard")).applyInArrow(score, part_schema)
        blocks = everything[turn].filter(F.col("part") == BLOCKS).drop("part", "shard")
        part = blocks.groupBy("block").cogroup(part.groupBy("block")).applyInArrow(add, sum_schema)
        if turns > 1:
            part = kept.write(part, "scores")
            release(spark)
        parts.append(part)

    def total(group):
        rows = group.to_pylist()
        own = next(r for r in rows if r["ids"] is not None)
        if len({r["texts"] for r in rows}) > 1 or len(rows) != turns:
            raise RuntimeError("the texts came in another order when they were read again")
        n = len(own["ids"])
        sums = np.zeros((3, n))
        for r in rows:
            for k, c in enumerate(("known", "plain", "scored")):
                sums[k, : len(r[c])] += r[c]
        return pa.table(
            [pa.array(own["ids"], final.field(0).type), pa.array(own["held_out"]), pa.array(own["n_tokens"], pa.int64()),
             pa.array(np.round(sums[0]).astype(np.int64)), pa.array([train_tokens] * n, pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
            final,
        )

    final_schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    final = _arrow(spark, final_schema)
    return _union(parts).groupBy("block").applyInArrow(total, final_schema)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _arrow(spark, schema: str) -> pa.Schema:
    """The Arrow form of a DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def op1_pitman_yor(spark, sf_dir: str) -> DataFrame:
    """Scores of every document; see ``score_texts``."""
    return score_texts(table(spark, sf_dir, "documents"))
