"""Remove repeated passages: every byte in a string of ``length`` bytes that also starts earlier.

Suffixes are compared on their first ``length`` bytes, in buckets, a bucket at a time, with a
difference cover to keep memory and traffic small. A cover of v is a set D so that for any two
positions some shift below v brings both to a place that is in D modulo v.

1. Cover samples: positions p of a text with p mod v in D are named by the ``length - v + 1``
   bytes that follow. Two equal strings share a sample at equal places, so only suffixes within v
   before a sample whose name occurs again can repeat. The names of a bucket are
   sorted in one task; a block is told which of its samples have a namesake.
2. Texts with such suffixes are put in order of doc_id and cut into blocks.
3. Buckets of the remaining suffixes: a block sends each of its suffixes' names once, a bucket's
   task sorts them, and a block is told which occur in an earlier block. Suffixes that repeat
   inside a block are found there.
4. The strings found cover the bytes to remove.

Names are 64-bit fingerprints (32 bits beside the bucket's number in step 1, where a false
namesake only costs work). Only equality of strings counts here, so names stand in for ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import give_back, map_batches, partitions, release, ship, table
from daybook.llm.words import distinct, prefix_sums, spans
from daybook.session import materialize

LENGTH = 100
BLOCK_ROWS = 500
BLOCK_BYTES = 8_000_000
# Suffix buckets are sorted in so many turns, one after the other, which bounds what lies on disk.
TURNS = 2
# So many bytes are fingerprinted at a time, and so many ranges of names looked at one after the
# other: what a worker holds beside a block's names does not grow with the block.
NAMED_BYTES = 500_000
NAME_BITS = 4
# Perfect difference sets, all differences modulo v exactly once.
COVERS = {
    1: (0,),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}


def cover_of(length: int) -> tuple[int, np.ndarray]:
    """The longest cover that leaves samples at least two fifths of ``length`` to be named by."""
    v = max(v for v in COVERS if v == 1 or v * 100 <= 57 * length)
    inside = np.zeros(v, dtype=bool)
    inside[list(COVERS[v])] = True
    return v, inside


class Texts:
    """Texts of a block, one after the other."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.sizes)])
        self.raw = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(place in its text, bytes left in it) of every byte."""
        every = np.arange(len(self.raw))
        first = np.repeat(self.start[:-1], self.sizes)
        return every - first, np.repeat(self.start[1:], self.sizes) - every

    def named(self, at: np.ndarray, length: int) -> Iterator[np.ndarray]:
        """Names of the strings at ascending positions, ``NAMED_BYTES`` of the block at a time."""
        cut = np.searchsorted(at, np.arange(0, len(self.raw) + NAMED_BYTES, NAMED_BYTES)).tolist()
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if j > i:
                first = at[i]
                here = at[i:j] - first
                yield spans(prefix_sums(self.raw[first : at[j - 1] + length]), here, here + length)

    def names(self, at: np.ndarray, length: int) -> np.ndarray:
        out, done = np.empty(len(at), dtype=np.uint64), 0
        for part in self.named(at, length):
            out[done : done + len(part)] = part
            done += len(part)
        return out


def _samples(texts: Texts, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the cover samples; a key is a bucket's number and 32 bits of the name."""
    v, inside = cover_of(length)
    place, left = texts.places()
    at = np.flatnonzero(inside[place % v] & (left >= length - v + 1))
    name = texts.names(at, length - v + 1)
    return at, ((name >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (name & np.uint64(0xFFFFFFFF))


def _ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places the ranges cover."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n], dtype=np.int32) > 0


def _bits(raw: list[bytes], sizes: list[int]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(r, dtype=np.uint8), count=n) for r, n in zip(raw, sizes, strict=True)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, dtype=bool)


def _namesakes(group: pa.Table) -> pa.Table:
    """One bucket of sample names: for each block, which of them occur more than once in all."""
    keys = [np.frombuffer(x, dtype="<u4") for x in group.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    again = _bits(group.column("again").to_pylist(), sizes)
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    start = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    run = np.cumsum(start) - 1
    several = (np.bincount(run) > 1) | (np.bincount(run, again[order]) > 0)
    out = np.zeros(len(flat), dtype=bool)
    out[order] = several[run]
    return _told(group, out, sizes)


def _earlier(group: pa.Table) -> pa.Table:
    """One bucket of suffix names: for each block, which of them occur in an earlier block."""
    order = np.argsort(group.column("block").to_numpy(), kind="stable")
    group = group.take(pa.array(order))
    names = [_unsqueezed(x) for x in group.column("keys").to_pylist()]
    sizes = [len(k) for k in names]
    flat = np.concatenate(names)
    order = np.argsort(flat, kind="stable")
    out = np.zeros(len(flat), dtype=bool)
    out[order[1:]] = flat[order][1:] == flat[order][:-1]
    return _told(group, out, sizes)


def _told(group: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    cut = np.cumsum(sizes)[:-1]
    packed = [np.packbits(x).tobytes() for x in np.split(flags, cut)]
    return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "flags": pa.array(packed, pa.binary()), "n": pa.array(sizes, pa.int64())})


_TOLD = "block bigint, bucket int, flags binary, n bigint"


def _flags(told: pa.Table) -> np.ndarray:
    """Answers of all buckets, in the order in which the block sorts its keys."""
    order = np.argsort(told.column("bucket").to_numpy(), kind="stable")
    told = told.take(pa.array(order))
    return _bits(told.column("flags").to_pylist(), told.column("n").to_pylist())


def _squeezed(names: np.ndarray) -> bytes:
    """Sorted names: the first, then steps in as many bytes as the largest needs."""
    steps = np.diff(names)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + names[:1].tobytes() + steps.view("u1").reshape(-1, 8)[:, :width].tobytes()


def _unsqueezed(raw: bytes) -> np.ndarray:
    width = raw[0]
    steps = np.frombuffer(raw, dtype="u1", offset=9).reshape(-1, width)
    out = np.zeros((len(steps) + 1, 8), dtype="u1")
    out[1:, :width] = steps
    out[0] = np.frombuffer(raw, dtype="u1", count=8, offset=1)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _as_bytes(column) -> list[bytes]:
    return [b"" if x is None else x for x in column.to_pylist()]


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Rows (block, text) of one block together; a block's rows are neighbours."""
    now, texts = None, []
    for b in batches:
        for block, text in zip(b.column(0).to_pylist(), _as_bytes(b.column(1)), strict=True):
            if block != now and now is not None:
                yield now, texts
                texts = []
            now = block
            texts.append(text)
    if now is not None:
        yield now, texts


def _candidates(texts: Texts, flagged: np.ndarray, length: int) -> np.ndarray:
    """Suffixes that can repeat: within the cover's length before a flagged sample, and long enough."""
    v, _ = cover_of(length)
    first = np.repeat(texts.start[:-1], texts.sizes)
    near = _covered(len(texts.raw), np.maximum(flagged - v + 1, first[flagged]), flagged + 1)
    _, left = texts.places()
    return near & (left >= length)


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text", same_again: bool = False, with_kept: bool = True
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` is the remaining bytes.

    Blocks of rows are read twice. ``same_again`` says that ``docs`` gives the same rows in the
    same partitions each time, as a scan of files does; else they are written first. A block that
    does come back otherwise raises. Without ``with_kept`` that column is left out.

    * Texts are their UTF-8 bytes; null texts are empty. Earlier is a smaller doc_id (null first),
      or the same one in the order in which Spark reads rows of one id, or an earlier start.
    * Strings are judged on the input: what is removed still counts as an earlier place.
    * Texts shorter than ``length`` stay as they are. Repeated rows are repeats of the first.
    * An empty table gives an empty result; further columns are left out.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    row = F.monotonically_increasing_id()
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), row.alias("row"), F.col(f"`{text_column}`").cast("binary").alias("text"))
    if not same_again:
        rows = materialize(rows, "numbered")
    # Partitions of a scan are numbered in the high bits, so a block lies in one of them.
    rows = rows.withColumn("block", F.floor(F.col("row") / BLOCK_ROWS))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def send_samples(batches):
        for block, own in _by_block(batches):
            _, keys = _samples(Texts(own), length, buckets)
            keys, count = np.unique(keys, return_counts=True)
            bucket = (keys >> np.uint64(32)).astype(np.int64)
            for b, lo, hi in _runs(bucket):
                part = keys[lo:hi].astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bucket": pa.array([b], pa.int32()), "keys": [part], "again": [np.packbits(count[lo:hi] > 1).tobytes()]})

    ship(spark)
    sent = map_batches(rows.select("block", "text"), send_samples, "block bigint, bucket int, keys binary, again binary")
    told = materialize(sent.groupBy("bucket").applyInArrow(_namesakes, _TOLD), "namesakes")
    del sent
    release(spark)

    def split(texts: pa.Table, told: pa.Table) -> pa.Table:
        texts = texts.take(pa.array(np.argsort(texts.column("row").to_numpy(), kind="stable")))
        own = _as_bytes(texts.column("text"))
        joined = Texts(own)
        at, keys = _samples(joined, length, buckets)
        known, place = np.unique(keys, return_inverse=True)
        flags = _flags(told)
        sizes = dict(zip(told.column("bucket").to_pylist(), told.column("n").to_pylist(), strict=True))
        if {b: hi - lo for b, lo, hi in _runs((known >> np.uint64(32)).astype(np.int64))} != sizes:
            raise ValueError("a block was read in another way the second time")
        near = _candidates(joined, at[flags[place]], length)
        starts, ends = _ranges(near)
        of = np.searchsorted(joined.start, starts, side="right") - 1
        # A range can run on into the next text only if no byte of it is too near to an end.
        lists = [[] for _ in own]
        for k, s, e in zip(of.tolist(), (starts - joined.start[of]).tolist(), (ends - joined.start[of]).tolist(), strict=True):
            lists[k] += [s, e]
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "row": texts.column("row"),
                "text": pa.array([t if x else None for t, x in zip(own, lists, strict=True)], pa.binary()),
                "ranges": pa.array([np.array(x, dtype="<u4").tobytes() for x in lists], pa.binary()),
                "n_bytes": pa.array([len(t) for t in own], pa.int64()),
                "kept_sha256": pa.array([None if x else hashlib.sha256(t).hexdigest() for t, x in zip(own, lists, strict=True)], pa.string()),
                "whole": pa.array([None if x or not with_kept else t for t, x in zip(own, lists, strict=True)], pa.binary()),
            }
        )

    schema = f"doc_id {kind}, row bigint, text binary, ranges binary, n_bytes bigint, kept_sha256 string, whole binary"
    parted = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(split, schema)
    out = _finish(spark, parted, kind, length, buckets, with_kept)
    return out if with_kept else out.drop("kept")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cut = np.flatnonzero(np.diff(values)) + 1
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(values)], strict=True):
        if hi > lo:
            yield int(values[lo]), lo, hi


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of names, so names in order are buckets in order."""
    return (((names >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _suffixes(size_list: list[int], raw: bytes, ranges: list[bytes]) -> tuple[Texts, np.ndarray]:
    """(texts, candidate positions) of a block."""
    cut = np.concatenate([[0], np.cumsum(size_list)]).astype(np.int64)
    texts = Texts([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])
    pairs = [np.frombuffer(r, dtype="<u4").astype(np.int64).reshape(-1, 2) + s for r, s in zip(ranges, cut[:-1], strict=True)]
    pairs = np.concatenate([*pairs, np.zeros((0, 2), np.int64)])
    return texts, np.flatnonzero(_covered(len(raw), pairs[:, 0], pairs[:, 1]))


def _repeats(names: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Which names are flagged or not the first of their kind; ``flags`` belong to the distinct names in order."""
    out = np.zeros(len(names), dtype=bool)
    top, done = (names >> np.uint64(64 - NAME_BITS)).astype(np.uint8), 0
    for k in range(1 << NAME_BITS):
        mine = np.flatnonzero(top == k)
        own = names[mine]
        order = np.argsort(own, kind="stable")
        own = own[order]
        again = np.zeros(len(own), dtype=bool)
        again[1:] = own[1:] == own[:-1]
        run = np.cumsum(~again)
        out[mine[order]] = again | flags[done + run - 1]
        done += int(run[-1]) if len(run) else 0
    return out


def _finish(spark, parted: DataFrame, kind: str, length: int, buckets: int, with_kept: bool) -> DataFrame:
    parted = materialize(parted, "parted")
    release(spark)
    ordered = parted.filter("text is not null").select("doc_id", "row", "text", "ranges")
    ordered = ordered.repartitionByRange(buckets, F.col("doc_id").asc_nulls_first(), "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")

    def gather(batches):
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out():
            ids, texts, ranges = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([list(ids)], ids_type), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([b"".join(texts)], pa.binary()), pa.array([list(ranges)], pa.list_(pa.binary()))], ["block", "ids", "sizes", "raw", "ranges"])

        for b in batches:
            ids_type = pa.list_(b.column(0).type)
            for one in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                held.append(one)
                size += len(one[1])
                if size >= BLOCK_BYTES:
                    yield out()
                    block, held, size = block + 1, [], 0
        if held:
            yield out()

    blocks = materialize(map_batches(ordered, gather, f"block bigint, ids array<{kind}>, sizes array<bigint>, raw binary, ranges array<binary>"), "blocks")
    release(spark)

    def send(batches, turn):
        for b in batches:
            for r in b.to_pylist():
                texts, at = _suffixes(r["sizes"], r["raw"], r["ranges"])
                own = [x[_bucket(x, buckets) * TURNS // buckets == turn] for x in texts.named(at, length)]
                names = distinct(np.concatenate([np.zeros(0, dtype=np.uint64), *own]))
                del texts, at, own
                for k, lo, hi in _runs(_bucket(names, buckets)):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([r["block"]], pa.int64()), "bucket": pa.array([k], pa.int32()), "keys": [_squeezed(names[lo:hi])]})

    turns = []
    for turn in range(TURNS):
        sent = map_batches(blocks, lambda batches, turn=turn: send(batches, turn), "block bigint, bucket int, keys binary")
        turns.append(materialize(sent.groupBy("bucket").applyInArrow(_earlier, _TOLD), "earlier"))
        del sent
        release(spark)
    told = reduce(DataFrame.unionByName, turns)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def remove(block: pa.Table, told: pa.Table) -> pa.Table:
        r = block.to_pylist()[0]
        texts, at = _suffixes(r["sizes"], r["raw"], r["ranges"])
        starts = np.zeros(len(texts.raw), dtype=bool)
        starts[at[_repeats(texts.names(at, length), _flags(told))]] = True
        del at
        first, after = _ranges(starts)
        gone = _covered(len(texts.raw), first, after - 1 + length)
        out = []
        for i, a, b in zip(r["ids"], texts.start[:-1].tolist(), texts.start[1:].tolist(), strict=True):
            own = gone[a:b]
            kept = texts.raw[a:b][~own].tobytes()
            out.append((i, b - a, int(own.sum()), len(_ranges(own)[0]), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
        give_back()
        types = [block.schema.field("ids").type.value_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    touched = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(remove, schema)
    zero = F.lit(0).cast("long")
    whole = parted.filter("text is null").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", F.col("whole").alias("kept"))
    return whole.unionByName(touched)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that start earlier; see ``remove_repeats``."""
    return remove_repeats(table(spark, sf_dir, "documents"), same_again=True, with_kept=False)
