"""Pack documents into windows of fixed length by deficit round robin over source queues.

Each source is a queue of tokens. A round is ``ROUND`` windows; every queue's quantum for a round
is its share of the round's tokens. Inside the round a queue earns a part of its quantum per
window, gets the whole tokens that it has earned, and carries the fraction as a deficit to the
next window; the window's last few places go to the largest deficits. At the end of the
round every deficit is zero, so all rounds of a phase are the same and the driver works out one.
A phase ends when a queue has less than a quantum left; the rest is then shared anew.

The state of the round robin before any token is thus a formula of the token's place in its
queue: tasks need no word from each other to go on with the right deficits. The place of a
document in its queue is a prefix sum of two levels: the tokens of its queue earlier in its own
task, and those of earlier tasks (one row per task and queue).
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.llm.common import arrow_strings, map_batches, null_last_key, table
from daybook.llm.tokens import word_ids
from daybook.session import materialize

WINDOW = 2048
ROUND = 32
END_ID = 1
MAX_QUEUES = 4096
TOKENIZER = "byte_bpe_50k.json"
SLICE = 500


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _whole_shares(weights: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers in proportion to ``weights`` that add up to ``total``, largest remainders first."""
    exact = weights / weights.sum() * total
    out = np.floor(exact).astype(np.int64)
    order = np.argsort(out - exact, kind="stable")
    out[order[: total - int(out.sum())]] += 1
    return out


def _round_robin(quantum: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Tokens by window and queue of one round: earned whole tokens, then the largest deficits."""
    total, reached = int(quantum.sum()), 0
    served = np.zeros(len(quantum), dtype=np.int64)
    out = np.zeros((len(lengths), len(quantum)), dtype=np.int64)
    for r, length in enumerate(lengths):
        reached += length
        earned = quantum * (reached / total) if reached < total else quantum.astype(float)
        give = np.clip(np.floor(earned + 1e-9).astype(np.int64) - served, 0, quantum - served)
        while (short := length - int(give.sum())) != 0:
            deficit = earned - served - give
            if short > 0:
                able = np.flatnonzero(served + give < quantum)
                give[able[np.argsort(-deficit[able], kind="stable")[:short]]] += 1
            else:
                able = np.flatnonzero(give > 0)
                give[able[np.argsort(deficit[able], kind="stable")[:-short]]] -= 1
        out[r] = give
        served += give
    return out


class Schedule:
    """Where each token of each queue goes: sequence and offset."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = WINDOW):
        self.window = window
        left, phases, first = np.array(totals, dtype=np.int64), [], 0
        while (total := int(left.sum())) > 0:
            want = np.where(left > 0, left if weights is None else np.maximum(weights, 1e-12), 0).astype(float)
            if total <= window * ROUND:
                lengths = [window] * (total // window) + [total % window] * (total % window > 0)
                quantum, rounds = left.copy(), 1
            else:
                lengths = [window] * ROUND
                quantum = _whole_shares(want, window * ROUND)
                while (over := quantum > left).any():
                    # What a queue cannot give is shared by those that can.
                    lack = int((quantum - left)[over].sum())
                    quantum = np.minimum(quantum, left)
                    able = np.where(quantum < left, np.maximum(want, 1e-12), 0)
                    quantum = quantum + _whole_shares(able, lack)
                rounds = int((left[quantum > 0] // quantum[quantum > 0]).min())
            grid = _round_robin(quantum, lengths)
            phases.append((first, rounds, len(lengths), left.copy(), quantum, grid))
            first += rounds * len(lengths)
            left = left - quantum * rounds
        self.sequences = first
        # By queue: where its phases start, and for each its window numbers, quantum, and the
        # tokens of the queue before each window of a round with their offset there.
        self.queues = []
        for q, n in enumerate(totals):
            starts, rows = [], []
            for head, rounds, size, had, quantum, grid in phases:
                if quantum[q] == 0:
                    continue
                starts.append(int(n - had[q]))
                before = np.concatenate([[0], np.cumsum(grid[:, q])]).tolist()
                offset = np.cumsum(grid, axis=1)[:, q] - grid[:, q]
                rows.append((head, size, int(quantum[q]), before, offset.tolist()))
            self.queues.append((starts, rows))

    def pieces(self, q: int, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(place in the document, length, sequence, offset) of tokens [start, start + length) of a queue."""
        starts, rows = self.queues[q]
        at, end = start, start + length
        while at < end:
            k = bisect_right(starts, at) - 1
            head, size, quantum, before, offset = rows[k]
            turn, rest = divmod(at - starts[k], quantum)
            w = bisect_right(before, rest) - 1
            n = min(before[w + 1] - rest, end - at)
            yield at - start, n, head + turn * size + w, offset[w] + rest - before[w]
            at += n


def _tokenised(docs: DataFrame, keep: list[str], path: str, end_id: int, text_column: str, source_column: str) -> DataFrame:
    """Written rows: the ``keep`` columns, queue, ids, and the queue's tokens earlier in the same task."""
    queue = null_last_key(source_column)
    if docs.select(queue).distinct().limit(MAX_QUEUES + 1).count() > MAX_QUEUES:
        queue = F.pmod(F.xxhash64(queue), F.lit(MAX_QUEUES)).cast("string")  # sources share queues
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, words = TaskContext.get().partitionId(), defaultdict(int), word_ids(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                ids = [x + end for x in words.encode(arrow_strings(b.column(n + 1)))]
                queues, starts = b.column(n).to_pylist(), []
                for q, x in zip(queues, ids, strict=True):
                    starts.append(before[q])
                    before[q] += len(x) // 4
                slim = [np.frombuffer(x, dtype="<u4") for x in ids]
                ids = [x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes() for x in slim]
                own = [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(x) for x in slim], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], *own], names)

    names = [*[f"k{i}" for i in range(n)], "queue", "part", "before", "n_ids", "ids"]
    chosen = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], queue.alias("queue"), F.col(f"`{text_column}`").alias("text"))
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    out = map_batches(chosen, run, ", ".join([*schema, "part int, before bigint, n_ids bigint, ids binary"]), tokenises=True)
    return materialize(out, "tokens")


def pack(
    docs: DataFrame,
    path: str | None = None,
    weights: dict[str | None, float] | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    keep: tuple[str, ...] = ("doc_id",),
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row a piece: the ``keep`` columns, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    * Every id is in exactly one piece; only the last sequence can be short of ``window``.
    * Without ``weights`` every window has each source in its share of all tokens. With weights
      by source (null allowed; 1 if not named) windows have those shares for as long as a source lasts.
    * Null and empty texts are the end id alone. Repeated rows are packed as often as they come.
    * Above ``MAX_QUEUES`` sources share that many queues by hash; weights then do not apply.
    * An empty table gives no piece. Columns other than ``keep`` are left out, whatever their names.
    """
    path = path or tokenizer_path(TOKENIZER)
    n = len(keep)
    rows = _tokenised(docs, list(keep), path, end_id, text_column, source_column)
    sums = rows.groupBy("queue", "part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(sums.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "bases")
    totals = sorted(tuple(r) for r in base.groupBy("queue").agg(F.sum("n")).collect())  # MAX_QUEUES rows at most
    place = {q: i for i, (q, _) in enumerate(totals)}
    of = None
    if weights is not None:
        named = {("1" if k is None else f"0{k}"): float(v) for k, v in weights.items()}
        of = [named.get(q, 1.0) for q, _ in totals]
    schedule = Schedule([t for _, t in totals], of, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                queue, first, count, ids = (b.column(n + i).to_pylist() for i in range(4))
                index, parts = [], []
                for k in range(b.num_rows):
                    raw = np.frombuffer(ids[k], dtype="<u2" if len(ids[k]) == 2 * count[k] else "<u4").astype("<u4").tobytes()
                    for at, size, sequence, offset in schedule.pieces(place[queue[k]], first[k], count[k]):
                        piece = raw[4 * at : 4 * (at + size)]
                        index.append(k)
                        parts.append((at, size, zlib.crc32(piece), count[k], sequence, offset, piece))
                columns = list(zip(*parts, strict=True)) or [()] * 7
                kept = [b.column(i).take(pa.array(index, pa.int64())) for i in range(n)]
                made = [pa.array(c, pa.int64()) for c in columns[:6]]
                yield pa.RecordBatch.from_arrays([*kept, *made, pa.array(columns[6], pa.binary())], names)

    made = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    names = [*[f"k{i}" for i in range(n)], *made, "ids"]
    ready = rows.join(base.select("queue", "part", "base"), ["queue", "part"])
    ready = ready.select(*[f"k{i}" for i in range(n)], "queue", (F.col("base") + F.col("before")).alias("first"), "n_ids", "ids")
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in ready.schema.fields[:n]]
    out = map_batches(ready, run, ", ".join([*schema, *[f"`{c}` bigint" for c in made], "ids binary"]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *made, "ids")


def op4_pack_mixture(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048; see ``pack``."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")
