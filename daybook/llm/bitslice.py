"""Exact top-k inner products over a bit-sliced index.

Components become whole numbers. Rows come in blocks, and a block keeps, for each dimension and
each binary digit, a bitmap over its rows (a slice). The score of all rows of a block with one
query is a sum of slices: a query component's set digits say at which weights a dimension's
slices count, a negative component takes the complemented slices. Carry-save adders on
whole bitmaps add them up, three bitmaps of a weight giving one of that weight and one of the next.
What is left is the score itself, one slice a digit. The best rows are then found from
the most significant slice down, keeping the rows surely in and those still tied; ties at
the end are the rows with equal scores at the boundary, of which the smallest ids are taken.

Queries are a stated set against all rows, in blocks of both; a block pair is one group and
returns ``k`` rows a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import ship, table
from daybook.llm.vectors import best, matrix, valid_vectors

SCALE = 64
TOP = 20
ROWS = 16_384
QUERIES = 1_024
LARGEST = 2**28


class BitSlicedBlock:
    """Slices of a block of whole-number vectors; row i is bit i."""

    def __init__(self, values: np.ndarray):
        self.n, self.dim = values.shape
        reach = int(max(values.max(initial=0), -(values.min(initial=0) + 1), 1))
        self.digits = reach.bit_length() + 1
        self.shift = 1 << (self.digits - 1)
        stored = (values + self.shift).astype(np.uint64)  # never negative
        words = -(-self.n // 64)
        self.slices = np.zeros((2, self.dim, self.digits, words), dtype=np.uint64)
        self.all = self._bitmap(np.ones((self.n, 1), dtype=bool), words)[0]
        for d in range(self.digits):
            self.slices[0, :, d] = self._bitmap((stored >> np.uint64(d)) & np.uint64(1) != 0, words)
        self.slices[1] = ~self.slices[0]

    @staticmethod
    def _bitmap(bits: np.ndarray, words: int) -> np.ndarray:
        padded = np.zeros((bits.shape[1], words * 64), dtype=bool)
        padded[:, : bits.shape[0]] = bits.T
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices of a sum, a constant): the inner product of each row is the sum plus the constant."""
        sign = (query < 0).astype(int)
        size = np.abs(query)
        top = (1 << self.digits) - 1
        # A complemented component is top - (x + shift), so the constant takes both back out.
        constant = int(sum(-int(m) * self.shift if not s else int(m) * (self.shift - top) for m, s in zip(size, sign, strict=True)))
        longest = int(size.max(initial=0)).bit_length()
        out, carried, weight = [], None, 0
        while weight < longest + self.digits or (carried is not None and len(carried)):
            stack = [] if carried is None else [carried]
            for d in range(self.digits):
                if 0 <= weight - d < longest:
                    dims = np.flatnonzero((size >> (weight - d)) & 1)
                    if len(dims):
                        stack.append(self.slices[sign[dims], dims, d])
            have = np.concatenate(stack) if stack else np.zeros((0, len(self.all)), dtype=np.uint64)
            carries = []
            while len(have) > 1:
                three = len(have) // 3
                if three:
                    a, b, c = have[:three], have[three : 2 * three], have[2 * three : 3 * three]
                    half = a ^ b
                    carries.append((a & b) | (half & c))
                    have = np.concatenate([half ^ c, have[3 * three :]])
                else:
                    carries.append(have[:1] & have[1:])
                    have = have[:1] ^ have[1:]
            out.append(have[0] if len(have) else np.zeros_like(self.all))
            carried = np.concatenate(carries) if carries else None
            weight += 1
        return out, constant

    def top(self, query: np.ndarray, k: int, without: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` highest scores, row ``without`` left out, ties to smaller rows."""
        slices, constant = self.scores(query)
        tied = self.all.copy()
        if without is not None:
            tied[without >> 6] &= ~np.uint64(1 << (without & 63))
        sure, n_sure = np.zeros_like(tied), 0
        if int(np.bitwise_count(tied).sum()) > k:
            for s in reversed(slices):
                with_bit = tied & s
                n = n_sure + int(np.bitwise_count(with_bit).sum())
                if n > k:
                    tied = with_bit
                else:
                    sure, n_sure, tied = sure | with_bit, n, tied & ~s
                    if n == k:
                        tied = np.zeros_like(tied)
                        break
        rows = np.concatenate([self._rows(sure), self._rows(tied)[: max(0, k - n_sure)]])
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        score = np.full(len(rows), constant, dtype=np.int64)
        for w, s in enumerate(slices):
            score += ((s[word] >> bit) & np.uint64(1)).astype(np.int64) << w
        return rows, score

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        filled = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[filled].view(np.uint8).reshape(len(filled), 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return filled[at] * 64 + bit


def _pair(group: pa.Table, k: int, scale: float) -> pa.Table:
    """The best of a block of rows for each query of a block."""
    is_query = group.column("is_query").to_numpy(zero_copy_only=False)
    row, vec_id = group.column("row").to_numpy(), group.column("vec_id").to_numpy()
    found = {"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []}
    if not is_query.all() and is_query.any():
        values = np.floor(matrix(group.column("vec")) * scale).astype(np.int64)
        held = np.flatnonzero(~is_query)
        held = held[np.lexsort((row[held], vec_id[held]))]
        block = BitSlicedBlock(values[held])
        place = {r: i for i, r in enumerate(row[held].tolist())}
        for q in np.flatnonzero(is_query).tolist():
            rows, score = block.top(values[q], k, place.get(int(row[q])))
            found["query_row"].append(np.full(len(rows), row[q]))
            found["query_id"].append(np.full(len(rows), vec_id[q]))
            found["row"].append(row[held[rows]])
            found["vec_id"].append(vec_id[held[rows]])
            found["score"].append(score)
    return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for c, x in found.items()})


def top_products(
    df: DataFrame, queries: Column, k: int = TOP, scale: float = SCALE, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of floor(scale * x).

    ``queries`` is a condition on vec_id. A query meets every row but its own, of the same length;
    ties go to the smaller vec_id. Fewer than ``k`` other rows are all returned. Rows of equal id
    are separate rows, and separate queries. Vectors that are null or empty, hold null or
    non-finite components, or a component beyond 2**28 after scaling (scores would not fit a
    long), and rows without id take no part. An empty table gives no rows; further columns do not matter.
    """
    rows = valid_vectors(df, id_column, vector_column).filter(F.forall("vec", lambda x: F.abs(x * scale) < LARGEST))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(queries, 1))).first()
    row_blocks, query_blocks = max(1, -(-n // ROWS)), max(1, -(-n_queries // QUERIES))
    block = lambda blocks, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    held = rows.select("row", "vec_id", "vec", "dim", F.lit(False).alias("is_query"), block(row_blocks, 1).alias("rb"), each(query_blocks).alias("qb"))
    asked = rows.filter(queries).select("row", "vec_id", "vec", "dim", F.lit(True).alias("is_query"), each(row_blocks).alias("rb"), block(query_blocks, 2).alias("qb"))
    ship(df.sparkSession)
    schema = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint"
    found = held.unionByName(asked).groupBy("dim", "rb", "qb").applyInArrow(lambda t: _pair(t, k, scale), schema)
    return best(found, k)


def op8_bitsliced_topk(spark, sf_dir: str) -> DataFrame:
    """20 highest integer scores of each vector whose id is divisible by 20; see ``top_products``."""
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
