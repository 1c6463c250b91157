"""Approximate nearest neighbours by inner product: lists, and an adaptive scan over dimensions.

Inner products become distances by one more component that brings every row to the same length
(queries have zero there), so the largest product is the smallest distance. Rows belong to the
list of their nearest centre; a query probes the lists whose centres are nearest. Vectors are
turned by a random rotation, after which a few of their components tell about all of them: a
distance over the first d of D components, times D/d, estimates the whole. Within the probed
lists a query first measures its nearest list, which gives a bound on the k-th distance; other
candidates are measured a column block at a time and abandoned as soon as the estimate exceeds
the bound by more than the test allows, (1 + e / sqrt(d)) on the distance. Those that
last to the end get their exact product on the original vectors.

Centres are fitted on at most ``FIT_ROWS`` rows; all rows are in the lists. Small lists share
a tile, a large list is cut into several, so a crowded list is no single task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import map_batches, ship, table
from daybook.llm.vectors import best, matrix, valid_vectors
from daybook.session import materialize

TOP = 20
FIT_ROWS = 16_384
MAX_LISTS = 1_024
TURNS = 8
PROBED = 0.6
MORE_LISTS = 3  # beyond that share: a few lists are coarse
EPSILON = 2.1
COLUMNS = 16
TILE_ROWS = 8_192
TILE_QUERIES = 2_048
SEED = 20240229


def _lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """One more component, that makes the squared length of every row ``longest``."""
    rest = np.sqrt(np.maximum(0.0, longest - (x * x).sum(1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def _queries(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1)


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances less the squared length of x, which does not change an order."""
    return (centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)


def fit_centres(x: np.ndarray, lists: int) -> np.ndarray:
    """k-means from rows spread over the sample; a centre that loses its rows stays where it is."""
    centres = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(TURNS):
        own = _squared(x, centres).argmin(1)
        count = np.bincount(own, minlength=lists)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[count > 0] = total[count > 0] / count[count > 0][:, None]
    return centres


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scan(rotated: np.ndarray, query: np.ndarray, near: np.ndarray, others: np.ndarray, k: int, epsilon: float) -> np.ndarray:
    """Candidates that the tests leave: of ``near``, measured in full, and of ``others``, column block by block."""
    dim = len(query)
    bound, whole = np.inf, near
    if len(near) < k:  # too few for a bound: measure more in full
        whole, others = np.concatenate([near, others[: k - len(near)]]), others[k - len(near) :]
    if len(whole) >= k:
        gap = rotated[whole] - query
        distance = (gap * gap).sum(1)
        bound = np.partition(distance, k - 1)[k - 1]
        # Equal distances can differ in their last digits; exact products decide among them.
        whole = whole[distance <= bound * (1 + 1e-9) + 1e-12]
    part = np.zeros(len(others))
    for lo in range(0, dim, COLUMNS):
        hi = min(dim, lo + COLUMNS)
        gap = rotated[others, lo:hi] - query[lo:hi]
        part += (gap * gap).sum(1)
        allowed = (1 + (epsilon / np.sqrt(hi) if hi < dim else 1e-9)) ** 2
        keep = part * (dim / hi) <= bound * allowed + 1e-12
        others, part = others[keep], part[keep]
    return np.concatenate([whole, others])


def _tile(group: pa.Table, k: int, longest: float, epsilon: float) -> pa.Table:
    is_query = group.column("is_query").to_numpy(zero_copy_only=False)
    row, vec_id = group.column("row").to_numpy(), group.column("vec_id").to_numpy()
    found = {"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []}
    if is_query.any() and not is_query.all():
        held = np.flatnonzero(~is_query)
        lists = group.column("lists")
        own = np.array([lists[int(i)].as_py()[0] for i in held])
        order = np.argsort(own, kind="stable")
        held, own = held[order], own[order]
        x = matrix(group.column("vec"))
        original = x[held]
        turn = rotation(x.shape[1] + 1)
        rotated = _lengthened(original, longest) @ turn
        start = {int(c): (int(a), int(b)) for c, a, b in zip(*_runs(own), strict=True)}
        for q in np.flatnonzero(is_query).tolist():
            spans = [np.arange(*start[c]) for c in lists[q].as_py() if c in start]
            if not spans:
                continue
            others = np.concatenate([*spans[1:], np.zeros(0, dtype=int)])
            near, others = (s[row[held[s]] != row[q]] for s in (spans[0], others))
            left = scan(rotated, (_queries(x[q : q + 1]) @ turn)[0], near, others, k, epsilon)
            score = (original[left] * x[q]).sum(1)
            first = np.lexsort((row[held[left]], vec_id[held[left]], -score))[:k]
            left = held[left[first]]
            found["query_row"].append(np.full(len(left), row[q]))
            found["query_id"].append(np.full(len(left), vec_id[q]))
            found["row"].append(row[left])
            found["vec_id"].append(vec_id[left])
            found["score"].append(score[first])
    join = lambda c: np.concatenate(found[c]) if found[c] else np.zeros(0)
    return pa.table({c: pa.array(join(c), pa.float64() if c == "score" else pa.int64()) for c in found})


def _runs(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, start and end of each run of equal values."""
    cut = np.flatnonzero(np.diff(own)) + 1
    start = np.concatenate([[0], cut])
    return own[start], start, np.concatenate([cut, [len(own)]])


def _probes(df: DataFrame, centres: np.ndarray, probes: int, longest: float | None) -> DataFrame:
    """``lists`` of each row: the nearest centres, nearest first; ``longest`` is None for queries."""

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            x = matrix(b.column(b.schema.get_field_index("vec")))
            x = _queries(x) if longest is None else _lengthened(x, longest)
            near = np.argsort(_squared(x, centres), axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * probes, pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "lists"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_batches(df, run, f"{fields}, lists array<int>")


def _search(rows: DataFrame, queries: Column, k: int, probed: float, epsilon: float) -> DataFrame:
    """All rows of one length."""
    longest = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "row").limit(FIT_ROWS).select("vec").toArrow()
    lists = int(min(MAX_LISTS, max(1, round(n**0.5 / 2)), len(sample)))
    centres = fit_centres(_lengthened(matrix(sample.column("vec")), longest), lists)
    probes = min(lists, int(np.ceil(probed * lists)) + MORE_LISTS)
    held = materialize(_probes(rows, centres, 1, longest), "lists")
    sizes = dict(held.groupBy(F.col("lists")[0].alias("list")).count().collect())  # MAX_LISTS rows at most
    tile, chunks, filled = {}, {}, 0
    for c in range(lists):  # neighbouring lists fill a tile together
        size = sizes.get(c, 0)
        tile[c], chunks[c] = filled // TILE_ROWS, -(-size // TILE_ROWS)
        if size > TILE_ROWS:
            filled = -(-filled // TILE_ROWS) * TILE_ROWS
            tile[c] = filled // TILE_ROWS
            filled += TILE_ROWS
        else:
            filled += size
    by_tile = {}
    for c, t in tile.items():
        by_tile[t] = max(by_tile.get(t, 1), chunks[c])
    spark = rows.sparkSession
    of = F.array(*[F.lit(tile[c]) for c in range(lists)])
    cuts = F.array(*[F.lit(by_tile.get(t, 1)) for t in range(max(by_tile) + 1)])
    cut = lambda t: F.element_at(cuts, t + 1)
    home = F.element_at(of, F.col("lists")[0] + 1)
    held = held.withColumn("tile", home)
    held = held.withColumn("chunk", F.pmod(F.xxhash64("row"), cut(F.col("tile"))).cast("int"))
    asked = _probes(rows.filter(queries), centres, probes, None)
    asked = asked.withColumn("tile", F.explode(F.array_distinct(F.transform("lists", lambda c: F.element_at(of, c + 1)))))
    blocks = max(1, -(-rows.filter(queries).count() // TILE_QUERIES))
    asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), cut(F.col("tile")) - 1)))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(blocks)).cast("int"))
    held = held.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = held.withColumn("is_query", F.lit(False)).unionByName(asked.withColumn("is_query", F.lit(True)))
    ship(spark)
    schema = "query_row bigint, query_id bigint, row bigint, vec_id bigint, score double"
    return both.groupBy("tile", "chunk", "qb").applyInArrow(lambda t: _tile(t, k, longest, epsilon), schema)


def nearest(
    df: DataFrame, queries: Column, k: int = TOP, probed: float = PROBED, epsilon: float = EPSILON, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): about the ``k`` largest inner products of each query.

    ``queries`` is a condition on vec_id; ``probed`` the share of the lists that a query probes.
    Scores are exact, in double precision; ties among what is found go to the smaller vec_id. A
    query meets rows of its own length but not itself. Rows of equal id are separate rows.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows without id
    take no part. An empty table gives no rows; further columns do not matter.
    """
    rows = valid_vectors(df, id_column, vector_column, nonzero=True)
    lengths = sorted(r[0] for r in rows.select("dim").distinct().collect())
    if not lengths:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    found = None
    for d in lengths:
        part = _search(rows.filter(F.col("dim") == d), queries, k, probed, epsilon)
        found = part if found is None else found.unionByName(part)
    return best(found, k)


def op3_adaptive_neighbours(spark, sf_dir: str) -> DataFrame:
    """20 nearest of each vector whose id is divisible by 20; see ``nearest``."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
