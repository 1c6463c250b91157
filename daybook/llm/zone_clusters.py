"""k-means on whole numbers over zone maps in Hilbert order.

Vectors are put in the order of a Hilbert curve and cut into blocks. A block keeps its vectors
as one matrix and, as its zone map, the least and largest value of each dimension. The distances
from a centroid to the nearest and to the farthest point of that box bound its distance to
all vectors of the block: a centroid whose nearest point is farther than some other centroid's
farthest point is nobody's. What is left, the candidates, is compared with every vector exactly.

The curve runs through principal axes, worked out from sums over all vectors, because the first
axes of a curve decide most about who is near whom. A second box along these axes, which are at
right angles, bounds the same distances; the tighter bound counts. Blocks are written once
and read by each round; what a round sends back is sums by centroid, dimension and 32-bit limb, so
they are exact at any number of vectors and reach the driver as one row for each of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import map_batches, partitions, table
from daybook.llm.vectors import matrix, valid_vectors
from daybook.session import materialize

DIM = 64
SCALE = 64
CLUSTERS = 16
ROUNDS = 3
BLOCK_ROWS = 256
AXES = 16
BITS = 4
SMALL = 2.0**26  # components below it: squares and sums of up to 2**8 dimensions fit a long
LIMB = 32


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point on the Hilbert curve through whole numbers of ``bits`` bits an axis.

    The result has one row of bytes a point, which sorts as the place does.
    """
    n, axes = points.shape
    x = points.astype(np.int64).copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the turns of the cubes that a point lies in, from the largest down
        low = q - 1
        for i in range(axes):
            inside = (x[:, i] & q) != 0
            swap = np.where(inside, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(inside, x[:, 0] ^ low, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, axes):  # binary numbers to Gray code
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, dtype=np.int64)
    q = top
    while q > 1:
        flip = np.where((x[:, -1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip[:, None]
    digits = [(x[:, i] >> b) & 1 for b in range(bits - 1, -1, -1) for i in range(axes)]
    return np.packbits(np.stack(digits, axis=1).astype(np.uint8), axis=1)


def candidates(low: np.ndarray, high: np.ndarray, low_turned: np.ndarray, high_turned: np.ndarray, centroids: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector of the block with these boxes."""

    def bounds(lo, hi, c):
        near = np.maximum(0.0, np.maximum(lo - c, c - hi))
        far = np.maximum(np.abs(c - lo), np.abs(c - hi))
        return (near * near).sum(1), (far * far).sum(1)

    near, far = bounds(low, high, centroids)
    near_turned, far_turned = bounds(low_turned, high_turned, turned)
    near, far = np.maximum(near, near_turned), np.minimum(far, far_turned)
    # Bounds are in floating point: a margin keeps a centroid that rounding could let go.
    return np.flatnonzero(near <= far.min() * (1 + 1e-9) + 1e-6)


def nearest(values: np.ndarray, centroids: list[list[int]], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and exact squared distance of the nearest of the ``chosen`` centroids; ties to the smaller number."""
    some = [centroids[c] for c in chosen]
    small = np.abs(values).max(initial=0) < SMALL and all(abs(x) < SMALL for c in some for x in c)
    kind = np.int64 if small else object
    own = values.astype(np.int64) if small else np.array([[int(x) for x in v] for v in values], dtype=object).reshape(values.shape)
    best = place = None
    for k, c in zip(chosen.tolist(), some, strict=True):
        gap = own - np.array(c, dtype=kind)
        distance = (gap * gap).sum(1)
        if best is None:
            best, place = distance, np.full(len(values), k)
        else:
            closer = np.asarray(distance < best, dtype=bool)
            best, place = np.where(closer, distance, best), np.where(closer, k, place)
    return place, best


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(limb, part) with value = sum of part * 2**(32 * limb); only the last part can be negative."""
    limb = 0
    while not -(2**LIMB) < value < 2**LIMB:
        yield limb, value & (2**LIMB - 1)
        value >>= LIMB
        limb += 1
    yield limb, value


class ZoneBlocks:
    """The written blocks of a table of (vec_id, vec) and what a round asks of them."""

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS):
        """``rows`` hold whole numbers as doubles, all of one length and at least one row."""
        dim = len(rows.first().vec)
        self.axes, spread = self._principal(rows, dim)
        self.dim, self.spark = dim, rows.sparkSession
        self.blocks = self._write(rows, spread, block_rows)

    @staticmethod
    def _principal(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Principal axes as columns, widest first, and (least, largest) value along each."""

        def moments(batches):
            n, total, product = 0, np.zeros(dim), np.zeros((dim, dim))
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(0))
                    n, total, product = n + len(x), total + x.sum(0), product + x.T @ x
            flat = np.concatenate([[float(n)], total, product.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["at", "value"])

        sums = map_batches(rows.select("vec"), moments, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
        flat = np.array([r.value for r in sums.orderBy("at").collect()])  # 1 + dim + dim * dim numbers
        n, mean = flat[0], flat[1 : dim + 1] / flat[0]
        spread = flat[dim + 1 :].reshape(dim, dim) / n - np.outer(mean, mean)
        if not np.isfinite(spread).all():
            spread = np.eye(dim)
        axes = np.linalg.eigh((spread + spread.T) / 2)[1][:, ::-1].copy()

        def ends(batches):
            low, high = np.full(dim, np.inf), np.full(dim, -np.inf)
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(0)) @ axes
                    low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
            if np.isfinite(low).all():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(low), pa.array(high)], ["at", "low", "high"])

        found = map_batches(rows.select("vec"), ends, "at int, low double, high double")
        found = found.groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()
        return axes, np.array([[r.low, r.high] for r in found])

    def _write(self, rows: DataFrame, spread: np.ndarray, block_rows: int) -> DataFrame:
        axes, used = self.axes, min(AXES, self.dim)
        low = spread[:used, 0]
        step = np.maximum(spread[:used, 1] - low, 1e-9) / (1 << BITS)

        def keys(batches):
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column(1)) @ axes[:, :used]
                    place = np.clip(np.floor((x - low) / step), 0, (1 << BITS) - 1)
                    key = hilbert_key(place, BITS)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k.tobytes() for k in key], pa.binary())], ["vec_id", "vec", "key"])

        def blocks(batches):
            held_ids, held, n = [], [], 0
            for b in batches:
                if b.num_rows:
                    held_ids.append(b.column(0).to_numpy())
                    held.append(matrix(b.column(1)))
                    n += b.num_rows
                if n >= block_rows:
                    ids, x = np.concatenate(held_ids), np.concatenate(held)
                    full = n - n % block_rows
                    for lo in range(0, full, block_rows):
                        yield one(ids[lo : lo + block_rows], x[lo : lo + block_rows])
                    held_ids, held, n = [ids[full:]], [x[full:]], n - full
            if n:
                yield one(np.concatenate(held_ids), np.concatenate(held))

        def one(ids, x):
            turned = x @ axes
            boxes = [x.min(0), x.max(0), turned.min(0), turned.max(0)]
            cells = [ids.astype("<i8").tobytes(), x.astype("<f8").tobytes(), np.concatenate(boxes).astype("<f8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], ["n", "ids", "vectors", "boxes"])

        keyed = map_batches(rows.select("vec_id", "vec"), keys, "vec_id bigint, vec array<double>, key binary")
        # Many vectors can share a place on the curve: a hash of the id parts them.
        scatter = F.xxhash64("vec_id")
        dealt = keyed.withColumn("scatter", scatter).repartitionByRange(partitions(self.spark), "key", "scatter")
        dealt = dealt.sortWithinPartitions("key", "scatter").select("vec_id", "vec")
        return materialize(map_batches(dealt, blocks, "n int, ids binary, vectors binary, boxes binary"), "zone-blocks")

    def _assigned(self, centroids: list[list[int]]):
        """A function of a block row: its ids, vectors, centroid numbers and distances, and the number of candidates."""
        dim, axes = self.dim, self.axes
        as_float = np.array([[float(x) for x in c] for c in centroids])
        turned = as_float @ axes

        def run(ids: bytes, vectors: bytes, boxes: bytes):
            x = np.frombuffer(vectors, dtype="<f8").reshape(-1, dim)
            box = np.frombuffer(boxes, dtype="<f8").reshape(4, dim)
            chosen = candidates(*box, as_float, turned)
            return np.frombuffer(ids, dtype="<i8"), x, *nearest(x, centroids, chosen), len(chosen)

        return run

    def sums(self, centroids: list[list[int]]) -> tuple[list[int], list[list[int]], int]:
        """Of each centroid the number of its vectors and their componentwise sum; and compared pairs."""
        assigned, dim, k = self._assigned(centroids), self.dim, len(centroids)

        def run(batches):
            count, pairs = [0] * k, 0
            total = [[0] * dim for _ in range(k)]
            for b in batches:
                for ids, vectors, boxes in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                    _, x, place, _, looked = assigned(ids, vectors, boxes)
                    pairs += looked * len(x)
                    small = np.abs(x).max() < SMALL
                    for c in np.unique(place).tolist():
                        own = x[place == c]
                        part = own.astype(np.int64).sum(0).tolist() if small else [sum(map(int, v)) for v in own.T]
                        count[c] += len(own)
                        total[c] = [a + b for a, b in zip(total[c], part, strict=True)]
            rows = [(c, -1, limb, part) for c in range(k) for limb, part in _limbs(count[c])]
            rows += [(c, d, limb, part) for c in range(k) if count[c] for d in range(dim) for limb, part in _limbs(total[c][d])]
            rows += [(-1, -1, limb, part) for limb, part in _limbs(pairs)]
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["c", "d", "limb", "part"])

        made = map_batches(self.blocks.select("ids", "vectors", "boxes"), run, "c int, d int, limb int, part bigint")
        count, pairs = [0] * k, 0
        total = [[0] * dim for _ in range(k)]
        for r in made.groupBy("c", "d", "limb").agg(F.sum("part").alias("part")).collect():  # k * (dim + 1) numbers
            value = r.part << (LIMB * r.limb)
            if r.c < 0:
                pairs += value
            elif r.d < 0:
                count[r.c] += value
            else:
                total[r.c][r.d] += value
        return count, total, pairs

    def assign(self, centroids: list[list[int]]) -> DataFrame:
        """Written (vec_id, cluster, distance); a distance beyond a long is null."""
        assigned = self._assigned(centroids)

        def run(batches):
            for b in batches:
                for ids, vectors, boxes in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                    own, _, place, distance, _ = assigned(ids, vectors, boxes)
                    fits = pa.array([int(d) if d < 2**63 else None for d in distance.tolist()], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(place, pa.int32()), fits], ["vec_id", "cluster", "distance"])

        return materialize(map_batches(self.blocks.select("ids", "vectors", "boxes"), run, "vec_id bigint, cluster int, distance bigint"), "clusters")


def cluster(
    df: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: float = SCALE,
    block_rows: int = BLOCK_ROWS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each vector, and the centroids.

    Components become floor(scale * x). Centroids start as the vectors whose sha256 of
    ``1:<vec_id>`` is least (of rows of equal id the least vector first) and move ``rounds`` times to the floor of
    the mean of their vectors; a centroid without vectors stays. Ties go to the smaller number.
    Vectors that are null, of another length, or hold null or non-finite components (before or
    after scaling) and rows without id take no part. Rows of equal id are separate rows. With fewer vectors than ``clusters`` there
    are as many centroids as vectors. Distances are exact; one that does not fit a long is null.
    An empty table gives no row; further columns do not matter.
    """
    scaled = F.transform("vec", lambda x: x * F.lit(float(scale)))
    rows = valid_vectors(df, id_column, vector_column).filter(F.col("dim") == dim).withColumn("vec", scaled)
    rows = rows.filter(F.forall("vec", lambda x: F.abs(x) != float("inf"))).select("vec_id", "vec")
    first = rows.withColumn("hash", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    whole = lambda v: [int(np.floor(x)) for x in v]
    centroids = [whole(r.vec) for r in first.orderBy("hash", "vec").limit(clusters).collect()]
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    # floor() of Spark gives a long; a double keeps any whole number that it can hold.
    whole_double = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    blocks = ZoneBlocks(rows.withColumn("vec", F.transform("vec", whole_double)), block_rows)
    for _ in range(rounds):
        count, total, _ = blocks.sums(centroids)
        centroids = [[t // n for t in s] if n else c for c, n, s in zip(centroids, count, total, strict=True)]
    return blocks.assign(centroids), centroids


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of each vector; see ``cluster``. Sums beyond a long are null."""
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), F.count_if(F.col("distance").isNull()).alias("over"))
    per = per.collect()  # one row a centroid
    whole = lambda parts: sum(int(r["sum"]) for r in parts) if not any(r["over"] for r in parts) else 2**63
    fits = lambda x: x if x < 2**63 else None
    total = fits(whole(per))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    told = [(r["cluster"], fits(whole([r])), total, ",".join(map(str, centroids[r["cluster"]]))) for r in per]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, text string")
    told = told.select("cluster", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_ASSIGN = """
d{i} AS (
  SELECT v.vec_id, v.w, c.c, list_inner_product(v.w, v.w) - 2 * list_inner_product(v.w, c.w) + list_inner_product(c.w, c.w) AS d
  FROM v CROSS JOIN c{i} c),
a{i} AS (SELECT vec_id, w, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
_MOVE = """
u{i} AS (SELECT c, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM a{p}),
m{i} AS (SELECT c, list(y ORDER BY k) AS w FROM (SELECT c, k, floor(sum(x) / count(*)) AS y FROM u{i} GROUP BY c, k) GROUP BY c),
c{i} AS (SELECT c{p}.c, coalesce(m{i}.w, c{p}.w) AS w FROM c{p} LEFT JOIN m{i} USING (c))"""
_STEPS = ",".join([_ASSIGN.format(i=0), *[_MOVE.format(i=i, p=i - 1) + "," + _ASSIGN.format(i=i) for i in range(1, ROUNDS + 1)]])
OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT w, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, w FROM s),{_STEPS},
i AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a{ROUNDS}) AS inertia,
       sha256(array_to_string(list_transform(c{ROUNDS}.w, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN i USING (c) JOIN c{ROUNDS} USING (c)
"""
