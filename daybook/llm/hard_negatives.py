"""Hard negatives by inner product: length buckets with sorted coordinate lists.

Rows are ordered by length and cut into buckets; a bucket keeps its vectors, and for each
dimension the list of its rows in order of that component of their unit vectors. A search asks for
rows whose inner product with an anchor is at least some bound. With the longest row of a bucket the bound
becomes an angle: a bucket that would need a cosine above 1 is passed over, and otherwise the angle around
the anchor leaves each component a range of feasible values. The ranges of the anchor's focus
coordinates, its largest ones, are looked up in the sorted lists; rows found in all of them, and
whose product over these coordinates can still reach the bound with what is left of both lengths, are the candidates,
and only those are compared exactly.

Positives are searched first: the bound of an anchor is the score of its last positive so
far, which rises from the longest bucket on. The scores of the positives then bound the negatives.
Buckets and anchors meet in blocks of both; a pair of blocks returns a few rows an anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.llm.common import map_batches, ship, table
from daybook.llm.vectors import matrix, valid_vectors
from daybook.session import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOW, HIGH = 80, 100  # per cent of the positive's score
BUCKET_ROWS = 2_048
BUCKETS_A_TILE = 8
ANCHORS = 1_024
FOCUS = 4
EXACT = 2.0**52  # sums of products below it are exact in double precision
_NEVER = -(1 << 5000)  # below any score


def score_key(value: int) -> bytes:
    """Bytes that sort as whole numbers do, of any size."""
    size = max(1, (abs(value).bit_length() + 7) // 8)
    raw = size.to_bytes(2, "big") + abs(value).to_bytes(size, "big")
    return b"\1" + raw if value >= 0 else b"\0" + bytes(255 - x for x in raw)


def score_of(key: bytes) -> int:
    raw = key[1:] if key[0] else bytes(255 - x for x in key[1:])
    return int.from_bytes(raw[2:], "big") * (1 if key[0] else -1)


class Bucket:
    """Rows of about one length, with their coordinate lists."""

    def __init__(self, rows, ids, labels, vectors: np.ndarray, order: np.ndarray | None = None):
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, vectors
        self.lengths = _lengths(vectors)
        self.longest = float(self.lengths.max())
        self.units = vectors / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
        self.order = np.argsort(self.units, axis=0, kind="stable").T.astype(np.int32) if order is None else order
        self.own: dict[int, np.ndarray] = {}

    def sorted_list(self, d: int) -> np.ndarray:
        return self.units[self.order[d], d]

    def candidates(self, unit: np.ndarray, length: float, bound: int) -> np.ndarray | None:
        """Places of the rows that can reach ``bound``; None for all of them."""
        if bound <= 0 or length == 0 or bound >= 1 << 1000 or not np.isfinite(length) or not np.isfinite(self.longest):
            return None
        reach = float(bound) / length
        cosine = reach / self.longest * (1 - 1e-9) if self.longest > 0 else np.inf
        if cosine > 1:
            return np.zeros(0, dtype=np.int64)
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        angle, at = np.arccos(cosine), np.arccos(np.clip(unit[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, at + angle)) - 1e-9
        high = np.cos(np.maximum(0.0, at - angle)) + 1e-9
        hits = np.zeros(len(self.ids), dtype=np.int8)
        for d, lo, hi in zip(focus.tolist(), low, high, strict=True):
            values = self.sorted_list(d)
            hits[self.order[d, np.searchsorted(values, lo) : np.searchsorted(values, hi, "right")]] += 1
        found = np.flatnonzero(hits == len(focus))
        # What the other coordinates can add is bounded by what is left of both unit lengths.
        part = self.units[found][:, focus]
        rest = np.sqrt(np.maximum(0.0, 1 - (part * part).sum(1)) * max(0.0, 1 - float((unit[focus] ** 2).sum())))
        return found[(part @ unit[focus] + rest + 1e-9) * self.lengths[found] >= reach * (1 - 1e-9)]

    def of_label(self, label: int) -> np.ndarray:
        if label not in self.own:
            self.own[label] = np.flatnonzero(self.labels == label)
        return self.own[label]

    def scores(self, at: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
        """Exact inner products: long integers where they surely fit, whole numbers of any size elsewhere."""
        if length * self.longest < EXACT:
            return (self.vectors[at] @ query).astype(np.int64)
        whole = [int(x) for x in query]
        return np.array([sum(int(a) * b for a, b in zip(v, whole, strict=True)) for v in self.vectors[at]], dtype=object)


def _lengths(x: np.ndarray) -> np.ndarray:
    """Lengths that do not overflow where the vectors do not."""
    largest = np.abs(x).max(axis=1, initial=0)
    scale = np.where(largest > 0, largest, 1.0)
    return largest * np.sqrt(((x / scale[:, None]) ** 2).sum(1))


def _first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first by score, id and row."""
    if len(scores) > 4 * k and scores.dtype != object:  # ties at the k-th score stay in
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((rows[near], ids[near], -scores[near]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i], rows[i]))[:k], dtype=np.int64)


class _Best:
    """The ``k`` first rows found so far."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(scores):
            kind = object if object in (scores.dtype, self.scores.dtype) else np.int64
            joined = np.concatenate([self.scores.astype(kind), scores.astype(kind)])
            ids, rows = np.concatenate([self.ids, ids]), np.concatenate([self.rows, rows])
            at = _first(joined, ids, rows, self.k)
            self.scores, self.ids, self.rows = joined[at], ids[at], rows[at]

    def found(self):
        """(row, id, key, score) of each, the score null where it does not fit a long."""
        for r, i, s in zip(self.rows.tolist(), self.ids.tolist(), self.scores.tolist(), strict=True):
            yield r, i, score_key(s), s if -(2**63) <= s < 2**63 else None

    @property
    def bound(self) -> int:
        return int(self.scores[-1]) if len(self.ids) == self.k else _NEVER


def _buckets(held: pa.Table) -> list[Bucket]:
    """The buckets of a tile, longest first."""
    out = []
    for r in held.to_pylist():
        vectors = np.frombuffer(r["vectors"], dtype="<f8").reshape(r["n"], -1)
        own = [np.frombuffer(r[c], dtype="<i8") for c in ("rows", "ids", "labels")]
        out.append(Bucket(*own, vectors, np.frombuffer(r["lists"], dtype="<i4").reshape(vectors.shape[1], r["n"])))
    return sorted(out, key=lambda b: -b.longest)


def _anchors(asked: pa.Table):
    """(row, vec_id, label, vector, unit vector, length) of each anchor."""
    if asked.num_rows:
        x = matrix(asked.column("vec"))
        lengths = _lengths(x)
        units = x / np.where(lengths > 0, lengths, 1.0)[:, None]
        own = [asked.column(c).to_pylist() for c in ("row", "vec_id", "label")]
        yield from zip(*own, x, units, lengths.tolist(), strict=True)


def _result(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_FOUND = [("row", pa.int64()), ("id", pa.int64()), ("key", pa.binary()), ("score", pa.int64())]
POSITIVE_FIELDS = pa.schema([("anchor_row", pa.int64()), *_FOUND])
NEGATIVE_FIELDS = pa.schema([("anchor_row", pa.int64()), ("anchor_id", pa.int64()), *[(f"positive_{c}", t) for c, t in _FOUND], *_FOUND])


def _find_positives(held: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of each anchor's label in the tile."""
    buckets, out = _buckets(held), []
    for row, _, label, vector, unit, length in _anchors(asked):
        best = _Best(k)
        for b in buckets:
            some, own = b.candidates(unit, length, best.bound), b.of_label(label)
            some = own if some is None else some[b.labels[some] == label]
            some = some[b.rows[some] != row]
            best.add(b.scores(some, vector, length), b.ids[some], b.rows[some])
        out += [(row, *x) for x in best.found()]
    return _result(out, POSITIVE_FIELDS)


def _find_negatives(held: pa.Table, asked: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """For each anchor and positive the first ``k`` rows of other labels in the tile, in the band of scores."""
    buckets, out = _buckets(held), []
    found = asked.column("found").to_pylist()
    for (row, vec_id, label, vector, unit, length), positives in zip(_anchors(asked), found, strict=True):
        # The band of a negative score is empty as long as ``low`` is below ``high``.
        wanted = [(p, -(-low * score_of(p["key"]) // 100), high * score_of(p["key"]) // 100) for p in positives]
        wanted = [(p, lo, hi, _Best(k)) for p, lo, hi in wanted if lo <= hi]
        for b in buckets if wanted else []:
            some = b.candidates(unit, length, min(lo for _, lo, _, _ in wanted))
            some = np.flatnonzero(b.labels != label) if some is None else some[b.labels[some] != label]
            scores = b.scores(some, vector, length)
            for _, lo, hi, best in wanted:
                fits = np.asarray((scores >= max(lo, best.bound)) & (scores <= hi), dtype=bool)
                best.add(scores[fits], b.ids[some[fits]], b.rows[some[fits]])
        for p, _, _, best in wanted:
            out += [(row, vec_id, p["row"], p["id"], p["key"], p["score"], *x) for x in best.found()]
    return _result(out, NEGATIVE_FIELDS)


def length_buckets(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Written buckets (tile, dim, n, rows, ids, labels, vectors, lists) of (row, vec_id, label, vec, dim)."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), {}
        names = ["tile", "dim", "n", "rows", "ids", "labels", "vectors", "lists"]

        def full(dim, least):
            held, count = made[dim][:2]
            while count >= least:
                table_ = pa.concat_tables(held)
                some, rest = table_.slice(0, bucket_rows), table_.slice(bucket_rows)
                own = [some.column(c).to_numpy() for c in ("row", "vec_id", "label")]
                b = Bucket(*own, matrix(some.column("vec")))
                tile = f"{part}:{dim}:{made[dim][2] // BUCKETS_A_TILE}"
                cells = [*[x.astype("<i8") for x in own], b.vectors.astype("<f8"), b.order.astype("<i4")]
                yield pa.RecordBatch.from_arrays([pa.array([tile]), *[pa.array([v], pa.int32()) for v in (dim, len(b.ids))], *[pa.array([c.tobytes()], pa.binary()) for c in cells]], names)
                made[dim][2] += 1
                held, count = [rest], rest.num_rows
            made[dim][:2] = [held, count]

        for batch in batches:
            whole = pa.Table.from_batches([batch])
            for dim in set(batch.column(4).to_pylist()):
                some = whole.filter(pa.compute.equal(whole.column("dim"), dim))
                made.setdefault(dim, [[], 0, 0])
                made[dim][0].append(some)
                made[dim][1] += some.num_rows
                yield from full(dim, bucket_rows)
        for dim in made:
            yield from full(dim, 1)

    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    tiles = -(-rows.count() // (bucket_rows * BUCKETS_A_TILE))
    # Rows of one vector are of one length: a hash of the row parts them.
    dealt = rows.withColumn("length", length).withColumn("scatter", F.xxhash64("row"))
    order = [F.desc("length"), F.col("scatter")]
    dealt = dealt.repartitionByRange(max(1, tiles), *order).sortWithinPartitions(*order)
    schema = "tile string, dim int, n int, rows binary, ids binary, labels binary, vectors binary, lists binary"
    return materialize(map_batches(dealt.select("row", "vec_id", "label", "vec", "dim"), run, schema), "length-buckets")


def hard_negatives(
    df: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: float = SCALE,
    label: Column | None = None,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    ``anchors`` is a condition on vec_id. Components become floor(scale * x) and a score is an
    inner product of those. Positives of an anchor are its first other rows of the same label,
    negatives the first rows of another label with a score of ``low`` to ``high`` per cent of
    the positive's; first are high scores, then small ids. Vectors meet those of their own length (number of components).
    Rows with a null label (column ``label`` unless given), id or vector, with an empty vector or null or
    non-finite components (before or after scaling) take no part. Rows of equal id are separate
    rows and separate anchors. Scores are exact at any size; one that does not fit a long is shown as null. An
    empty table gives no row; further columns do not matter.
    """
    spark = df.sparkSession
    ship(spark)
    label = F.col("label") if label is None else label
    rows = valid_vectors(df, id_column, vector_column, label=label)
    scaled = rows.withColumn("vec", F.transform("vec", lambda x: x * F.lit(float(scale))))
    whole = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)
    rows = scaled.filter(F.forall("vec", lambda x: F.abs(x) != float("inf"))).withColumn("vec", F.transform("vec", whole))
    buckets = length_buckets(rows, bucket_rows)
    asked = rows.filter(anchors).select("row", "vec_id", "label", "vec", "dim")
    blocks = max(1, -(-asked.count() // ANCHORS))
    # A name for each BUCKET_ROWS * BUCKETS_A_TILE vectors.
    tiles = F.broadcast(buckets.groupBy("dim").agg(F.collect_set("tile").alias("tiles")))

    def met(anchor_rows: DataFrame, function, schema: str) -> DataFrame:
        held = buckets.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        turned = anchor_rows.join(tiles, "dim").withColumn("tile", F.explode("tiles")).drop("tiles")
        turned = turned.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
        return held.groupBy("tile", "qb").cogroup(turned.groupBy("tile", "qb")).applyInArrow(function, schema)

    first = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("key"), "id", "row"))
    found = met(asked, lambda a, b: _find_positives(a, b, positives), "anchor_row bigint, row bigint, id bigint, key binary, score bigint")
    found = found.withColumn("rank", first("anchor_row")).filter(F.col("rank") <= positives)
    found = found.groupBy("anchor_row").agg(F.collect_list(F.struct("row", "id", "key", "score")).alias("found"))
    paired = materialize(asked.join(found, asked["row"] == found["anchor_row"]).drop("anchor_row"), "positives")
    schema = "anchor_row bigint, anchor_id bigint, positive_row bigint, positive_id bigint, positive_key binary, positive_score bigint"
    schema += ", row bigint, id bigint, key binary, score bigint"
    out = met(paired, lambda a, b: _find_negatives(a, b, negatives, low, high), schema)
    out = out.withColumn("rank", first("anchor_row", "positive_row")).filter(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of each vector whose id is divisible by 100; see ``hard_negatives``."""
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=changed)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, list_inner_product(a.w, c.w)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
