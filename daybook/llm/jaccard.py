"""Documents whose sets of word n-grams are alike: MinHash banding, then exact comparison.

1. Rows of equal n-gram sets form a class (128-bit fingerprint of the sorted set); from here on
   a class stands for its copies, so copies are never paired.
2. Classes meet in the buckets of their bands. A bucket is only told its smallest member, and
   members point at it: one row a member, however large the bucket is.
3. The components of these pointers hold every candidate pair. They are cut into tiles of
   blocks of ``BLOCK`` classes; a tile compares two blocks. Pairs that share a band are verified
   on their full n-gram sets there, and each class leaves the tile with its number of links and
   one pointer to another class that it is linked to, never with a row a pair.
4. Components of the verified pointers are the clusters.

Bands and rows a band are chosen for a target recall at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import map_batches, partitions, release, ship, table
from daybook.llm.words import chunks, hash_words, mix64
from daybook.session import materialize

SIMILARITY = 0.8
WORDS = 5
RECALL = 0.99999
BLOCK = 256
COLUMNS = 8192
FOLDED = 3


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, stray: float = 0.5) -> tuple[int, int]:
    """(bands, rows a band): the fewest hashes that find a pair at ``similarity`` with probability
    ``recall`` and a pair at half of it with ``stray`` at most."""
    best = None
    for rows in range(1, 17):
        hit = similarity**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if 1 - (1 - (similarity / 2) ** rows) ** bands <= stray and (best is None or bands * rows < best[0] * best[1]):
            best = (bands, rows)
    return best


def ngram_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct n-grams of each text.

    A text of fewer than ``n`` words has one n-gram, all of its words; an empty one has none.
    """
    words, bounds = hash_words(texts)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), count)
    weight = mix64(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for k in range(n):
        grams += words[k : k + len(grams)] * weight[k]
    whole = owner[: len(grams)] == owner[n - 1 :] if len(grams) else np.zeros(0, bool)
    owner_of = owner[: len(grams)][whole]
    grams = mix64(grams[whole])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = [int((words[bounds[i] : bounds[i + 1]] * weight[: count[i]]).sum()) ^ int(count[i]) for i in short]
        grams = np.concatenate([grams, mix64(np.array(own, dtype=np.uint64))])
        owner_of = np.concatenate([owner_of, short])
    order = np.lexsort((grams, owner_of))
    grams, owner_of = grams[order], owner_of[order]
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner_of[1:] != owner_of[:-1])
    grams, owner_of = grams[fresh], owner_of[fresh]
    return grams, np.searchsorted(owner_of, np.arange(len(texts) + 1))


def _per_text(function, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """reduceat over the non-empty ranges."""
    out = np.full(len(bounds) - 1, empty, dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = function.reduceat(values, bounds[full])
    return out


def signatures(grams: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket name for each text and band."""
    seeds = mix64(np.arange(1000, 1000 + bands * rows, dtype=np.uint64)) | np.uint64(1)
    out = np.zeros((len(bounds) - 1, bands), dtype=np.uint64)
    for b in range(bands):
        name = np.full(len(bounds) - 1, b + 1, dtype=np.uint64)
        for r in range(rows):
            low = _per_text(np.minimum, (grams * seeds[b * rows + r]) >> np.uint64(20), bounds, 0)
            name = mix64(name * np.uint64(0x2545F4914F6CDD1D) + low)
        out[:, b] = name
    return out


def _bytes(column) -> list[bytes]:
    return [b"" if x is None else x.encode("utf-8", "replace") for x in column.to_pylist()]


def _prints(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, through unlike hashes."""
    one = _per_text(np.add, mix64(grams + np.uint64(0x51)), bounds, 0)
    two = _per_text(np.add, mix64(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds, 0)
    return one.view(np.int64), two.view(np.int64)


def _signed(docs: DataFrame, n: int, bands: int, rows: int, id_column: str, text_column: str, row_column: str | None) -> DataFrame:
    """Written rows (row, id, n_grams, print1, print2, names): ``row`` numbers the rows of the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = _bytes(b.column(1))
            for lo, hi in chunks(texts):
                grams, bounds = ngram_sets(texts[lo:hi], n)
                names = signatures(grams, bounds, bands, rows).view(np.int64)
                one, two = _prints(grams, bounds)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * bands, pa.int32()), pa.array(names.ravel()))
                number = pa.array(np.arange(row, row + hi - lo)) if row_column is None else b.column(2).slice(lo, hi - lo)
                row += hi - lo
                size = pa.array(np.diff(bounds), pa.int64())
                yield pa.RecordBatch.from_arrays([number, b.column(0).slice(lo, hi - lo), size, pa.array(one), pa.array(two), listed], out)

    out = ["row", "id", "n_grams", "print1", "print2", "names"]
    own = [] if row_column is None else [F.col(f"`{row_column}`").alias("row")]
    chosen = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"), *own)
    kind = chosen.schema["id"].dataType.simpleString()
    return materialize(map_batches(chosen, run, f"row bigint, id {kind}, n_grams bigint, print1 bigint, print2 bigint, names array<bigint>"), "signatures")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b), all long; the label is the component's least node.

    Each turn takes the least label among neighbours and then that label's own label. A turn is
    written, which cuts the lineage; a busy node costs one combined row a task.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    both = materialize(both, "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        met = labels.join(near, "node").select("node", "label", F.least("label", "m").alias("m"))
        hop = labels.select(F.col("node").alias("m"), F.col("label").alias("further"))
        met = met.join(hop, "m").select("node", F.least("m", "further").alias("label"), (F.least("m", "further") < F.col("label")).alias("moved"))
        met = materialize(met, "labels")
        labels = met.select("node", "label")
        if met.filter("moved").isEmpty():
            return labels


def _candidate_components(classes: DataFrame) -> DataFrame:
    """(node, component) of the classes that share a bucket with another one, directly or through others.

    Members of a bucket of one of the first ``FOLDED`` bands are folded into its least label in
    turn. Near copies share most buckets, so after that a crowd of them is a few labels, and the
    other bands are taken once a label.
    """
    folded = classes.select("node", F.col("node").alias("label"), "names")
    for band in range(FOLDED):
        name = F.element_at("names", band + 1)
        least = folded.groupBy(name.alias("name")).agg(F.min("label").alias("least"))
        folded = folded.withColumn("name", name).join(least, "name").select("node", F.col("least").alias("label"), "names")
    folded = materialize(folded, "folded")
    labelled = folded.select("label", F.explode("names").alias("name")).distinct()
    hubs = labelled.groupBy("name").agg(F.min("label").alias("hub"), F.max("label").alias("top")).filter("hub < top")
    met = labelled.join(hubs.select("name", "hub"), "name").filter("label <> hub")
    pointers = met.select(F.col("label").alias("a"), F.col("hub").alias("b"))
    joined = components(pointers).select(F.col("node").alias("label"), F.col("label").alias("component"))
    found = folded.select("node", "label").join(joined, "label", "left").select("node", F.coalesce("component", "label").alias("component"))
    crowded = found.groupBy("component").count().filter("count > 1").select("component")
    return materialize(found.join(crowded, "component", "left_semi").select("node", "component"), "candidates")


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given sets, pair by pair."""
    out = np.zeros(len(left), dtype=np.int64)
    if len(left) <= 4 * len(sets):
        for k, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            a, b = (sets[i], sets[j]) if len(sets[i]) < len(sets[j]) else (sets[j], sets[i])
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            out[k] = int((b[at] == a).sum())
        return out
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    number = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])])
    often = np.bincount(number) > 1
    column = (np.cumsum(often) - 1)[number]
    keep = often[number]
    column, owner = column[keep], owner[keep]
    total = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for lo in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        grid = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        grid[owner[a:b], column[a:b] - lo] = 1
        total += (grid @ grid.T).astype(np.int64)  # counts up to COLUMNS are exact
    return total[left, right]


def _compare(block: np.ndarray, same: bool, names: np.ndarray, sets: list[np.ndarray], limit: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a tile that share a band and are alike by their full sets."""
    m = len(sets)
    meet = np.zeros((m, m), dtype=bool)
    for b in range(names.shape[1]):
        meet |= names[:, b][:, None] == names[:, b][None, :]
    if not same:
        meet &= block[:, None] != block[None, :]
    left, right = np.nonzero(np.triu(meet, 1))
    if not len(left):
        return left, right
    size = np.array([len(x) for x in sets])
    possible = np.minimum(size[left], size[right]) * limit.denominator >= np.maximum(size[left], size[right]) * limit.numerator
    left, right = left[possible], right[possible]
    common = _shared(sets, left, right)
    alike = common * limit.denominator >= (size[left] + size[right] - common) * limit.numerator
    return left[alike], right[alike]


def _tile(group: pa.Table, limit: Fraction) -> pa.Table:
    """(node, links, a): links of the classes in the tiles of a group, and one linked class each."""
    part, lo, hi, block = (group.column(c).to_numpy() for c in ("component", "lo", "hi", "block"))
    order = np.lexsort((group.column("node").to_numpy(), hi, lo, part))
    part, lo, hi, block = part[order], lo[order], hi[order], block[order]
    node, size = group.column("node").to_numpy()[order], group.column("size").to_numpy()[order]
    raw, names = group.column("grams"), group.column("names")
    cut = np.flatnonzero((part[1:] != part[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
    nodes, links, ends = [], [], []
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(order)], strict=True):
        span = slice(s, e)
        if e - s < 2:
            continue
        sets = [np.frombuffer(raw[int(k)].as_py(), dtype=np.uint64) for k in order[span]]
        bands = np.array([names[int(k)].as_py() for k in order[span]], dtype=np.int64)
        left, right = _compare(block[span], bool(lo[s] == hi[s]), bands, sets, limit)
        if not len(left):
            continue
        own, many = node[span], size[span]
        count = np.bincount(left, many[right], e - s) + np.bincount(right, many[left], e - s)
        least = np.arange(e - s)
        while True:
            before = least.copy()
            np.minimum.at(least, right, least[left])
            np.minimum.at(least, left, least[right])
            least = least[least]
            if (before == least).all():
                break
        linked = np.flatnonzero(count)
        nodes.append(own[linked])
        links.append(count[linked].astype(np.int64))
        ends.append(own[least[linked]])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.table({"node": join(nodes), "links": join(links), "a": join(ends)})


def ngram_jaccard(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    words: int = WORDS,
    recall: float = RECALL,
    id_column: str = "doc_id",
    text_column: str = "text",
    row_column: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: row, id, class_id, copy_id, n_links, first.

    * copy_id: the least id among rows of the same n-gram set; class_id: the least id among all
      that are linked to each other, directly or through others. Ids that are null do not name
      a class unless it has no other id.
    * n_links: how many other rows are alike (Jaccard at least ``similarity``), copies counted.
    * first: whether the row stands for its class; one row of each class does, of its least id.
    * row: ``row_column``, which must differ from row to row, or else a number given here.
    * Null and empty texts have no n-grams: each is a class of its own, without links. Texts of
      fewer than ``words`` words have one n-gram, all of their words. Repeated rows are copies.
    * An empty table gives an empty result; further columns do not matter.
    """
    bands, rows = choose_bands(similarity, recall)
    limit = Fraction(similarity).limit_denominator(10_000)
    spark = docs.sparkSession
    signed = _signed(docs, words, bands, rows, id_column, text_column, row_column)
    prints = ["print1", "print2"]
    least = F.struct(F.isnull("id").alias("unnamed"), F.col("id"), F.col("row"))
    classes = signed.filter("n_grams > 0").groupBy(*prints).agg(
        F.min("row").alias("node"), F.min("id").alias("copy_id"), F.count(F.lit(1)).alias("size"), F.min(least).alias("least"), F.first("names").alias("names")
    )
    classes = materialize(classes, "classes")
    found = _candidate_components(classes)
    blocks = found.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    found = found.join(blocks, "component").join(classes, "node")
    members = materialize(found, "members")
    release(spark)

    # The full sets, of the candidates alone: their texts are read and hashed once more.
    wanted = members.select(F.col("copy_id").alias("__wanted")).distinct()
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text"))
    # How texts move is the same at all sizes: what a small table would copy to every task grows.
    texts = texts.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("__wanted")), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _bytes(b.column(0))
            for lo, hi in chunks(own):
                grams, bounds = ngram_sets(own[lo:hi], words)
                one, two = _prints(grams, bounds)
                raw = [grams[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(raw, pa.binary())], [*prints, "grams"])

    sets = map_batches(texts, run, "print1 bigint, print2 bigint, grams binary")
    # Rows of one id can repeat; of each class only one set goes on.
    sets = sets.join(members, prints).dropDuplicates(["node"])
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiled = sets.select("component", "node", "size", "names", "grams", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiled = tiled.select("component", "node", "size", "names", "grams", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    # Components of one tile share groups; every tile of a larger component is a group.
    small = F.pmod(F.xxhash64("component"), F.lit(4 * partitions(spark)))
    several = F.col("hi") + F.col("lo") > 0
    group = F.when(several, F.xxhash64("component", "lo", "hi")).otherwise(small)
    ship(spark)
    verified = tiled.withColumn("tile", group).groupBy("tile").applyInArrow(lambda t: _tile(t, limit), "node bigint, links bigint, a bigint")
    verified = materialize(verified, "links")
    release(spark)
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    clusters = components(verified.select("a", F.col("node").alias("b")))
    joined = classes.join(links, "node", "left").join(clusters, "node", "left")
    joined = joined.select(*prints, "least", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("label", "node").alias("label"))
    names = joined.groupBy("label").agg(F.min("copy_id").alias("class_id"), F.min("least").alias("head"))
    joined = joined.join(names, "label").select(*prints, "copy_id", "class_id", "n_links", F.col("head.row").alias("head"))
    full = signed.filter("n_grams > 0").join(joined, prints).select("row", "id", "class_id", "copy_id", "n_links", (F.col("row") == F.col("head")).alias("first"))
    empty = signed.filter("n_grams = 0").select("row", "id", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return full.unionByName(empty)


def first_of_class(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, whole, that stand for their class: one of each group of near copies.

    Rows are read more than once, so they are written with their numbers: a second scan of the same
    files can cut them into other partitions and number the rows anew.
    Others than the first of a class are fewer than the rows that stay, so it is they that are joined.
    """
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = ngram_jaccard(numbered, row_column="__row", id_column=id_column, **options)
    others = materialize(found.filter(~F.col("first")).select(F.col("row").alias("__other"), F.col("id").alias("__id")), "others")
    release(docs.sparkSession)
    same = (F.col("__row") == F.col("__other")) & F.col(f"`{id_column}`").eqNullSafe(F.col("__id"))
    return numbered.join(others.hint("merge"), same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id, copy_id, n_links of every document: five words, 0.8 or more; see ``ngram_jaccard``."""
    out = ngram_jaccard(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "copy_id", "n_links")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (
  SELECT p.a, p.b, common = x.n AND common = y.n AS same
  FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id
  WHERE common * 5 >= (x.n + y.n - common) * 4),
r AS (
  SELECT doc_id AS node, doc_id AS label FROM documents
  UNION
  SELECT e.b, r.label FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, (SELECT min(label) FROM r WHERE r.node = d.doc_id) AS class_id,
       least(d.doc_id, coalesce((SELECT min(b) FROM e WHERE e.a = d.doc_id AND e.same), d.doc_id)) AS copy_id,
       (SELECT count(*) FROM e WHERE e.a = d.doc_id) AS n_links
FROM documents d
"""
