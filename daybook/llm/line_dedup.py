"""Remove lines that many documents share: levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed by hash and sorted inside each bucket, with the number
of documents of each line and its owner. Documents come in batches from the largest ids down.
A batch's distinct lines are merge-anti-joined with the runs: a line that no run holds is new, so
the batch's largest id that holds it is its owner; a line that a run holds adds its count only.
The batch's lines then become a run of level 0; two runs of a level are compacted into one of the
next, so b batches leave at most log2(b) + 1 runs to join with and a key is rewritten as often.
Runs share the buckets of the session's shuffle partitions: neither the joins nor the
compactions move a run.

Counts, positions and kept lines are worked out by DataFrame functions. Lines are known by two
64-bit hashes, 128 bits together; their positions in a text, not the lines, go through shuffles.
A line held by more than one in ``HOT_LINES`` of all that could go is looked up in a table of at
most ``HOT_LINES`` rows that every task has, so no line is a hot key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import discard, partitions, table
from daybook.session import materialize, scratch_path

MIN_DOCS = 5
MIN_LENGTH = 40
BATCHES = 4
HOT_LINES = 10_000
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class LineRuns:
    """Runs of (h1, h2, n, owner), at most one a level; a key is at most once in a run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.buckets = spark, partitions(spark)
        self.levels: list[str | None] = []
        self.paths: dict[str, str] = {}

    def runs(self) -> list[str]:
        return [run for run in self.levels if run]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _compact(self, new: str, old: str) -> str:
        """One run for two. Keys of one bucket meet in one task, so a join merges them without moving either."""
        a = self.spark.table(new).withColumnsRenamed({"n": "n1", "owner": "owner1"})
        b = self.spark.table(old).withColumnsRenamed({"n": "n2", "owner": "owner2"})
        n = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))
        run = self._write(a.join(b, ["h1", "h2"], "full").select("h1", "h2", n.alias("n"), F.greatest("owner1", "owner2").alias("owner")))
        self._drop(new)
        self._drop(old)
        return run

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (h1, h2, n, owner); owners of keys that a run holds stay theirs."""
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            held = self.spark.table(run).select("h1", "h2", F.lit(True).alias(f"in{i}"))
            batch = batch.join(held, ["h1", "h2"], "left")
            known = known | F.col(f"in{i}").isNotNull()
        run, level = self._write(batch.select("h1", "h2", "n", F.when(~known, F.col("owner")).alias("owner"))), 0
        while level < len(self.levels) and self.levels[level]:
            run, self.levels[level] = self._compact(run, self.levels[level]), None
            level += 1
        self.levels[level:level + 1] = [run]

    def close(self) -> DataFrame:
        """One row a key over all runs, compacted into one; ``drop`` it when it has been read."""
        runs = self.runs()
        while len(runs) > 1:
            runs[:2] = [self._compact(*runs[:2])]
        self.levels = runs
        return self.spark.table(runs[0])

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        discard(self.spark, self.paths.pop(run))

    def drop(self) -> None:
        for run in self.runs():
            self._drop(run)
        self.levels = []


def _keys(text: Column, min_length: int) -> Column:
    """Sorted (h1, h2, pos) of the lines whose key is long enough."""
    key = F.btrim
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(key(x, F.lit(BLANKS)).alias("key"), i.alias("pos")))
    long = F.filter(lines, lambda x: F.length(x.key) >= min_length)
    # ASCII text has a fast path in lower(); elsewhere only A-Z may change.
    fold = lambda c: F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))
    folded = F.transform(long, lambda x: F.struct(fold(x.key).alias("key"), x.pos.alias("pos")))
    hashed = F.transform(folded, lambda x: F.struct(F.xxhash64(x.key).alias("h1"), F.xxhash64(F.lit(1), x.key).alias("h2"), x.pos.alias("pos")))
    return F.array_sort(hashed)


def _with(value: Column, function) -> Column:
    """``function`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def _distinct(keys: Column) -> Column:
    """The first of each run of equal keys of a sorted array."""
    same = lambda s, x, i: (F.get(s, i - 1).h1 == x.h1) & (F.get(s, i - 1).h2 == x.h2)
    return _with(keys, lambda s: F.filter(s, lambda x, i: (i == 0) | ~same(s, x, i)))


def shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, batches: int = BATCHES) -> DataFrame:
    """Written (id, mark, drops): positions of the lines that go, by id and hash of the text.

    ``docs`` has columns id and text. See ``without_shared_lines``.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    parts = [i / batches for i in range(1, batches)] or [0.0]
    cuts = sorted(set(docs.agg(F.percentile_approx("id", parts, 1_000)).first()[0] or []))
    batch = sum((F.when(F.col("id") > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    path = scratch_path(spark, "line-keys")
    keyed = docs.select("id", F.xxhash64(text).alias("mark"), _keys(text, min_length).alias("keys"), batch.alias("batch"))
    keyed.filter(F.size("keys") > 0).write.partitionBy("batch").parquet(path)
    schema = "id bigint, mark bigint, keys array<struct<h1:bigint,h2:bigint,pos:int>>, batch int"
    keyed = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark)
    for b in range(len(cuts), -1, -1):
        lines = keyed.filter(F.col("batch") == b).select("id", F.explode(_distinct(F.col("keys"))).alias("k"))
        runs.add(lines.groupBy("k.h1", "k.h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("owner")))
    going = materialize(runs.close().filter(F.col("n") >= min_docs), "shared-lines")
    runs.drop()
    held = going.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_LINES >= held  # at most HOT_LINES rows, since their n add up to no more than ``held``
    lines = keyed.select("id", "mark", F.inline("keys"))
    # The owner of hot lines in a struct: null where the line is not hot.
    often = going.filter(hot).select("h1", "h2", F.struct("owner").alias("often"))
    lines = lines.join(F.broadcast(often), ["h1", "h2"], "left")
    frequent = lines.filter(F.col("often").isNotNull()).select("id", "mark", "pos", F.col("often.owner").alias("owner"))
    seldom = lines.filter(F.col("often").isNull()).join(going.filter(~hot), ["h1", "h2"]).select("id", "mark", "pos", "owner")
    gone = frequent.unionAll(seldom).filter(~F.col("id").eqNullSafe(F.col("owner")))
    drops = materialize(gone.groupBy("id", "mark").agg(F.collect_set("pos").alias("drops")), "line-drops")
    discard(spark, path)
    return drops


def without_shared_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_length: int = MIN_LENGTH,
    batches: int = BATCHES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc, text, n_lines, n_dropped) for each row; ``doc`` is the row as a struct, ``text`` what is left.

    Texts are split at line feeds; a null or empty text is one empty line and stays as it is. A
    line's key is the line without ASCII white space at its ends, A-Z lower-cased. A key of at
    least ``min_length`` code points held by at least ``min_docs`` rows goes everywhere but in
    the rows of the largest id that holds it, where all its lines stay. Rows of equal id
    are separate documents in the count. A null id is the smallest. A text of which every line
    goes is empty. Further columns, of any name, stay inside ``doc``. An empty table gives no row.
    """
    text = F.col(f"`{text_column}`").cast("string")
    ids = F.col(f"`{id_column}`").cast("long")
    drops = shared_lines(docs.select(ids.alias("id"), text.alias("text")), min_docs, min_length, batches)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), ids.alias("own"), text.alias("text"))
    marked = rows.withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = marked.join(drops, F.col("own").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("mark")), "left")
    lines = F.split("text", "\n")
    kept = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("drops"))
    left = _with(lines, lambda ls: F.concat_ws("\n", F.transform(kept(ls), lambda i: F.get(ls, i))))
    return both.select(
        "doc",
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of all documents, those dropped, and a digest of what is left; see ``without_shared_lines``."""
    out = without_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", digest.alias("kept_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
shared AS (
  SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(doc_id <> owner, false) AS gone FROM k LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
