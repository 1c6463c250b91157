"""Mix sources to target weights by systematic sampling, with DataFrame functions only.

A source's target over its size is the number of copies expected of each of its documents, at
most ``max_repeat``. The copies are summed along the source, one random offset is added, and a
document is taken once for each integer that the sum crosses with it. Along a source the
documents stand by size, so the words taken follow the documents taken.

The prefix sums have two levels. A cell is a source, a class of sizes (a class ends 9 % above
its start) and one of ``BUCKETS`` hash buckets; cells are counted and added up along the source,
which is a table bounded by classes times buckets a source. Inside a cell a window counts. So no
task gets more than a cell, whatever a source or a size holds of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from daybook.llm.common import WORD, md5_number, null_last_key, table
from daybook.session import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 20240229
BUCKETS = 64
CLASSES_PER_DOUBLING = 8


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT) -> DataFrame:
    """Target size of each source, from rows (skey, size).

    Sources in order of ``skey`` weigh ``weights``, repeating, and share the sum of all sizes. A
    target stops at ``max_repeat`` times its source's size and the rest is shared again. With
    sources in order of (limit / weight), the common level at which nobody is above its limit is
    the largest of (what is left) / (weights left) over all prefixes taken as limited. The two
    windows order the sources themselves: one short row a source.
    """
    per = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("skey")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.select("skey", "source_size", weight.alias("weight"))
    per = per.withColumn("most", (F.col("source_size") * max_repeat).cast("double"))
    rising = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = per.withColumn("level", left / F.sum("weight").over(after))
    level = level.withColumn("level", F.max("level").over(everything))
    return level.select("skey", "source_size", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def systematic_copies(
    docs: DataFrame,
    weights=WEIGHTS,
    max_repeat=MAX_REPEAT,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    keep: list[str] | None = None,
) -> DataFrame:
    """(doc, size, source_size, target, copies) for each row; ``doc`` is the row as a struct, or its ``keep`` columns.

    * size: words of the text (runs outside of ASCII white space); null and empty texts: 0.
    * Sources stand by code point, null last, as one source.
    * A source of size 0 has target 0; its documents are not taken.
    * Rows of equal id are separate documents; if size and id are equal too they are alike and
      any of them may be the one that is taken.
    * Further columns, of any name, stay inside ``doc``. An empty table gives an empty table.
    """
    name = lambda c: F.col(f"`{c}`")
    id_text = F.coalesce(name(id_column).cast("string"), F.lit(""))
    size = F.coalesce(F.regexp_count(name(text_column), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(
        F.struct(*[name(c) for c in keep or docs.columns]).alias("doc"),
        null_last_key(source_column).alias("skey"),
        size.alias("size"),
        F.pmod(md5_number(F.lit(str(seed)), id_text), F.lit(BUCKETS)).cast("int").alias("bucket"),
        id_text.alias("id_text"),
    )
    rows = rows.withColumn("class", F.floor(F.log2(F.col("size") + 1.0) * CLASSES_PER_DOUBLING).cast("int"))
    if keep:
        rows = materialize(rows, "sizes")  # words are counted once; with whole rows, twice
    cell = ["skey", "class", "bucket"]
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    earlier = Window.partitionBy("skey").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    targets = source_targets(cells.select("skey", "size"), weights, max_repeat)
    offset = md5_number(F.lit(str(seed)), F.lit("offset"), F.col("skey")) / F.lit(float(2**32))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeat)), F.col("target") / F.col("source_size")))
    plan = (
        cells.select(*cell, start.alias("start"))
        .join(targets, "skey")
        .select(*cell, "start", "source_size", "target", offset.alias("offset"), F.coalesce(rate, F.lit(0.0)).alias("rate"))
    )
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("size", "id_text"))
    placed = rows.withColumn("inside", inside).join(plan, cell)
    crossed = lambda k: F.floor(F.col("offset") + F.col("rate") * k)
    end = F.col("start") + F.col("inside")
    return placed.select("doc", "size", "source_size", "target", (crossed(end) - crossed(end - 1)).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: each row as often as it is taken, with the columns of ``docs``."""
    taken = systematic_copies(docs, **options).filter(F.col("copies") > 0)
    repeats = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.select("doc", repeats.alias("repeat")).select("doc.*")


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; see ``systematic_copies``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = systematic_copies(docs, keep=["doc_id"])
    return out.select(
        F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         coalesce(CAST(doc_id AS VARCHAR), '') AS id_text
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY skey
           ORDER BY CAST(floor(log2(size + 1.0) * 8) AS INT), CAST(concat('0x', substr(md5('20240229|' || id_text), 1, 8)) AS BIGINT) % 64,
                    size, id_text) AS place
  FROM sized),
per AS (
  SELECT skey, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM sized GROUP BY skey),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum((source_size * 3)::DOUBLE) OVER (ORDER BY (source_size * 3)::DOUBLE / weight, skey
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY (source_size * 3)::DOUBLE / weight, skey
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
targets AS (
  SELECT skey, source_size, least((source_size * 3)::DOUBLE, weight * (SELECT max(level) FROM levels)) AS target,
         CAST(concat('0x', substr(md5('20240229|offset|' || skey), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate FROM targets)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       CAST((floor(start + rate * place) - floor(start + rate * (place - 1))) * size AS BIGINT) AS taken
FROM ranked JOIN rates USING (skey)
"""
