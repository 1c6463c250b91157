"""A posting index for exact BM25 top-k search, with bounds that let most postings alone.

Building tokenises each text once. A posting is one term of one document with its impact, the part
of the BM25 gain that does not depend on the query. Documents stand in blocks of
``BLOCK_DOCS``, and a second table keeps for each term and block how many documents have the term and
the largest impact among them. Texts are dealt out by block and all tables are bucketed by it:
building shuffles no posting, and a search moves what it looks for to the postings, never these.

A search goes over the postings of its terms in three steps:

* Threshold. The rarest terms of a query, as many as hold k documents, name their k best
  blocks each; the documents of those blocks are scored in full. The k-th best of them is a bound
  that the true k-th best score cannot be below.
* Blocks. Terms that even together cannot reach the bound are not essential: a document without
  any other term is out. Blocks with an essential term get the sum of the largest gains of
  all terms of the query; those below the bound are out.
* Scores. In the blocks that are left the gains of essential terms are added up. Documents that
  cannot reach the bound with the largest gains of all other terms in their block are out; for
  those that are left the other terms are added.

A common word therefore meets a query only in the few documents that its rare words lead to. Terms of
queries are copied to all tasks, or joins by term are salted by block, so no word is a hot key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.fixed_values import BM25_B, BM25_K1
from daybook.functions.text import tokens
from daybook.session import materialize, materialize_in_buckets, meeting_in_buckets

BLOCK_BITS = 8
BLOCK_DOCS = 1 << BLOCK_BITS
SALTS = 16
# So many terms of queries are copied to every task; more of them are shuffled.
COPIED_TERMS = 200_000
# Stands in the table of term counts for the document itself; a term has three letters or more.
NO_TERM = ""
# Bounds are sums of doubles in another order than the scores: a block this close stays in.
SLACK = 1e-9


def idf(n_docs: Column, df: Column) -> Column:
    return F.log((n_docs - df + 0.5) / (df + 0.5) + 1)


def query_terms(queries: DataFrame, query: str = "query_id", text: str = "query_text") -> DataFrame:
    """(corpus, query, term, mult): a term repeated in the query counts again."""
    return (
        queries.select("corpus", F.col(query).alias("query"), F.explode_outer(tokens(F.col(text))).alias("term"))
        .filter("term is not null")
        .groupBy("corpus", "query", "term")
        .agg(F.count(F.lit(1)).alias("mult"))
    )


def _copied(rows: DataFrame) -> DataFrame:
    """Written rows, marked to be copied to all tasks unless they are too many."""
    return F.broadcast(rows) if rows.count() <= COPIED_TERMS else rows


class PostingIndex:
    """Tables ``postings`` (corpus, term, block, row, doc, impact), ``blocks`` (corpus, term, block, n,
    most) and ``stats`` (corpus, n_docs, avgdl). ``whole`` is false for an index of some terms."""

    def __init__(self, postings: DataFrame, blocks: DataFrame, stats: DataFrame, whole: bool = True):
        self.postings, self.blocks, self.stats, self.whole = postings, blocks, stats, whole

    @classmethod
    def build(cls, docs: DataFrame, doc: str = "doc_id", text: str = "text", k1: float = BM25_K1, b: float = BM25_B, terms: DataFrame | None = None) -> PostingIndex:
        """Index ``docs``, which has a ``corpus`` column. Each row is a document, whatever its id.

        An index for a few searches needs the terms of their queries only: those in ``terms``, a column ``term``.
        """
        pieces = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # Tokenising costs more than moving a text; dealt out, a file of one row group is not one task.
        numbered = docs.select("corpus", F.monotonically_increasing_id().alias("row"), F.col(doc).alias("doc"), F.col(text).alias("text"))
        dealt = numbered.withColumn("block", F.shiftright("row", BLOCK_BITS)).repartition(pieces, "block")
        words = F.coalesce(tokens(F.col("text")), F.array().cast("array<string>"))
        said = dealt.select("corpus", "block", "row", "doc", words.alias("words"))
        every = F.explode(F.concat("words", F.array(F.lit(NO_TERM)))).alias("term")
        one = said.select("corpus", "block", "row", "doc", F.size("words").alias("doc_len"), every)
        if terms is not None:
            asked = terms.select("term").union(docs.sparkSession.range(1).select(F.lit(NO_TERM))).distinct()
            one = one.join(_copied(materialize(asked, "asked-terms")), "term", "left_semi")
        counts = one.groupBy("block", "row", "term", "doc", "corpus", "doc_len").agg(F.count(F.lit(1)).alias("tf"))
        counts = materialize_in_buckets(counts, "term-counts", "block")
        stats = counts.filter(F.col("term") == NO_TERM).groupBy("corpus")
        stats = stats.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("doc_len") / F.count(F.lit(1))).alias("avgdl"))
        stats = materialize(stats, "corpus-stats")
        impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avgdl")))
        postings = counts.filter(F.col("term") != NO_TERM).join(F.broadcast(stats.select("corpus", "avgdl")), "corpus")
        postings = postings.select("corpus", "term", "block", "row", "doc", impact.alias("impact"))
        blocks = postings.groupBy("corpus", "term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("impact").alias("most"))
        return cls(postings, materialize_in_buckets(blocks, "posting-blocks", "block"), stats, terms is None)


class Search:
    """The steps of one search; each is a table or a lazy plan over tables."""

    def __init__(self, index: PostingIndex, wanted: DataFrame, k: int | Mapping[str, int]):
        """``wanted`` are written ``query_terms``; ``k`` documents a query, by corpus if a mapping."""
        limit = F.lit(0)
        for name, n in k.items() if isinstance(k, Mapping) else ():
            limit = F.when(F.col("corpus") == name, F.lit(n)).otherwise(limit)
        self.limit = limit if isinstance(k, Mapping) else F.lit(k)
        self.most = max(k.values(), default=0) if isinstance(k, Mapping) else k
        self.postings, self.blocks = index.postings, index.blocks
        if index.whole:  # rows of its own terms are all that the search reads, once
            terms = _copied(materialize(wanted.select("corpus", "term").distinct(), "asked-terms"))
            self.postings = materialize_in_buckets(index.postings.join(terms, ["corpus", "term"], "left_semi"), "query-postings", "block")
            self.blocks = materialize_in_buckets(index.blocks.join(terms, ["corpus", "term"], "left_semi"), "query-blocks", "block")
        known = self.blocks.groupBy("corpus", "term").agg(F.sum("n").alias("df"), F.max("most").alias("top"))
        weight = F.col("mult") * idf(F.col("n_docs"), F.col("df"))
        weighted = wanted.join(known, ["corpus", "term"]).join(index.stats, "corpus").withColumn("weight", weight)
        rarest = Window.partitionBy("corpus", "query").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
        seed = F.coalesce(F.sum("df").over(rarest), F.lit(0)) < self.limit
        self.weights = materialize(weighted.select("corpus", "query", "term", "weight", "top", seed.alias("seed")), "query-weights")

    def _met(self, weights: DataFrame) -> DataFrame:
        """Written ``weights``, a row a term of a query, with the blocks of the term."""
        blocks = self.blocks.select("corpus", "term", "block", "most")
        if weights.count() <= COPIED_TERMS:
            return blocks.join(F.broadcast(weights), ["corpus", "term"])
        salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
        salted = blocks.withColumn("salt", F.pmod("block", F.lit(SALTS)))
        return salted.join(weights.withColumn("salt", F.explode(salts)), ["corpus", "term", "salt"]).drop("salt")

    def _gains(self, chosen: DataFrame, *keep: str) -> DataFrame:
        """(corpus, query, block, row, doc, gain) of the postings in ``chosen`` (corpus, query, term, block, weight)."""
        met = self.postings.join(chosen.hint("shuffle_hash"), ["corpus", "term", "block"])
        return met.select("corpus", "query", "block", "row", "doc", (F.col("weight") * F.col("impact")).alias("gain"), *keep)

    def bounds(self) -> DataFrame:
        """(corpus, query, bound): a score that the k-th best reaches; no row where fewer documents were met."""
        best = Window.partitionBy("corpus", "term").orderBy(F.desc("most"), "block")
        seeds = self.weights.filter("seed")
        blocks = self.blocks.join(seeds.select("corpus", "term").distinct(), ["corpus", "term"], "left_semi")
        blocks = blocks.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= self.most)
        pairs = seeds.join(blocks.select("corpus", "term", "block"), ["corpus", "term"]).select("corpus", "query", "block").distinct()
        chosen = pairs.join(self.weights.select("corpus", "query", "term", "weight"), ["corpus", "query"])
        scores = self._gains(chosen).groupBy("corpus", "query", "block", "row").agg(F.sum("gain").alias("score"))
        order = Window.partitionBy("corpus", "query").orderBy(F.desc("score"))
        placed = scores.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= self.most)
        return placed.filter(F.col("place") == self.limit).select("corpus", "query", F.col("score").alias("bound"))

    def reachable(self) -> DataFrame:
        """(corpus, query, term, block, weight, essential, others, least): all terms of each query in the blocks
        that can reach its bound ``least``; ``others`` is the most that terms not essential add in the block."""
        least = F.coalesce("bound", F.lit(0.0)) * (1 - SLACK)
        bounded = self.weights.join(materialize(self.bounds(), "query-bounds"), ["corpus", "query"], "left")
        rising = Window.partitionBy("corpus", "query").orderBy(F.col("weight") * F.col("top"), "term")
        together = F.sum(F.col("weight") * F.col("top")).over(rising)
        bounded = bounded.withColumn("least", least).withColumn("essential", together >= F.col("least"))
        bounded = bounded.filter("query is not null").select("corpus", "query", "term", "weight", "least", "essential")
        of_block = Window.partitionBy("corpus", "query", "block")
        largest = F.col("weight") * F.col("most")
        held = self._met(materialize(bounded, "query-bounded"))
        held = held.withColumn("reach", F.sum(largest).over(of_block)).withColumn("led", F.max("essential").over(of_block))
        held = held.withColumn("others", F.coalesce(F.sum(F.when(~F.col("essential"), largest)).over(of_block), F.lit(0.0)))
        return held.filter("led and reach >= least").select("corpus", "query", "term", "block", "weight", "essential", "others", "least")

    def everything(self) -> DataFrame:
        """All terms of each query in all of their blocks: what a search without bounds reads."""
        return self.weights.join(self.blocks.select("corpus", "term", "block"), ["corpus", "term"]).select("corpus", "query", "term", "block", "weight")

    @staticmethod
    def _summed(gains: DataFrame, *more: Column) -> DataFrame:
        """Scores and, as decimals, in which the order of adding does not matter, the order of documents."""
        by = ["corpus", "query", "block", "row", "doc"]
        return gains.groupBy(*by).agg(F.sum("gain").alias("score"), F.sum(F.col("gain").cast("decimal(28,18)")).alias("order"), *more)

    def scores(self) -> DataFrame:
        """(corpus, query, block, row, doc, score, order) of documents that can be among the best."""
        chosen = materialize_in_buckets(self.reachable(), "query-reachable", "block")
        first = self._gains(chosen.filter("essential"), "others", "least")
        first = self._summed(first, F.max("others").alias("others"), F.max("least").alias("least"))
        first = first.filter(F.col("score") * (1 + SLACK) + F.col("others") >= F.col("least"))
        first = materialize_in_buckets(first.drop("others", "least"), "query-candidates", "block")
        wanted = chosen.filter(~F.col("essential")).select("corpus", "query", "term", "block", "weight").hint("shuffle_hash")
        rest = first.select("corpus", "query", "block", "row").join(wanted, ["corpus", "query", "block"]).hint("shuffle_hash")
        rest = self.postings.join(rest, ["corpus", "term", "block", "row"])
        rest = self._summed(rest.select("corpus", "query", "block", "row", "doc", (F.col("weight") * F.col("impact")).alias("gain")))
        rest = rest.select("corpus", "query", "block", "row", F.col("score").alias("more"), F.col("order").alias("more_order"))
        both = first.join(rest.hint("shuffle_hash"), ["corpus", "query", "block", "row"], "left")
        score, order = F.col("score") + F.coalesce("more", F.lit(0.0)), F.col("order") + F.coalesce("more_order", F.lit(0))
        return both.select("corpus", "query", "block", "row", "doc", score.alias("score"), order.alias("order"))

    def top(self, pruned: bool = True) -> DataFrame:
        """(corpus, query, rank, doc, score): scores above zero, ties by document and then row."""
        with meeting_in_buckets(self.weights.sparkSession):
            scored = (self.scores() if pruned else self._summed(self._gains(self.everything()))).filter("score > 0")
            best = Window.partitionBy("corpus", "query").orderBy(F.desc("order"), "doc", "row")
            placed = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= self.most)
            found = placed.filter(F.col("rank") <= self.limit).select("corpus", "query", "rank", "doc", "score")
            return materialize(found, "query-hits")  # a few rows a query
