"""Term statistics, BM25 ranking of many queries over one or several corpora, and reranking."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.fixed_values import BM25_B, BM25_K1, RERANK_WEIGHTS, SEARCH_K
from daybook.functions.text import token_count, tokens, with_term_counts
from daybook.operators.postings import PostingIndex, Search, idf, query_terms
from daybook.session import materialize

ONE_CORPUS = "all"


def term_frequencies(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings: (doc, term, tf, doc_len)."""
    return (
        with_term_counts(docs.withColumn("doc_len", token_count(F.col(text))), text)
        .select(doc, "doc_len", F.inline_outer("term_counts"))
        .filter("term is not null")
        .select(doc, "term", "tf", "doc_len")
    )


def corpus_stats(docs: DataFrame, text: str = "text", corpus: str | None = None) -> DataFrame:
    """Per corpus: number of documents and average length in tokens."""
    return docs.groupBy(F.col(corpus) if corpus else F.lit(ONE_CORPUS).alias("corpus")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        (F.sum(token_count(F.col(text))) / F.count(F.lit(1))).alias("avgdl"),
    )


def term_idf(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, idf) over one corpus."""
    terms = docs.select(F.explode_outer(F.array_distinct(tokens(F.col(text)))).alias("term"))
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        terms.filter("term is not null")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("idf", idf(n_docs, F.col("df")))
    )


def bm25_topk(
    docs: DataFrame,
    queries: DataFrame,
    k: int | Mapping[str, int] = SEARCH_K,
    doc: str = "doc_id",
    text: str = "text",
    query: str = "query_id",
    query_text: str = "query_text",
    k1: float = BM25_K1,
    b: float = BM25_B,
) -> DataFrame:
    """Best documents of every query: (corpus, query, rank, doc, score), scores above zero.

    With a mapping for ``k``, ``docs`` has a ``corpus`` column, every corpus is ranked on
    its own with its own ``k``, and a query goes to the corpus in its ``corpus`` column, or to
    each of them if there is none. A corpus without documents yields no rows.

    The documents are indexed first, see ``postings``; to search them more than once build a
    ``PostingIndex`` and give it to ``search_topk``. Scores are not rounded: the weight of a word that
    every document has falls with their number, and still counts. Ties go to the lower document id.
    """
    if isinstance(k, Mapping):
        docs = docs.filter(F.col("corpus").isin(list(k)))
    else:
        docs = docs.withColumn("corpus", F.lit(ONE_CORPUS))
    terms = materialize(query_terms(_addressed(queries, k), query, query_text), "query-terms")
    return _shown(Search(PostingIndex.build(docs, doc, text, k1, b, terms), terms, k), doc, query)


def _addressed(queries: DataFrame, k: int | Mapping[str, int]) -> DataFrame:
    """Queries with the corpus that they go to."""
    if not isinstance(k, Mapping):
        return queries.withColumn("corpus", F.lit(ONE_CORPUS))
    if "corpus" not in queries.columns:
        return queries.withColumn("corpus", F.explode(F.array(*[F.lit(c) for c in k])))
    return queries.filter(F.col("corpus").isin(list(k)))


def search_topk(
    index: PostingIndex, queries: DataFrame, k: int | Mapping[str, int] = SEARCH_K, doc: str = "doc_id", query: str = "query_id", query_text: str = "query_text"
) -> DataFrame:
    """As ``bm25_topk``, over documents that are indexed already; corpora without a ``k`` are left out."""
    terms = materialize(query_terms(_addressed(queries, k), query, query_text), "query-terms")
    return _shown(Search(index, terms, k), doc, query)


def _shown(search: Search, doc: str, query: str) -> DataFrame:
    return search.top().select("corpus", F.col("query").alias(query), "rank", F.col("doc").alias(doc), "score")


def rerank(
    candidates: DataFrame,
    query: str = "query_id",
    priorities: str = "priorities",
    name: str = "name",
    keywords: str = "keywords",
    everything: str = "everything",
) -> DataFrame:
    """One candidate per query: the best by an ordered list of priority words.

    A candidate whose name contains a priority, or the reverse, wins, earliest priority
    first. Failing that, words count by where they occur, and without any hit rank 1 stays.
    """
    words = F.transform(F.coalesce(priorities, F.array().cast("array<string>")), lambda p: F.lower(F.trim(p)))
    low_name, low_keys = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(keywords, F.lit("")))
    low_all = F.lower(F.coalesce(everything, F.lit("")))
    match = F.array_position(
        F.transform(words, lambda p: low_name.contains(p) | p.contains(low_name)), True
    )
    points = F.aggregate(
        words,
        F.lit(0),
        lambda acc, p: acc
        + F.when(low_name.contains(p), RERANK_WEIGHTS["name"])
        .when(low_keys.contains(p), RERANK_WEIGHTS["keywords"])
        .when(low_all.contains(p), RERANK_WEIGHTS["other"])
        .otherwise(0),
    )
    scored = candidates.withColumn("_m", F.nullif(match, F.lit(0))).withColumn("match_score", points)
    never = F.lit(9223372036854775807)
    order = F.struct(F.coalesce("_m", never), -F.col("match_score"), "rank")
    kept = [c for c in candidates.columns if c != query]
    return (
        scored.groupBy(query)
        .agg(F.min_by(F.struct(*kept, "match_score"), order).alias("_best"))
        .select(query, "_best.*")
    )
