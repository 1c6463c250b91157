"""Recommendations in batch: category, rule, and the best document of each corpus per query."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.fixed_values import (
    CATALOGS,
    CORPUS_K,
    DEFAULT_ADVICE,
    DEFAULT_CATEGORY,
    DEFAULT_RULE,
    LAYOUT_CLASSES,
    PLAIN_LAYOUT,
    RECOMMENDATION_PARTS,
    SEARCH_K,
    STACKS,
    STANDARD_LAYOUT,
)
from daybook.functions.text import contains_any, tokens
from daybook.operators.postings import PostingIndex
from daybook.operators.ranking import bm25_topk, rerank, search_topk
from daybook.operators.rules import apply_rule, page_type, tiered_lookup, topic
from daybook.session import materialize


def search(queries: DataFrame, docs: DataFrame, k: int = SEARCH_K) -> DataFrame:
    """Best documents per query, in the query's ``corpus`` or else the one its words suggest."""
    if "corpus" not in queries.columns:
        queries = queries.withColumn("corpus", topic(F.col("query_text")))
    corpora = [c for c in CATALOGS] + [f"stack:{s}" for s in STACKS]
    return with_documents(bm25_topk(docs, queries, dict.fromkeys(corpora, k)), docs)


def _top(hits: DataFrame, corpus: str, fields: Mapping[str, str]) -> DataFrame:
    """Fields of the first hit of one corpus per query."""
    first = hits.filter((F.col("corpus") == corpus) & (F.col("rank") == 1))
    return first.select("query_id", *[F.col("record")[c].alias(name) for name, c in fields.items()])


def with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits, a few rows per query, with the records of their documents."""
    return hits.join(docs.drop("text"), ["corpus", "doc_id"])


def _tops(hits: DataFrame, corpora: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """One row per query: fields of the first hit of each corpus, hits read once."""
    firsts = {c: F.max(F.when((F.col("corpus") == c) & (F.col("rank") == 1), F.to_json("record"))) for c in corpora}
    rows = hits.groupBy("query_id").agg(*[e.alias(f"_{c}") for c, e in firsts.items()])
    records = rows.select("query_id", *[F.from_json(f"_{c}", "map<string,string>").alias(f"_{c}") for c in corpora])
    fields = [F.col(f"_{c}")[column].alias(name) for c, of in corpora.items() for name, column in of.items()]
    return records.select("query_id", *fields)


def _fields(corpus: str) -> dict[str, str]:
    return {name: c for name, (of, c, _) in RECOMMENDATION_PARTS.items() if of == corpus}


def recommend(queries: DataFrame, docs: DataFrame, rules: DataFrame) -> DataFrame:
    """One record per query, defaults where a corpus has no hit or no rule applies.

    ``queries``: query_id, query_text. ``docs``: corpus, doc_id, text, record (a map of
    catalog columns). ``rules`` as for ``apply_rule``. The style search adds the first two
    style priorities of the rule to the query, so it runs after the others.
    """
    plain = {c: k for c, k in CORPUS_K.items() if c != "style"}
    # The words of both searches: a style search adds none but those of some rule's priorities, or of the defaults.
    defaults = F.array_join(F.array(*map(F.lit, DEFAULT_RULE["style_priority"])), " ")
    texts = queries.select(F.concat_ws(" ", "query_text", defaults).alias("text")).union(rules.select("style_priority"))
    asked = texts.select(F.explode(tokens(F.col("text"))).alias("term"))
    index = PostingIndex.build(docs.filter(F.col("corpus").isin(list(CORPUS_K))), terms=asked)
    hits = with_documents(search_topk(index, queries, plain), docs)
    parts = {"product": {"category": "Product Type"}, **{c: _fields(c) for c in ("landing", "color", "typography")}}
    # One row per query, which the rule lookup and the result both read.
    category = (
        queries.select("query_id", "query_text")
        .join(_tops(hits, parts), "query_id", "left")
        .withColumn("category", F.coalesce("category", F.lit(DEFAULT_CATEGORY)))
    )
    # Written once: the style search and both of its joins read it.
    ruled = materialize(apply_rule(tiered_lookup(category, "category", rules), rules), "ruled")

    priority = F.concat_ws(" ", F.slice("style_priority", 1, 2))
    style_query = ruled.select("query_id", F.concat_ws(" ", "query_text", priority).alias("query_text"))
    style_hits = with_documents(search_topk(index, style_query, {"style": CORPUS_K["style"]}), docs)
    best = rerank(
        style_hits.select(
            "query_id",
            "rank",
            "record",
            F.col("record")["Style Category"].alias("name"),
            F.col("record")["Keywords"].alias("keywords"),
            F.concat_ws(" ", F.map_keys("record"), F.map_values("record")).alias("everything"),
        ).join(ruled.select("query_id", F.col("style_priority").alias("priorities")), "query_id")
    )
    style = best.select("query_id", *[F.col("record")[c].alias(n) for n, c in _fields("style").items()])

    joined = ruled.join(style, "query_id", "left")
    fallback = {"pattern_name": F.col("pattern"), "font_mood": F.col("typography_mood")}
    return joined.select(
        "query_id",
        F.upper("query_text").alias("project_name"),
        "category",
        *[
            F.coalesce(name, fallback.get(name, F.lit(default))).alias(name)
            for name, (_, _, default) in RECOMMENDATION_PARTS.items()
        ],
        F.coalesce(F.nullif("style_effects", F.lit("")), "key_effects").alias("key_effects"),
        "anti_patterns",
        "decision_rules",
        "severity",
    )


def page_overrides(pages: DataFrame, docs: DataFrame, k: Mapping[str, int] | None = None) -> DataFrame:
    """Layout, density and recommendations per page, from its own ranked hits.

    ``pages``: query_id, query_text. ``docs`` as for ``recommend``, with the corpora style,
    ux and landing.
    """
    depth = dict(k or {"style": 1, "ux": 3, "landing": 1})
    hits = with_documents(bm25_topk(docs, pages, depth), docs)
    style_fields = {"style_keywords": "Keywords", "style_effects": "Effects & Animation", "best_for": "Best For"}
    style = _top(hits, "style", style_fields).withColumn("_has_style", F.lit(True))
    landing = _top(
        hits,
        "landing",
        {"sections": "Section Order", "placement": "Primary CTA Placement", "color_strategy": "Color Strategy"},
    )
    said_of = lambda column: F.nullif(F.col("record")[column], F.lit(""))
    said = F.sort_array(
        F.collect_list(
            F.struct(
                "rank",
                F.concat(F.col("record")["Category"], F.lit(": "), said_of("Do")).alias("do"),
                F.concat(F.lit("Avoid: "), said_of("Don't")).alias("avoid"),
            )
        )
    )
    ux = hits.filter(F.col("corpus") == "ux").groupBy("query_id").agg(said.alias("_ux"))
    keywords = F.lower(F.coalesce("style_keywords", F.lit("")))
    width, layout = map(F.lit, STANDARD_LAYOUT)
    density = F.lit(None).cast("string")
    for words, wide, grid, dense in reversed(LAYOUT_CLASSES):
        hit = contains_any(keywords, words)
        width = F.when(hit, F.lit(wide)).otherwise(width)
        layout = F.when(hit, F.lit(grid)).otherwise(layout)
        density = F.when(hit, F.lit(dense)).otherwise(density)
    has_style = F.col("_has_style").isNotNull()
    sections = F.nullif("sections", F.lit(""))
    # Without a style and without sections there is no layout at all, hence a plain one.
    plain_width, plain_layout = [F.when(sections.isNull(), F.lit(v)) for v in PLAIN_LAYOUT]
    notes = F.concat(
        F.array(F.concat(F.lit("Effects: "), F.nullif("style_effects", F.lit("")))),
        F.coalesce(F.transform("_ux", lambda u: u["do"]), F.array().cast("array<string>")),
        F.array(F.concat(F.lit("CTA Placement: "), F.nullif("placement", F.lit("")))),
    )
    avoid = F.coalesce(F.transform("_ux", lambda u: u["avoid"]), F.array().cast("array<string>"))
    advice, no_advice = F.array_compact(notes), F.array(*map(F.lit, DEFAULT_ADVICE))
    joined = pages.select("query_id", "query_text")
    for part in (style, ux, landing):
        joined = joined.join(part, "query_id", "left")
    return joined.select(
        "query_id",
        page_type(F.col("query_text"), F.col("best_for")).alias("page_type"),
        F.when(has_style, width).otherwise(plain_width).alias("max_width"),
        F.when(has_style, layout).otherwise(plain_layout).alias("layout"),
        F.when(has_style, density).alias("density"),
        sections.alias("sections"),
        F.nullif("color_strategy", F.lit("")).alias("color_strategy"),
        F.when(F.size(advice) > 0, advice).otherwise(no_advice).alias("recommendations"),
        F.array_compact(avoid).alias("components"),
    )
