"""Rule lookup and keyword classification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.fixed_values import (
    DEFAULT_PAGE_TYPE,
    DEFAULT_RULE,
    DEFAULT_TOPIC,
    PAGE_TYPE_HINTS,
    PAGE_TYPES,
    TOPIC_KEYWORDS,
)
from daybook.functions.text import contains_any, count_contained


def _pieces(text: str, n: int) -> Column:
    """Every substring of length ``n``."""
    if n == 0:
        return F.array(F.lit(""))
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    pieces = F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(n)))
    return F.when(F.length(text) >= n, pieces).otherwise(F.array().cast("array<string>"))


def contained_terms(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Join every text with the terms that occur in it.

    Containment becomes equality: a text offers its substrings of the lengths that terms
    have, once each, and these meet the terms in an ordinary join. Meant for short texts
    such as labels and merchants; pass distinct texts.
    """
    found = terms.select(F.length(term).alias("n")).filter("n is not null").distinct().collect()
    pieces = F.array_distinct(F.flatten(F.array(*[_pieces(text, r["n"]) for r in found])))
    if not found:
        pieces = F.array().cast("array<string>")
    offered = texts.withColumn("_pieces", pieces).select(
        *texts.columns, F.explode_outer("_pieces").alias(term)
    )
    return offered.join(terms, term)


def tiered_lookup(items: DataFrame, item: str, rules: DataFrame, label: str = "label") -> DataFrame:
    """Best rule of each item: equal label, else one contains the other, else a label keyword.

    ``rules`` has ``rule_no``, which breaks ties, and a label. Adds ``rule_no`` and ``tier``
    (1-3); both are NULL where no rule applies.
    """
    wanted = items.select(F.lower(F.col(item)).alias("_item")).filter("_item is not null").distinct()
    labels = rules.select("rule_no", F.lower(F.col(label)).alias("_label"))
    words = F.filter(F.split("_label", r"[/\-\s]+"), lambda w: w != "")
    needles = (
        labels.select(F.explode(words).alias("_needle"), F.lit(3).alias("tier"), "rule_no")
        .unionByName(labels.select(F.col("_label").alias("_needle"), F.lit(2).alias("tier"), "rule_no"))
        .groupBy("_needle")
        .agg(F.min(F.struct("tier", "rule_no")).alias("_r"))
    )
    tier = F.when((F.col("_r.tier") == 2) & (F.col("_item") == F.col("_needle")), 1).otherwise(F.col("_r.tier"))
    inside_item = contained_terms(wanted, "_item", needles, "_needle").select(
        "_item", tier.alias("tier"), F.col("_r.rule_no").alias("rule_no")
    )
    one_label = labels.groupBy("_label").agg(F.min("rule_no").alias("rule_no"))
    inside_label = contained_terms(one_label, "_label", wanted, "_item").select(
        "_item", F.lit(2).alias("tier"), "rule_no"
    )
    best = (
        inside_item.unionByName(inside_label)
        .groupBy("_item")
        .agg(F.min(F.struct("tier", "rule_no")).alias("_b"))
        .select("_item", "_b.tier", "_b.rule_no")
    )
    return (
        items.withColumn("_item", F.lower(F.col(item))).join(best, "_item", "left").drop("_item")
    )


def apply_rule(looked_up: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach the fields of the looked-up rule; items without a rule get the default record.

    The style priority is a list, the decision rules a map (empty if their JSON is bad).
    """
    own = rules.select(
        "rule_no",
        F.lit(True).alias("_has_rule"),
        F.coalesce("pattern", F.lit("")).alias("pattern"),
        F.transform(
            F.split(F.coalesce("style_priority", F.lit("")), r"\+"), lambda s: F.trim(s)
        ).alias("style_priority"),
        F.coalesce("color_mood", F.lit("")).alias("color_mood"),
        F.coalesce("typography_mood", F.lit("")).alias("typography_mood"),
        F.coalesce("key_effects", F.lit("")).alias("key_effects"),
        F.coalesce("anti_patterns", F.lit("")).alias("anti_patterns"),
        F.from_json("decision_rules", "map<string,string>").alias("decision_rules"),
        F.coalesce("severity", F.lit(DEFAULT_RULE["severity"])).alias("severity"),
    )
    joined = looked_up.join(own, "rule_no", "left")
    has_rule = F.col("_has_rule").isNotNull()

    def default(name: str) -> Column:
        value = DEFAULT_RULE[name]
        literal = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
        return F.when(has_rule, F.col(name)).otherwise(literal).alias(name)

    empty = F.create_map().cast("map<string,string>")
    return joined.select(
        *looked_up.columns,
        *[default(n) for n in DEFAULT_RULE],
        F.coalesce("decision_rules", empty).alias("decision_rules"),
    )


def topic(text: Column, keywords: Mapping[str, Sequence[str]] = TOPIC_KEYWORDS, default: str = DEFAULT_TOPIC) -> Column:
    """Topic with the most keywords in the text; ties to the earlier one, default if none."""

    def best(lower: Column) -> Column:
        scores = [F.struct(F.lit(0).alias("n"), F.lit(1).alias("p"), F.lit(default).alias("t"))]
        for i, (name, words) in enumerate(keywords.items()):
            n = count_contained(lower, words)
            scores.append(F.struct(n.alias("n"), F.lit(-i).alias("p"), F.lit(name).alias("t")))
        return F.array_max(F.array(*scores))["t"]

    # The lambda binds the lowered text once for all keywords.
    return F.get(F.transform(F.array(F.lower(text)), best), F.lit(0))


def page_type(context: Column, best_for: Column | None = None) -> Column:
    """First page type with a keyword in the context, else a hint from the best style."""
    lower = F.lower(context)
    result = F.lit(DEFAULT_PAGE_TYPE)
    if best_for is not None:
        for words, label in reversed(PAGE_TYPE_HINTS):
            hint = F.coalesce(contains_any(F.lower(best_for), words), F.lit(False))
            result = F.when(hint, F.lit(label)).otherwise(result)
    for words, label in reversed(PAGE_TYPES):
        result = F.when(contains_any(lower, words), F.lit(label)).otherwise(result)
    return result
