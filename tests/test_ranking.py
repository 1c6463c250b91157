"""BM25, lookup and reranking against plain Python written here."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from daybook.fixed_values import DEFAULT_ADVICE
from daybook import session
from daybook.operators import postings, ranking, rules
from daybook.plans import recommend
from daybook.sources import catalogs


def words(text):
    return [w for w in re.sub(r"[^\w\s]", " ", text.lower()).split() if len(w) > 2]


def brute_bm25(docs, query, k, k1=1.5, b=0.75):
    bags = [Counter(words(t)) for _, t in docs]
    lengths = [sum(c.values()) for c in bags]
    mean = sum(lengths) / len(docs)
    df = Counter(w for c in bags for w in c)
    scored = []
    for (i, _), bag, n in zip(docs, bags, lengths):
        score = 0.0
        for w in words(query):
            if bag[w]:
                gain = math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1)
                score += gain * bag[w] * (k1 + 1) / (bag[w] + k1 * (1 - b + b * n / mean))
        scored.append((-round(score, 6), i))
    return [(i, -s) for s, i in sorted(scored)[:k] if s < 0]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = ["alpha", "beta", "gamma", "delta", "été", "x_1", "of", "a", "the", "omega"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) + ".") for i in range(60)]
    queries = [(100 + i, " ".join(rng.choices([*vocabulary, "unknown"], k=rng.randint(1, 8)))) for i in range(12)]
    return docs, queries


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_bm25_equals_brute_force(spark, corpus, broadcast):
    docs, queries = corpus
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    got = ranking.bm25_topk(
        spark.createDataFrame(docs, "doc_id int, text string"),
        spark.createDataFrame(queries, "query_id int, query_text string"), 5).collect()
    for q, text in queries:
        mine = [(r.doc_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        want = brute_bm25(docs, text, 5)
        assert [i for i, _ in mine] == [i for i, _ in want]
        assert [s for _, s in mine] == pytest.approx([s for _, s in want], abs=2e-6)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


def test_a_word_that_all_documents_have_still_counts(spark):
    docs = spark.range(2_000_000).select(F.col("id").alias("doc_id"), F.lit("common word").alias("text"))
    queries = spark.createDataFrame([(1, "common")], "query_id int, query_text string")
    got = ranking.bm25_topk(docs, queries, 3).collect()
    assert [(r.doc_id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1), (1, 2), (2, 3)]
    assert all(0 < r.score < 1e-6 for r in got)


def test_searching_reads_the_index_alone(spark, corpus):
    """An index outlives its documents and serves any number of searches."""
    docs, queries = corpus
    index = postings.PostingIndex.build(spark.createDataFrame([("all", *r) for r in docs], "corpus string, doc_id int, text string"))
    for some in (queries[:5], queries[5:]):
        got = ranking.search_topk(index, spark.createDataFrame(some, "query_id int, query_text string"), 4).collect()
        for q, text in some:
            mine = [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
            assert mine == [i for i, _ in brute_bm25(docs, text, 4)]


def search_of(spark, docs, queries, k):
    index = postings.PostingIndex.build(docs.withColumn("corpus", F.lit("all")))
    terms = postings.query_terms(queries.withColumn("corpus", F.lit("all")))
    return postings.Search(index, session.materialize(terms, "terms"), k)


def test_pruned_search_equals_the_whole_one_and_reads_less(spark):
    """One word in all documents, one in every fifth, and words of a few documents each."""
    n = F.xxhash64("id")
    words = F.concat_ws(" ", F.lit("common"), F.when(n % 5 == 0, "fifth"), F.concat(F.lit("rare"), F.pmod(n, F.lit(3_000)).cast("string")))
    filler = F.array_join(F.transform(F.sequence(F.lit(1), F.pmod(n, F.lit(7)).cast("int") + 1), lambda i: F.lit("filling")), " ")
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words, filler).alias("text"))
    queries = spark.createDataFrame([(i, f"common fifth rare{7 * i} common") for i in range(8)] + [(90, "fifth common"), (91, "unknown"), (92, "")], "query_id int, query_text string")
    search = search_of(spark, docs, queries, 3)
    got, want = (sorted((r["query"], r["rank"], r.doc, round(r.score, 12)) for r in search.top(x).collect()) for x in (True, False))
    assert got == want and len(got) == 27
    chosen = search.reachable().filter("query < 90").cache()
    looked = search._gains(chosen.filter("essential")).count()
    assert looked * 10 <= search._gains(search.everything().filter("query < 90")).count()


@pytest.mark.parametrize("block_bits", [0, 3])
def test_bounds_are_reached_and_nobody_is_lost(spark, corpus, monkeypatch, block_bits):
    monkeypatch.setattr(postings, "BLOCK_BITS", block_bits)
    docs, queries = corpus
    docs = docs + [(7, docs[3][1]), (None, docs[4][1]), (80, ""), (81, None)]  # a repeated id, no id, no text
    search = search_of(spark, spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(queries, "query_id int, query_text string"), 4)
    got, want = (sorted(((r["query"], r["rank"], r.doc, round(r.score, 10)) for r in search.top(x).collect()), key=str) for x in (True, False))
    assert got == want
    last = {r["query"]: r.score for r in search.top(False).filter("rank = 4").collect()}
    for r in search.bounds().collect():
        assert r.bound <= last[r["query"]] * (1 + 1e-9)


def test_each_corpus_on_its_own(spark, corpus):
    docs, queries = corpus
    rows = [("odd" if i % 2 else "even", i, t) for i, t in docs]
    got = ranking.bm25_topk(
        spark.createDataFrame(rows, "corpus string, doc_id int, text string"),
        spark.createDataFrame(queries, "query_id int, query_text string"), {"odd": 1, "even": 3, "none": 2}).collect()
    assert {r.corpus for r in got} == {"odd", "even"}
    for name, k in (("odd", 1), ("even", 3)):
        part = [(i, t) for c, i, t in rows if c == name]
        for q, text in queries:
            mine = [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if (r.corpus, r.query_id) == (name, q)]
            assert mine == [i for i, _ in brute_bm25(part, text, k)]


def brute_tier(item, labels):
    item = item.lower()
    for tier in (1, 2, 3):
        for number, label in labels:
            low = label.lower()
            hit = {
                1: low == item,
                2: low in item or item in low,
                3: any(w in item for w in low.replace("/", " ").replace("-", " ").split()),
            }[tier]
            if hit:
                return number, tier
    return None, None


def test_tiered_lookup_equals_brute_force(spark):
    rng = random.Random(3)
    parts = ["shop", "Online", "cafe", "e-com", "bar", "Food/Drink", "in", "art"]
    labels = [(n, rng.choice([" ", "-", "/"]).join(rng.sample(parts, rng.randint(1, 3)))) for n in range(12)]
    items = [" ".join(rng.sample([*parts, "zoo", "line", "hop"], rng.randint(1, 3))) for _ in range(40)] + ["FOOD/DRINK", "zzz", "o"]
    got = rules.tiered_lookup(
        spark.createDataFrame([(i,) for i in items], "item string"), "item",
        spark.createDataFrame(labels, "rule_no int, label string"))
    for r in got.collect():
        assert (r.rule_no, r.tier) == brute_tier(r["item"], labels), r["item"]


def test_topic(spark):
    rows = ["best color palette", "React memo bundle", "nothing", "bar serif", "UX"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r.x for r in df.select(rules.topic(F.col("t")).alias("x")).collect()] == ["color", "react", "style", "chart", "ux"]


def test_page_type(spark):
    df = spark.createDataFrame([("My Cart page", None), ("zzz", "Landing sites"), ("zzz", None), ("Login data", "x")], "c string, b string")
    got = [r.x for r in df.select(rules.page_type(F.col("c"), F.col("b")).alias("x")).collect()]
    assert got == ["Checkout / Payment", "Landing / Marketing", "General", "Dashboard / Data View"]


def candidates(spark, priorities, rows):
    return spark.createDataFrame(
        [(1, rank, name, keys, other, priorities) for rank, name, keys, other in rows],
        "query_id int, rank int, name string, keywords string, everything string, priorities array<string>")


@pytest.mark.parametrize(
    "priorities, rank",
    [(["Flat", "Glass"], 2), (["glass"], 1), (["dense grid"], 2), (["soft"], 3), (["nope"], 1), ([], 1), (None, 1)],
)
def test_rerank(spark, priorities, rank):
    rows = [(1, "Glassmorphism", "blur", "x"), (2, "Flat Design", "dense grid", "y"), (3, "Plain", "none", "soft touch")]
    assert ranking.rerank(candidates(spark, priorities, rows)).first()["rank"] == rank


def test_rule_defaults_and_bad_json(spark):
    table = spark.createDataFrame(
        [(1, "shop", "P", "A + B ", None, "t", "k", "a", "{oops", None), (2, "cafe", "Q", "C", "m", "t", "k", "a", '{"x": "1"}', "LOW")],
        "rule_no int, label string, pattern string, style_priority string, color_mood string, typography_mood string, "
        "key_effects string, anti_patterns string, decision_rules string, severity string")
    items = spark.createDataFrame([("shop",), ("cafe",), ("zoo",)], "item string")
    got = {r["item"]: r for r in rules.apply_rule(rules.tiered_lookup(items, "item", table), table).collect()}
    assert (got["shop"].style_priority, got["shop"].decision_rules, got["shop"].severity) == (["A", "B"], {}, "MEDIUM")
    assert (got["cafe"].decision_rules, got["cafe"].severity) == ({"x": "1"}, "LOW")
    assert (got["zoo"].style_priority, got["zoo"].pattern) == (["Minimalism", "Flat Design"], "Hero + Features + CTA")


DOCS = [
    ("product", 1, "online shop cart", {"Product Type": "shop"}),
    ("product", 2, "medical clinic", {"Product Type": "clinic"}),
    ("color", 3, "shop colours", {"Primary (Hex)": "#111111", "Notes": ""}),
    ("landing", 4, "cart landing", {"Pattern Name": "Long page", "Section Order": "A > B", "Primary CTA Placement": "Top"}),
    ("style", 5, "online bold dense", {"Style Category": "Bold", "Keywords": "data grid", "Effects & Animation": "Pop", "Best For": "dashboard"}),
    ("style", 6, "online online Flat", {"Style Category": "Flat", "Keywords": "plain", "Effects & Animation": ""}),
    ("ux", 7, "online forms", {"Category": "Forms", "Do": "Label them", "Don't": "Hide labels"}),
]


def test_recommendation_and_overrides(spark):
    docs = spark.createDataFrame(DOCS, "corpus string, doc_id int, text string, record map<string,string>")
    table = spark.createDataFrame(
        [(1, "shop", "Rule pattern", "Bold + Loud", "m", "Sans", "glow", "clutter", "{}", "HIGH")],
        "rule_no int, label string, pattern string, style_priority string, color_mood string, typography_mood string, "
        "key_effects string, anti_patterns string, decision_rules string, severity string")
    queries = spark.createDataFrame([(1, "online shop cart"), (2, "zebra")], "query_id int, query_text string")
    got = {r.query_id: r for r in recommend.recommend(queries, docs, table).collect()}
    one, two = got[1], got[2]
    assert (one.category, one.pattern_name, one.style_name, one.color_primary) == ("shop", "Long page", "Bold", "#111111")
    assert (one.key_effects, one.font_mood, one.font_heading, one.severity) == ("Pop", "Sans", "Inter", "HIGH")
    # Without a rule the style search still adds the default priorities, which "Flat" meets.
    assert (two.category, two.pattern_name, two.style_name, two.color_primary) == ("General", "Hero + Features + CTA", "Flat", "#2563EB")
    assert (two.project_name, two.key_effects, two.severity) == ("ZEBRA", "Subtle hover transitions", "MEDIUM")

    pages = spark.createDataFrame([(1, "bold dense online cart"), (2, "zebra")], "query_id int, query_text string")
    over = {r.query_id: r for r in recommend.page_overrides(pages, docs).collect()}
    assert over[1].page_type == "Checkout / Payment" and over[1].max_width == "1400px or full-width"
    assert over[1].recommendations == ["Effects: Pop", "Forms: Label them", "CTA Placement: Top"]
    assert over[1].components == ["Avoid: Hide labels"] and over[1].sections == "A > B"
    assert (over[2].page_type, over[2].max_width, over[2].recommendations) == (
        "General", "1200px", DEFAULT_ADVICE)


def test_catalog_files(spark, tmp_path):
    (tmp_path / "stacks").mkdir()
    (tmp_path / "charts.csv").write_text('No,Data Type,Keywords,Best Chart Type\n1,Trend,"line, ""time""",Line\n2,Share,pie,Pie\n')
    (tmp_path / "stacks" / "vue.csv").write_text("Category,Guideline,Do\nState,Use refs,ref()\n")
    docs = catalogs.read_catalogs(spark, str(tmp_path))
    assert [(r.corpus, r.text) for r in docs.orderBy("corpus", "doc_id").collect()] == [
        ("chart", 'Trend line, "time" Line'), ("chart", "Share pie Pie"), ("stack:vue", "State Use refs ref()")]
    asked = spark.createDataFrame([(1, "pie chart"), (2, "trend line"), (3, "dark mode")], "query_id int, query_text string")
    found = {r.query_id: r.record["Best Chart Type"] for r in recommend.search(asked, docs).collect()}
    assert found == {1: "Pie", 2: "Line"}
    named = spark.createDataFrame([(1, "refs", "stack:vue")], "query_id int, query_text string, corpus string")
    assert recommend.search(named, docs, 1).first().record["Guideline"] == "Use refs"
    (tmp_path / "rules.csv").write_text(
        "No,UI_Category,Recommended_Pattern,Style_Priority,Color_Mood,Typography_Mood,Key_Effects,Decision_Rules,Anti_Patterns,Severity\n"
        '1,Shop,P,A + B,m,t,k,"{""must"": ""x""}",a,HIGH\n')
    table = catalogs.read_rules(spark, str(tmp_path / "rules.csv"))
    items = spark.createDataFrame([("Web Shop",)], "item string")
    (row,) = rules.apply_rule(rules.tiered_lookup(items, "item", table), table).collect()
    assert (row.tier, row.style_priority, row.decision_rules) == (2, ["A", "B"], {"must": "x"})


def moves_of_postings(df):
    """Shuffles in the plan of ``df`` below which term counts are read."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    open_, moved = [], 0
    for line in plan.splitlines():
        open_ = [d for d in open_ if d < depth(line)]
        if " Exchange " in line or line.lstrip(" :+-").startswith("Exchange "):
            open_.append(depth(line))
        moved += bool(open_) and "FileScan" in line and "tf#" in line
    return moved


def test_a_search_does_not_move_postings(spark, monkeypatch):
    """Only the hits and what is looked for are shuffled, with no table small enough to be copied."""
    plans = {}

    def written(df, label, *column):
        plans[label] = moves_of_postings(df)
        return (session.materialize_in_buckets if column else session.materialize)(df, label, *column)

    monkeypatch.setattr(postings, "materialize", written)
    monkeypatch.setattr(postings, "materialize_in_buckets", written)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(5_000).select("id", F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("word"), F.col("id") % 700)).alias("text"))
        queries = spark.createDataFrame([(1, "common word5 word9"), (2, "word11")], "query_id int, query_text string")
        got = ranking.bm25_topk(docs, queries, 2).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got) == [(1, 1, 5), (1, 2, 9), (2, 1, 11), (2, 2, 711)]
    assert plans["posting-blocks"] == plans["query-candidates"] == 0
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("term_counts", "posting_blocks", "query_"))]


@pytest.mark.parametrize("copied", [0, 200_000])
def test_terms_that_are_too_many_to_copy_are_shuffled(spark, corpus, monkeypatch, copied):
    monkeypatch.setattr(postings, "COPIED_TERMS", copied)
    docs, queries = corpus
    got = ranking.bm25_topk(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(queries, "query_id int, query_text string"), 5).collect()
    for q, text in queries:
        assert [r.doc_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [i for i, _ in brute_bm25(docs, text, 5)]


def test_recommendations_index_only_words_that_can_be_asked_for(spark, monkeypatch):
    indexes, build = [], postings.PostingIndex.build
    monkeypatch.setattr(postings.PostingIndex, "build", lambda *a, **k: indexes.append(build(*a, **k)) or indexes[-1])
    docs = spark.createDataFrame([(c, i, t + " filler padding", r) for c, i, t, r in DOCS], "corpus string, doc_id int, text string, record map<string,string>")
    table = spark.createDataFrame(
        [(1, "shop", "P", "Bold+Loud + Dense", "m", "Sans", "glow", "clutter", "{}", "HIGH")],
        "rule_no int, label string, pattern string, style_priority string, color_mood string, typography_mood string, "
        "key_effects string, anti_patterns string, decision_rules string, severity string")
    queries = spark.createDataFrame([(1, "shop cart"), (2, "zebra"), (3, None)], "query_id int, query_text string")
    got = {r.query_id: (r.category, r.style_name) for r in recommend.recommend(queries, docs, table).collect()}
    assert got == {1: ("shop", "Bold"), 2: ("General", "Flat"), 3: ("General", "Flat")}
    (index,) = indexes
    assert {r.term for r in index.postings.select("term").distinct().collect()} == {"shop", "cart", "bold", "dense", "flat"}
