"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into one of at most ``BINS`` bins and the model is a sum of lookup
tables, one per feature and one per chosen pair, over those bins. Boosting goes round the
features in turn: each step fits a shallow tree to the current residuals of one feature and
adds a small part of it to that feature's table. Pairs follow in the same way on a coarse grid,
those first whose grid explains most of what is left. Scoring is an addition of table entries.

The tables are fitted on the driver on a sample of at most ``fit_rows`` labelled rows, taken by
the hash of the id. Features of those rows, a few numbers each, are all that reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import arrow_strings, crc32_mod, map_batches, table

FIT_ROWS = 20_000
BINS = 32
COARSE = 8
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 40
LEAVES = 4
RATE = 0.15
SMOOTH = 5.0
THRESHOLD = 0.3

FEATURES = (
    "words", "mean_word", "longest_word", "distinct_words", "commonest_word", "repeats", "short_words", "lines",
    "distinct_lines", "words_a_line", "letters", "capitals", "digits", "stops", "bars", "marks", "brackets",
    "symbols", "beyond_ascii", "symbol_ends", "single_distinct",
)

_CLASS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b"|", b",;:!?'\"-", b"()[]{}<>", b"#$%&*+/=@\\^_`~"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 9
_SYMBOLS = "#$%&*+/=@\\^_`~|"


def features(text: str) -> list[float]:
    """The numbers of one text, whole; an empty text has zeros."""
    words = text.split()
    n = max(1, len(words))
    lengths = list(map(len, words))
    counts = Counter(words)
    lines = text.split("\n")
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    kinds = np.bincount(_CLASS, weights=np.bincount(raw, minlength=256), minlength=10) / max(1, len(raw))
    return [
        float(np.log1p(len(words))),
        sum(lengths) / n,
        float(max(lengths, default=0)),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        sum(x < 3 for x in lengths) / n,
        float(np.log1p(len(lines))),
        len(set(lines)) / len(lines),
        n / len(lines),
        kinds[1],
        kinds[2] / max(1e-9, kinds[1] + kinds[2]),
        kinds[3],
        kinds[4],
        kinds[5],
        kinds[6],
        kinds[7],
        kinds[8],
        kinds[9],
        sum(w[-1] in _SYMBOLS for w in words) / n,
        sum(v == 1 for v in counts.values()) / n,
    ]


def with_features(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """The ``keep`` columns and ``features`` (array of double) of every row, null texts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t) for t in arrow_strings(b.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(rows, pa.list_(pa.float64()))], [*keep, "features"])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_column}`").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_batches(chosen, run, ", ".join(x for x in (schema, "features array<double>") if x))


@dataclass
class Gam:
    """Intercept, bin edges and tables; pairs hold two features and their coarse edges."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for j, (edges, tab) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += tab[np.searchsorted(edges, x[:, j], side="right")]
        for i, j, tab in self.pairs:
            a = np.searchsorted(self.coarse[i], x[:, i], side="right")
            b = np.searchsorted(self.coarse[j], x[:, j], side="right")
            out += tab[a, b]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x), -35.0, 35.0)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of a tree over ordered bins: the best cut first, up to ``leaves`` leaves."""
    gain = lambda a, b: a * a / (b + SMOOTH)
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for lo, hi in parts:
            if hi - lo < 2:
                continue
            at = np.arange(lo + 1, hi)
            left = gain(cg[at] - cg[lo], ch[at] - ch[lo])
            right = gain(cg[hi] - cg[at], ch[hi] - ch[at])
            found = left + right - gain(cg[hi] - cg[lo], ch[hi] - ch[lo])
            k = int(np.argmax(found))
            if found[k] > best[0]:
                best = (found[k], (lo, hi), lo + 1 + k)
        if best[1] is None:
            break
        lo, hi = best[1]
        parts.remove((lo, hi))
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + SMOOTH)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of one axis, then the best cut of the other axis on either side."""
    best, out = 0.0, np.zeros_like(g)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, len(a)):
            made, total = np.zeros_like(a), 0.0
            for lo, hi in ((0, cut), (cut, len(a))):
                step = _tree(a[lo:hi].sum(0), b[lo:hi].sum(0), 2)
                made[lo:hi] = step
                total += float((step * a[lo:hi].sum(0)).sum())
            if total > best:
                best, out = total, (made if axis == 0 else made.T)
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """The model of rows ``x`` with 0/1 labels ``y``; without rows every text scores one half."""
    if not len(y):
        return Gam()
    x = np.asarray(x, dtype=float).reshape(len(y), -1)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    width = x.shape[1]
    model = Gam(float(np.log(share / (1 - share))), [_edges(x[:, j], BINS) for j in range(width)])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [_edges(x[:, j], COARSE) for j in range(width)]
    bins = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(width)]
    logit = np.full(len(y), model.intercept)

    def residuals():
        p = 1.0 / (1.0 + np.exp(-np.clip(logit, -35.0, 35.0)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            r, w = residuals()
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], r, size), np.bincount(bins[j], w, size), LEAVES)
            model.tables[j] += step
            logit += step[bins[j]]
    coarse = [np.searchsorted(model.coarse[j], x[:, j], side="right") for j in range(width)]

    def grid(i, j, r, w):
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        n = shape[0] * shape[1]
        return cell, np.bincount(cell, r, n).reshape(shape), np.bincount(cell, w, n).reshape(shape)

    r, w = residuals()
    gains = []
    for i in range(width):
        for j in range(i + 1, width):
            _, g, h = grid(i, j, r, w)
            gains.append((float((g * g / (h + SMOOTH)).sum()), i, j))
    model.pairs = [(i, j, np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, tab in model.pairs:
            cell, g, h = grid(i, j, *residuals())
            _, step = _grid_tree(g, h)
            tab += RATE * step
            logit += RATE * step.ravel()[cell]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS, learn: Column | None = None) -> Gam:
    """Fit on at most ``fit_rows`` documents that ``labels`` marks and ``learn`` admits.

    Rows with a null id or label teach nothing. A document labelled more than once counts as 1
    only if all its labels are 1. The chosen ids number ``fit_rows`` at most, which bounds their broadcast.
    """
    marked = labels.select("doc_id", F.col(label).cast("int").alias("y")).dropna()
    if learn is not None:
        marked = marked.filter(learn)
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = with_features(rows, ["doc_id", "y"]).orderBy(F.xxhash64("doc_id"), F.col("features").cast("string")).limit(fit_rows).toArrow()
    x = np.array(got.column("features").to_pylist(), dtype=float)
    return fit(x, np.array(got.column("y").to_pylist(), dtype=float))


def score(docs: DataFrame, model: Gam, keep: list[str], text_column: str = "text") -> DataFrame:
    """The ``keep`` columns and ``score`` of every row: one pass over the texts, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = arrow_strings(b.column(len(keep)))
            x = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(model.score(x))], [*keep, "__score"])

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_column}`").alias("__text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    return map_batches(chosen, run, ", ".join([*schema, "__score double"])).withColumnRenamed("__score", "score")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, whole, that score ``threshold`` or more."""
    model = train(docs, labels, learn=crc32_mod("doc_id", 5) != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in arrow_strings(b.column(b.schema.get_field_index("text")))]
            kept = model.score(np.array(x, dtype=float).reshape(len(x), len(FEATURES))) >= threshold
            yield b.filter(pa.array(kept))

    return map_batches(docs, run, docs.schema)


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null texts count as empty; an empty text has a score like any other. Repeated rows score alike. Learns from the
    labels of documents whose crc32 of the id is not divisible by 5, and from texts alone.
    """
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod("doc_id", 5) == 0
    model = train(docs, table(spark, sf_dir, "labels"), learn=~held_out)
    out = score(docs, model, ["doc_id"])
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
