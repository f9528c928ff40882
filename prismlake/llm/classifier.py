"""Quality classifier: a generalised additive model with pairwise interactions.

Features of whole texts are cut into bins. Shallow trees are boosted in cycles, each on one feature alone, so that their
sum is a lookup table for each feature; then on the pairs that explain most of what is left. A document's score is the
logistic function of the tables' entries at its bins, added up for a whole batch at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismlake.llm.common import documents, with_computed
from prismlake.llm.quality_rules import SPACES, repeated_words

#: Labelled rows that a model is fitted on at most: those of the smallest hashes of doc_id.
SAMPLE = 20_000
#: Bins of a feature, cycles over single features and over pairs, pairs, step and weight of the prior.
BINS, CYCLES, PAIR_CYCLES, PAIRS, STEP, PRIOR = 32, 150, 60, 8, 0.1, 5.0
THRESHOLD = 0.7

FEATURES = [
    "words", "chars_a_word", "upper", "symbols", "exclamations", "digits", "distinct_words", "top_word", "repeated_words", "repeated_lines",
    "chars_a_line", "short_words", "bars", "capital_words", "other_scripts", "byte_entropy", "stops", "long_words", "top_five_words", "spaces",
]

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SYMBOL = np.isin(_BYTES, [*b"#*$%&<>@^~=+_\\/{}[]"])
_SPACE = np.isin(_BYTES, [*SPACES])


def features(text: str | None) -> list[float]:
    """Of the whole text; of nothing but the text. All are 0 for one without a word, and finite for any."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    common = Counter(words).most_common(5)
    n, size, letters = len(words), len(raw), max(1.0, counts[_LETTER].sum())
    share = counts[counts > 0] / size
    return [
        float(np.log1p(n)),
        lengths.mean(),
        counts[_UPPER].sum() / letters,
        counts[_SYMBOL].sum() / size,
        counts[33] / n,
        counts[_DIGIT].sum() / size,
        len(set(words)) / n,
        common[0][1] / n,
        repeated_words(words) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(size / len(lines))),
        (lengths <= 3).mean(),
        counts[124] / n,
        sum(w[:1].isupper() for w in words) / n,
        counts[128:].sum() / size,
        -float(share @ np.log2(share)),
        counts[46] / n,
        (lengths >= 12).mean(),
        sum(c for _, c in common) / n,
        counts[_SPACE].sum() / size,
    ]


@dataclass
class Model:
    """Edges of each feature's bins; a table for each feature and for each pair of them."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    single: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for f, table in enumerate(self.single):
            out += table[bins[:, f]]
        for (f, g), table in self.pairs.items():
            out += table[bins[:, f], bins[:, g]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.bins(x)), -30, 30)))


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradients g and weights h; place 0 if none gains."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + PRIOR) + right_g**2 / (right_h + PRIOR) - g.sum() ** 2 / (h.sum() + PRIOR)
    at = int(np.argmax(gain)) if len(gain) else -1
    return (float(gain[at]), at + 1) if at >= 0 and gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A shallow tree over a feature's bins, as the value of each bin."""
    cut = _split(g, h)[1] if depth else 0
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + PRIOR))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _tree_of_two(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree over a pair's bins: one cut of the first feature, and one of the second on either side."""
    best, cut = -1.0, 0
    rows_g, rows_h = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
    for at in range(1, len(g)):
        gain = 0.0
        for a, b in ((rows_g[at - 1], rows_h[at - 1]), (rows_g[-1] - rows_g[at - 1], rows_h[-1] - rows_h[at - 1])):
            gain += _split(a, b)[0] + a.sum() ** 2 / (b.sum() + PRIOR)
        if gain > best:
            best, cut = gain, at
    values = np.empty_like(g)
    for part in (slice(0, cut), slice(cut, len(g))):
        if g[part].size:
            values[part] = _tree(g[part].sum(axis=0), h[part].sum(axis=0), 1)
    return best - g.sum() ** 2 / (h.sum() + PRIOR), values


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS) -> Model:
    """A model of the rows x with labels y, 0 or 1; without rows of both labels one that scores their smoothed mean."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    model = Model(edges, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    model.single = [np.zeros(len(e) + 1) for e in edges]
    if len(np.unique(y)) < 2:
        return model
    at = model.bins(x)
    logit = model.logits(at)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    def sums(where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        return np.bincount(where, g, size), np.bincount(where, h, size)

    for _ in range(CYCLES):
        for f, table in enumerate(model.single):
            step = STEP * _tree(*sums(at[:, f], len(table)), 2)
            table += step
            logit += step[at[:, f]]
    shapes = {(f, g): (len(edges[f]) + 1, len(edges[g]) + 1) for f in range(len(edges)) for g in range(f)}
    place = lambda pair: at[:, pair[0]] * shapes[pair][1] + at[:, pair[1]]
    table_of = lambda pair: (x.reshape(shapes[pair]) for x in sums(place(pair), int(np.prod(shapes[pair]))))
    gains = {pair: _tree_of_two(*table_of(pair))[0] for pair in shapes}
    chosen = sorted(gains, key=lambda pair: (-gains[pair], pair))[:PAIRS]
    model.pairs = {pair: np.zeros(shapes[pair]) for pair in chosen}
    for _ in range(PAIR_CYCLES):
        for pair, table in model.pairs.items():
            step = STEP * _tree_of_two(*table_of(pair))[1]
            table += step
            logit += step.ravel()[place(pair)]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _features(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([features(t) for t in batch["text"].to_pylist()], float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """From the labelled ids that aren't held out, `sample` of them at most; the driver holds a row of features for each, and no more.

    An id labelled twice counts with its smaller label, one that several documents have with the least of their features;
    null ids and null labels are left out. Without labels, or without documents, all texts score alike.
    """
    usable = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("double").alias("_label"))
    some = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # at most `sample` ids
    compute = lambda batch: [pa.array([*_features(batch)], pa.list_(pa.float64()))]
    each = with_computed(joined, compute, "x array<double>", drop=["text"]).groupBy("doc_id").agg(F.min("x").alias("x"), F.min("_label").alias("label"))
    rows = each.toArrow().sort_by([("doc_id", "ascending")])  # a row for an id
    return fit(np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES)), rows["label"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score` added, from their texts alone; null and empty texts, repeated rows and very long ones have one too.

    A column named score is replaced; any other passes through. An empty table gives an empty one.
    """
    return with_computed(docs.drop("score"), lambda batch: [pa.array(model.scores(_features(batch)))], "score double")


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
