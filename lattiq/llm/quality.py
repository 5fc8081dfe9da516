"""Quality classifier: a generalised additive model with pairwise interactions.

A document becomes a row of FEATURES (array operations over raw bytes in Arrow batches). Labelled rows, a
bounded sample of them, are fetched to fit the model: features are binned at quantiles, cyclic boosting
visits one feature after another and adds a shallow tree over its bins to the feature's lookup table,
then does the same for the pairs of features that explain most of what is left. Scoring adds table
entries of bins, in one pass over the texts.

Defined results: null and empty texts have all-zero features and are scored like others; a null doc_id is
scored and never learned from; labels that are null are ignored, repeated ones count each; without
training rows of both classes every score is the share of good ones (0.5 without any); repeated rows
score alike; texts of any length are read whole, in parts of PIECE bytes; an empty table gives an
empty result; further columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import PIECE, arrow_map, fold, mix64, pieces, raw_text, span_hashes, table

#: Labelled rows that the model is fitted on, at most (about: chosen by hash).
TRAINING_ROWS = 60_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 60, 0.15, 2.0
THRESHOLD, FOLDS, HELD = 0.3, 5, 0

FEATURES = (
    "log_bytes", "lower", "upper", "digit", "beyond_ascii", "punctuation", "symbol", "exclamation", "bar",
    "newline", "word_length", "distinct_words", "distinct_pairs", "distinct_lines", "marked_ends", "log_words",
)

_LOWER, _UPPER, _DIGIT, _BEYOND, _PUNCT, _SYMBOL, _BANG, _BAR, _LINE, _BLANK = range(10)


def _byte_kinds() -> np.ndarray:
    out = np.full(256, _SYMBOL, np.uint8)
    out[list(range(97, 123))], out[list(range(65, 91))], out[list(range(48, 58))] = _LOWER, _UPPER, _DIGIT
    out[128:] = _BEYOND
    out[list(b".,;:?'\"()-")] = _PUNCT
    out[ord("!")], out[ord("|")], out[10] = _BANG, _BAR, _LINE
    out[[9, 11, 12, 13, 32]] = _BLANK
    return out


KIND = _byte_kinds()


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    _, first = np.unique(mix64(keys) ^ mix64(row.astype(np.uint64) + np.uint64(1)), return_index=True)
    return np.bincount(row[first], minlength=n)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for every text. Wide numbers are held a word or a part of PIECE bytes, not a byte."""
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    n, out = len(lengths), np.zeros((len(lengths), len(FEATURES)))
    if not len(data):
        return out
    kind = KIND[data]
    counts = np.zeros(16 * n, np.int64)
    for at in range(0, len(data), PIECE):
        part = kind[at : at + PIECE]
        row = np.searchsorted(offsets, np.arange(at, at + len(part)), "right") - 1 if n > 1 else 0
        counts += np.bincount(row * 16 + part.astype(np.int64), minlength=16 * n)
    counts = counts.reshape(n, 16)
    some = np.maximum(lengths, 1)
    for i, k in ((1, _LOWER), (2, _UPPER), (3, _DIGIT), (4, _BEYOND), (5, _PUNCT), (6, _SYMBOL), (7, _BANG), (8, _BAR), (9, _LINE)):
        out[:, i] = counts[:, k] / some
    out[:, 0] = np.log1p(lengths)
    first_of_row = np.zeros(len(data), bool)
    first_of_row[offsets[:-1][lengths > 0]] = True

    def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        begin = inside & (first_of_row | np.concatenate([[True], ~inside[:-1]]))
        end = inside & np.concatenate([~inside[1:] | first_of_row[1:], [True]])
        b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return b, e, np.searchsorted(offsets, b, "right") - 1, span_hashes(data, b, e)

    b, e, of, word = runs(kind < _LINE)
    if len(b):
        words = np.bincount(of, minlength=n)
        at_least = np.maximum(words, 1)
        out[:, 10] = np.bincount(of, e - b, n) / at_least
        out[:, 11] = np.where(words > 0, _distinct(word, of, n) / at_least, 0)
        same = of[1:] == of[:-1]
        pair = (word[1:] * np.uint64(3) + mix64(word[:-1]))[same]
        pairs = np.bincount(of[1:][same], minlength=n)
        out[:, 12] = np.where(pairs > 0, _distinct(pair, of[1:][same], n) / np.maximum(pairs, 1), 1)
        out[:, 14] = np.bincount(of, (kind[e - 1] >= _PUNCT) & (kind[e - 1] <= _BAR), n) / at_least
        out[:, 15] = np.log1p(words)
    b, e, of, line = runs(kind != _LINE)
    lines = np.bincount(of, minlength=n)
    out[:, 13] = np.where(lines > 0, _distinct(line, of, n) / np.maximum(lines, 1), 1)
    return out


def _by_piece(batch: pa.RecordBatch):
    """(first row, end, features) of the pieces of a batch."""
    data, offsets = raw_text(batch.column("text"))
    for lo, hi in pieces(offsets):
        yield lo, hi, features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])


# ---------------------------------------------------------------- the model


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of ordered bins; (0, 0) if none gains."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gt, ht = g.sum(), h.sum()
    gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
    k = int(np.argmax(gain))
    return (float(gain[k]), k + 1) if gain[k] > 1e-9 else (0.0, 0)


def line_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree of few leaves over ordered bins, as the value it adds at every bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [_best_cut(g[a:b], h[a:b]) + (a, b) for a, b in parts]
        gain, k, a, b = max(cuts)
        if not gain:
            break
        parts.remove((a, b))
        parts += [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def plane_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A cut on one axis, then on either side a cut on the other: its gain and values."""
    best = (0.0, np.zeros_like(g))
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for k in range(1, len(gg)):
            gain, value = -gg.sum() ** 2 / (hh.sum() + RIDGE), np.zeros_like(gg)
            for part in (slice(0, k), slice(k, None)):
                a, b = gg[part].sum(0), hh[part].sum(0)
                _, c = _best_cut(a, b)
                for s in (slice(0, c), slice(c, None)):
                    gain += a[s].sum() ** 2 / (b[s].sum() + RIDGE)
                    value[part, s] = a[s].sum() / (b[s].sum() + RIDGE)
            if gain > best[0]:
                best = (gain, value if axis == 0 else value.T)
    return best


class Additive:
    """edges: cuts of each feature; tables: values by bin; pairs: (i, j, values by coarse bins)."""

    def __init__(self, edges, tables, pairs, intercept):
        self.edges, self.tables, self.pairs, self.intercept = edges, tables, pairs, intercept

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    @staticmethod
    def coarse(bins: np.ndarray) -> np.ndarray:
        return bins * PAIR_BINS // BINS

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for i, t in enumerate(self.tables):
            total += t[b[:, i]]
        c = self.coarse(b)
        for i, j, t in self.pairs:
            total += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    if not len(y) or not 0 < y.sum() < len(y):
        p = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return Additive([np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [], float(np.log(p / (1 - p))))
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    model = Additive(edges, [np.zeros(BINS) for _ in edges], [], float(np.log(y.mean() / (1 - y.mean()))))
    bins = model.bins(x)
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * line_tree(np.bincount(bins[:, i], g, BINS), np.bincount(bins[:, i], h, BINS))
            t += step
            total += step[bins[:, i]]
    c, size = model.coarse(bins), PAIR_BINS**2
    plane = lambda cell, v: np.bincount(cell, v, size).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    ranked = []
    for i in range(x.shape[1]):
        for j in range(i):
            cell = c[:, i] * PAIR_BINS + c[:, j]
            ranked.append((plane_tree(plane(cell, g), plane(cell, h))[0], i, j))
    chosen = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS)), c[:, i] * PAIR_BINS + c[:, j]) for _, i, j in sorted(ranked)[-PAIRS:]]
    for _ in range(PAIR_ROUNDS):
        for _, _, t, cell in chosen:
            g, h = slopes()
            step = RATE * plane_tree(plane(cell, g), plane(cell, h))[1]
            t += step
            total += step.ravel()[cell]
    model.pairs = [x[:3] for x in chosen]
    return model


# ---------------------------------------------------------------- over Spark


def fit_labelled(docs: DataFrame, labels: DataFrame, target: str = "quality", folds: int = FOLDS, held: int = HELD, most: int = TRAINING_ROWS) -> Additive:
    """Fits on labelled documents outside the held fold, about ``most`` of them at most, chosen by a hash of doc_id.

    The chosen labels are so few that they are broadcast; only their documents' texts are looked at.
    """
    known = labels.where(F.col(target).isin(0, 1) & (fold(F.col("doc_id"), folds) != held)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    share = min(1.0, most / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def rows(batches):
        for batch in batches:
            for lo, hi, x in _by_piece(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    got = arrow_map(texts.select("doc_id", "text", "y"), rows, "doc_id long, y int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["y"], got["doc_id"]))  # one order however the rows were dealt
    return fit(x[order], got["y"].to_numpy(np.float64)[order])


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """(doc_id, score) of every row."""

    def scored(batches):
        for batch in batches:
            for lo, hi, x in _by_piece(batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(model.score(x))], names=["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scored, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, with all their columns."""
    plain = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])  # names may hold dots

    def kept(batches):
        for batch in batches:
            for lo, hi, x in _by_piece(batch):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.score(x) >= threshold))

    return arrow_map(plain, kept, plain.schema).toDF(*docs.columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit_labelled(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
