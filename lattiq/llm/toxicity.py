"""Toxicity by class-conditional Kneser-Ney models over folded characters.

Texts are folded to SYMBOLS symbols (letters, digits, a blank for everything that separates words, a
few classes of bytes beyond ASCII). Over all labelled training documents, tasks count n-grams of
ORDER symbols by class; Spark adds the counts up and works out the model, context by context. There are
at most SYMBOLS ** ORDER n-grams, so tables and model have a fixed bound (a byte each on the driver),
while the counts follow the corpus.

The two models, toxic and ordinary, hold counts of their own at the top order only; below it both
back off to shared continuation counts of both classes. A rare expression thus falls back to the
same probability in either model and is no evidence. A document gets the difference of the
log-likelihoods, normalised by length, over the whole text and over its most toxic window.

Stems that are made of common syllables look ordinary to so short contexts. So a second pair of models is over words, by
their beginnings of SHORT and of LONG symbols: how many documents of a class hold each, discounted, backing off to the
shared share of both classes. Beginnings that at least MIN_DOCUMENTS toxic documents hold and whose log-ratio is at
least STRONG, the MAX_STRONG strongest, are kept as a table; a document gets the log-ratios of its words
there, a word.

A logistic regression on a share of the training documents that the counts leave out turns these into a probability.

Defined results: null and empty texts score as the blank text; labels that are null are ignored, repeated
ones count each; a null doc_id is scored and never learned from; without training rows of both classes
every score is the share of toxic ones (0 without any); repeated rows score alike; a text of any length
is scored whole, PIECE codes at a time; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import PIECE, Stash, arrow_map, fold, pieces, raw_text, table

SYMBOLS, BITS, ORDER = 32, 5, 5
DISCOUNT = 0.75
WINDOW = 24
#: Training rows at most for the calibration, of which there are three weights; counts have no bound.
CALIBRATION_ROWS = 40_000
#: One of so many training documents is left out of the counts, for the calibration.
LEFT_OUT = 6
STEP = 16  # the log-ratio table keeps sixteenths
THRESHOLD, FOLDS, HELD = 0.7, 3, 1
SHORT, LONG = 5, 8
MIN_DOCUMENTS, STRONG = 5, 1.0
#: Beginnings of words in the model at most (16 bytes each).
MAX_STRONG = 1 << 20


def _fold_table() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    letters = np.arange(26)
    out[97 + letters] = out[65 + letters] = 1 + letters
    out[48:58] = 27
    out[0x80:0xC0] = 29 + np.arange(64) % 3
    out[0xC0:] = 28
    return out


FOLD = _fold_table()


def codes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes at every byte, texts set apart by blanks; and the offsets of the rows' codes.

    Every text ends with one blank, so an empty one has one code.
    """
    lengths = np.diff(offsets)
    starts = np.concatenate([[0], np.cumsum(lengths + ORDER)])
    symbols = np.zeros(starts[-1] + ORDER, np.int32)
    if len(data):
        at = np.arange(len(data)) + np.repeat(starts[:-1] + ORDER - 1 - offsets[:-1] + offsets[0], lengths)
        symbols[at] = FOLD[data]
    codes = np.zeros(starts[-1], np.int32)
    for k in range(ORDER):
        codes |= symbols[ORDER - 1 - k : ORDER - 1 - k + starts[-1]] << (BITS * k)
    keep = np.ones(starts[-1], bool)
    for k in range(1, ORDER):
        keep[starts[1:] - k] = False
    return codes[keep], np.concatenate([[0], np.cumsum(lengths + 1)])


def beginnings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the beginnings of all words, SHORT and, of longer words, LONG symbols; and the row of each."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    keys, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(data), PIECE):
        low = max(at - 1, 0)
        part = FOLD[data[low : at + PIECE + LONG]]
        starts = np.flatnonzero(part[: at + PIECE - low] > 0) + low
        row = np.searchsorted(offsets, starts, "right") - 1
        first = (starts == offsets[row]) | (part[np.maximum(starts - low - 1, 0)] == 0)
        keep = first & (starts >= at)
        starts, row = starts[keep], row[keep]
        code, alive = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
        for k in range(LONG):
            place = starts + k
            alive &= place < offsets[row + 1]
            symbol = part[np.minimum(place - low, len(part) - 1)]
            alive &= symbol > 0
            code = code << BITS | np.where(alive, symbol, 0)
            if k + 1 == SHORT:
                keys.append(code | SHORT << 56)
                rows.append(row)
                longer = alive.copy()
        longer &= (code & ((1 << BITS * (LONG - SHORT)) - 1)) > 0
        keys.append(code[longer] | LONG << 56)
        rows.append(row[longer])
    return np.concatenate(keys), np.concatenate(rows)


class Strong:
    """Log-ratios of beginnings of words, looked up behind a table of flags."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ratios = keys[order], ratios[order]
        self.flags = np.zeros(1 << 20, bool)
        self.flags[self.flag(keys)] = True

    @staticmethod
    def flag(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The log-ratios of each text's words, a beginning."""
        keys, rows = beginnings(data, offsets)
        n = np.bincount(rows, minlength=len(offsets) - 1)
        some = np.flatnonzero(self.flags[self.flag(keys)])
        at = np.searchsorted(self.keys, keys[some])
        hit = np.zeros(len(some), bool)
        if len(self.keys):
            at = np.minimum(at, len(self.keys) - 1)
            hit = self.keys[at] == keys[some]
        total = np.bincount(rows[some[hit]], self.ratios[at[hit]], minlength=len(offsets) - 1)
        return total / np.maximum(n, 1)


def shared_backoff(types: np.ndarray) -> np.ndarray:
    """Probabilities of all (ORDER - 1)-grams from how many distinct symbols were seen before each of them."""
    cont = {ORDER - 1: types.astype(np.float32)}
    for k in range(ORDER - 2, 0, -1):
        cont[k] = (cont[k + 1] > 0).reshape(SYMBOLS, -1).sum(0, dtype=np.float32)
    p = np.full(SYMBOLS, 1 / SYMBOLS, np.float32)
    for k in range(1, ORDER):
        c = cont[k].reshape(-1, SYMBOLS)
        total, kinds = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        lower = np.tile(p.reshape(-1, SYMBOLS), (len(c) * SYMBOLS // len(p) if k > 1 else 1, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            mine = np.maximum(c - DISCOUNT, 0) / total + DISCOUNT * kinds / total * lower
        p = np.where(total > 0, mine, lower).ravel()
    return p


def probabilities(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """(contexts, SYMBOLS) of one class, from its counts and the shared probabilities below, both of that shape."""
    total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1)
    return np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1) + weight * lower


def log_ratios(contexts: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """log p_toxic - log p_ordinary, in STEP-ths, of every symbol after each context."""
    lower = shared.reshape(-1, SYMBOLS)[contexts & (SYMBOLS ** (ORDER - 2) - 1)]
    logs = np.log(probabilities(toxic, lower)) - np.log(probabilities(ordinary, lower))
    return np.clip(np.rint(logs * STEP), -127, 127).astype(np.int8)


def features(data: np.ndarray, offsets: np.ndarray, ratios: np.ndarray, strong: Strong) -> np.ndarray:
    """Per text: the log-ratio a symbol over its most toxic window and over all of it; that of its words, as a root, since few
    toxic ones among many words are telling."""
    return np.column_stack([_symbol_features(data, offsets, ratios), np.sqrt(strong.evidence(data, offsets))])


def _symbol_features(data: np.ndarray, offsets: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    if len(offsets) == 2 and len(data) > PIECE:
        return _long_features(data, ratios)
    codes, starts = codes_of(data, offsets)
    total = np.concatenate([[0], np.cumsum(ratios[codes], dtype=np.int64)])
    n = np.diff(starts)
    mean = (total[starts[1:]] - total[starts[:-1]]) / n
    end = np.minimum(np.arange(len(codes)) + WINDOW, np.repeat(starts[1:], n))
    best = np.maximum.reduceat(total[end] - total[:-1], starts[:-1])
    return np.column_stack([best / (WINDOW * STEP), mean / STEP])


def _long_features(data: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Those of one text, PIECE codes at a time; windows look WINDOW codes beyond their part."""
    n, total, best = len(data) + 1, 0, None
    for at in range(0, n, PIECE):
        stop = min(at + PIECE + WINDOW, n)
        symbols = np.zeros(stop - at + ORDER - 1, np.int32)  # blanks before the text and one after it
        first = max(at - ORDER + 1, 0)
        part = FOLD[data[first:stop]]
        symbols[first - at + ORDER - 1 :][: len(part)] = part
        codes = np.zeros(stop - at, np.int32)
        for k in range(ORDER):
            codes |= symbols[ORDER - 1 - k :][: len(codes)] << (BITS * k)
        sums = np.concatenate([[0], np.cumsum(ratios[codes], dtype=np.int64)])
        mine = np.arange(min(PIECE, n - at))
        total += int(sums[len(mine)])
        got = int((sums[np.minimum(mine + WINDOW, len(codes))] - sums[mine]).max())
        best = got if best is None else max(best, got)
    return np.array([[best / (WINDOW * STEP), total / n / STEP]])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1, 3 / (np.abs(step).max() + 1e-12))
    return w


class Model:
    def __init__(self, ratios: np.ndarray | None, strong: Strong | None, weights: np.ndarray | None, prior: float):
        self.ratios, self.strong, self.weights, self.prior = ratios, strong, weights, prior

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.ratios is None:
            return np.full(len(offsets) - 1, self.prior)
        x = features(data, offsets, self.ratios, self.strong)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _labelled(docs: DataFrame, labels: DataFrame, target: str, folds: int, held: int) -> DataFrame:
    known = labels.where(F.col(target).isin(0, 1)).select("doc_id", F.col(target).cast("int").alias("y"))
    return docs.where(fold(F.col("doc_id"), folds) != held).select("doc_id", "text").hint("merge").join(known, "doc_id")


def count_ngrams(rows: DataFrame) -> DataFrame:
    """(code, ordinary, toxic) over rows (text, y)."""

    def count(batches):
        held = [[np.zeros(0, np.int32), np.zeros(0, np.int64)] for _ in range(2)]
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            data, offsets = raw_text(batch.column("text"))
            for lo, hi in pieces(offsets):
                codes, starts = codes_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
                toxic = np.repeat(y[lo:hi] == 1, np.diff(starts))
                for k, mine in enumerate((codes[~toxic], codes[toxic])):
                    got, n = np.unique(mine, return_counts=True)
                    every, where = np.unique(np.concatenate([held[k][0], got]), return_inverse=True)
                    held[k] = [every, np.bincount(where, np.concatenate([held[k][1], n]), len(every)).astype(np.int64)]
        for k, (codes, n) in enumerate(held):
            for i in range(0, len(codes), 1 << 16):
                c, m = codes[i : i + (1 << 16)], n[i : i + (1 << 16)]
                zero = np.zeros(len(c), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(zero if k else m), pa.array(m if k else zero)], names=["code", "ordinary", "toxic"])

    counted = arrow_map(rows.select("text", "y"), count, "code int, ordinary long, toxic long")
    return counted.groupBy("code").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def count_beginnings(rows: DataFrame) -> DataFrame:
    """(key, ordinary, toxic): how many documents of (text, y) hold each beginning of a word."""

    def count(batches):
        held = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False) == 1
            data, offsets = raw_text(batch.column("text"))
            for lo, hi in pieces(offsets):
                keys, at = beginnings(data, offsets[lo : hi + 1])
                distinct, where = np.unique(keys, return_inverse=True)
                pairs = np.unique(at * max(len(distinct), 1) + where)  # once a document
                doc, key = np.divmod(pairs, max(len(distinct), 1))
                toxic = np.bincount(key[y[lo + doc]], minlength=len(distinct))
                n = np.stack([np.bincount(key, minlength=len(distinct)) - toxic, toxic], 1)
                every, back = np.unique(np.concatenate([held[0], distinct]), return_inverse=True)
                total = np.zeros((len(every), 2), np.int64)
                np.add.at(total, back, np.concatenate([held[1], n]))
                held = every, total
        for i in range(0, len(held[0]), 1 << 16):
            k, n = held[0][i : i + (1 << 16)], held[1][i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n[:, 0].copy()), pa.array(n[:, 1].copy())], names=["key", "ordinary", "toxic"])

    counted = arrow_map(rows.select("text", "y"), count, "key long, ordinary long, toxic long")
    return counted.groupBy("key").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def strong_beginnings(counts: DataFrame) -> Strong:
    """The telling ones of ``count_beginnings``."""
    o, t = F.col("ordinary"), F.col("toxic")
    sums = counts.agg(F.sum(o).alias("no"), F.sum(t).alias("nt"), F.count_if(o > 0).alias("ko"), F.count_if(t > 0).alias("kt")).first()
    if not sums["no"] or not sums["nt"]:
        return Strong(np.zeros(0, np.int64), np.zeros(0))
    shared = (o + t) / float(sums["no"] + sums["nt"])
    p = lambda n, total, kinds: F.greatest(n - DISCOUNT, F.lit(0.0)) / float(total) + DISCOUNT * kinds / total * shared
    ratio = F.log(p(t, sums["nt"], sums["kt"]) / p(o, sums["no"], sums["ko"]))
    got = counts.where(t >= MIN_DOCUMENTS).select("key", ratio.alias("ratio")).where(F.col("ratio") >= STRONG).orderBy(F.desc("ratio"), "key").limit(MAX_STRONG).toPandas()
    return Strong(got["key"].to_numpy(np.int64), got["ratio"].to_numpy(np.float64))


def ratio_table(counts: DataFrame) -> np.ndarray | None:
    """The log-ratios of all SYMBOLS ** ORDER n-grams, a byte each, from counts (code, ordinary, toxic); None without
    counts of both classes.

    Spark adds up the types below the top order and works out a row of SYMBOLS bytes for each context seen; the
    driver gets at most SYMBOLS ** (ORDER - 1) rows of either.
    """
    total = counts.agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t")).first()
    if not total["o"] or not total["t"]:
        return None
    size = SYMBOLS ** (ORDER - 1)
    suffixes = counts.groupBy(F.col("code").bitwiseAND(F.lit(size - 1)).alias("k")).agg(F.count("*").cast("int").alias("n")).toPandas()
    types = np.zeros(size, np.int32)
    types[suffixes["k"].to_numpy()] = suffixes["n"].to_numpy()
    shared = shared_backoff(types)
    sent = counts.sparkSession.sparkContext.broadcast(shared)

    def rows(batches):
        for batch in batches:
            context = batch.column("context").to_numpy().astype(np.int64)
            seen = batch.column("seen")
            at = np.repeat(np.arange(len(context)), seen.value_lengths().to_numpy(zero_copy_only=False))
            symbol, *both = (x.to_numpy(zero_copy_only=False) for x in seen.flatten().flatten())
            dense = np.zeros((2, len(context), SYMBOLS))
            for k in range(2):
                dense[k, at, symbol] = both[k]
            got = log_ratios(context, dense[0], dense[1], sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("context"), pa.array([x.tobytes() for x in got], pa.binary())], names=["context", "ratios"])

    grouped = counts.select(F.shiftright("code", BITS).alias("context"), F.struct(F.col("code").bitwiseAND(F.lit(SYMBOLS - 1)).alias("s"), "ordinary", "toxic").alias("x"))
    grouped = grouped.groupBy("context").agg(F.collect_list("x").alias("seen"))  # SYMBOLS entries at most
    got = arrow_map(grouped, rows, "context int, ratios binary").toPandas()
    sent.unpersist()
    out = np.zeros((size, SYMBOLS), np.int8)  # an unseen context says nothing
    out[got["context"].to_numpy()] = np.frombuffer(b"".join(got["ratios"]), np.int8).reshape(-1, SYMBOLS)
    return out.ravel()


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", folds: int = FOLDS, held: int = HELD) -> Model:
    rows = _labelled(docs, labels, target, folds, held)
    left_out = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(LEFT_OUT)) == 0
    counts = Stash(count_ngrams(rows.where(~left_out)), "ngrams")
    ratios = ratio_table(counts.df)
    if ratios is None:
        toxic = counts.df.agg(F.sum("toxic")).first()[0]
        counts.drop()
        return Model(None, None, None, float(bool(toxic)))
    counts.drop()
    words = Stash(count_beginnings(rows.where(~left_out)), "beginnings")
    strong = strong_beginnings(words.df)
    words.drop()
    n = labels.where(F.col(target).isin(0, 1)).count() / LEFT_OUT
    few = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.lit(int(min(1.0, CALIBRATION_ROWS / max(n, 1)) * (1 << 20)))
    sent = docs.sparkSession.sparkContext.broadcast((ratios, strong))

    def featured(batches):
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            for lo, hi in pieces(offsets):
                x = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], *sent.value)
                yield pa.RecordBatch.from_arrays([*map(pa.array, x.T.copy()), batch.column("y").slice(lo, hi - lo)], names=["a", "b", "c", "y"])

    sample = arrow_map(rows.where(left_out & few).select("text", "y"), featured, "a double, b double, c double, y int").toPandas()
    sent.unpersist()
    y = sample["y"].to_numpy(np.float64)
    if not 0 < y.sum() < len(y):
        return Model(ratios, strong, np.array([4.0, 0.0, 2.0, -4.0]), 0.5)
    return Model(ratios, strong, logistic(sample[["a", "b", "c"]].to_numpy(), y), 0.5)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            for lo, hi in pieces(offsets):
                s = sent.value.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(s)], names=["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scored, "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
