"""Language identification by a bidirectional gated recurrent network over bytes.

A network of two gated recurrent directions with HIDDEN units each reads bytes (ASCII and Latin-1
letters folded to lower case) in windows of WINDOW bytes; a softmax layer labels every position. It is
trained in numpy by back-propagation through time on windows of a bounded sample of labelled
documents. For a document, every byte of the whole text is labelled and the probabilities of its
positions are averaged. Gates use x / (1 + |x|) in place of exponentials.

Defined results: a null text or one without a letter is ``und`` with score 0; null languages are not
learned; if no language is known at all, everything is ``und`` with score 0; repeated rows get equal
results; a null doc_id is labelled like any other; a text of any length is labelled whole, 8192 windows
at a time; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import arrow_map, fold, pieces, raw_text, table

HIDDEN, WINDOW = 12, 64
#: Training documents to a language at most (about: chosen by hash), and windows to a document.
DOCUMENTS, WINDOWS = 1500, 4
STEPS, BATCH, RATE = 260, 192, 0.02
FOLDS, HELD = 4, 2
UNKNOWN = "und"


def fold_case(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        big = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)
        out[1:][big] += 32
    return out


def soft(x: np.ndarray) -> np.ndarray:
    d = np.abs(x)
    d += 1
    return np.divide(x, d, out=d)


def gate(x: np.ndarray) -> np.ndarray:
    d = soft(x)
    d *= 0.5
    d += 0.5
    return d


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


class Network:
    """Weights by name: U{g}{d} inputs by byte, W{g}{d} recurrent, for gates z, r, n and directions
    f, b; V and c of the output layer."""

    def __init__(self, languages: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages, self.w = languages, {}
        for d in "fb":
            for g in "zrn":
                self.w[f"U{g}{d}"] = (rng.normal(size=(256, HIDDEN)) * 0.3).astype(np.float32)
                self.w[f"W{g}{d}"] = (rng.normal(size=(HIDDEN, HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        self.w["V"] = (rng.normal(size=(2 * HIDDEN, len(languages))) * 0.3).astype(np.float32)
        self.w["c"] = np.zeros(len(languages), np.float32)

    def direction(self, x: np.ndarray, live: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
        """States (T, N, HIDDEN) over bytes x (T, N); a position that isn't live leaves the state."""
        w = self.w
        h = np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.empty((*x.shape, HIDDEN), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            az = w["Uz" + d][x[t]] + h @ w["Wz" + d]
            ar = w["Ur" + d][x[t]] + h @ w["Wr" + d]
            z, r = gate(az), gate(ar)
            q = h @ w["Wn" + d]
            an = w["Un" + d][x[t]] + r * q
            n = soft(an)
            new = n + z * (h - n)
            if not live[t].all():
                new = np.where(live[t][:, None], new, h)
            if tape is not None:
                tape.append((t, h, az, ar, an, z, r, q, n))
            h = out[t] = new
        return out

    def positions(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Probabilities (T, N, languages) of every position."""
        states = np.concatenate([self.direction(x, live, "f"), self.direction(x, live, "b")], -1)
        return softmax(states @ self.w["V"] + self.w["c"])

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy of live positions and its gradients, by back-propagation through time."""
        tapes = {"f": [], "b": []}
        states = np.concatenate([self.direction(x, live, d, tapes[d]) for d in "fb"], -1)
        p = softmax(states @ self.w["V"] + self.w["c"])
        count = live.sum()
        loss = -np.log(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), -1)[..., 0] + 1e-9)[live].sum() / count
        d_out = p.copy()
        d_out[:, np.arange(x.shape[1]), y] -= 1
        d_out *= live[..., None] / count
        grad = {"V": np.tensordot(states, d_out, ((0, 1), (0, 1))), "c": d_out.sum((0, 1))}
        d_states = d_out @ self.w["V"].T
        slope = lambda a: 1 / (1 + np.abs(a)) ** 2
        for k, d in enumerate("fb"):
            for g in "zrn":
                grad[f"U{g}{d}"], grad[f"W{g}{d}"] = np.zeros((256, HIDDEN), np.float32), np.zeros((HIDDEN, HIDDEN), np.float32)
            carry = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, az, ar, an, z, r, q, n in reversed(tapes[d]):
                dh = carry + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                on = live[t][:, None]
                dn = dh * (1 - z) * slope(an) * on
                dz = dh * (h - n) * 0.5 * slope(az) * on
                dr = dn * q * 0.5 * slope(ar)
                dq = dn * r
                for g, a, b in (("z", dz, dz), ("r", dr, dr), ("n", dn, dq)):
                    np.add.at(grad[f"U{g}{d}"], x[t], a)
                    grad[f"W{g}{d}"] += h.T @ b
                carry = np.where(on, dh * z, dh) + dz @ self.w["Wz" + d].T + dr @ self.w["Wr" + d].T + dq @ self.w["Wn" + d].T
        return float(loss), grad

    def train(self, windows: np.ndarray, live: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 0) -> list[float]:
        """Adam over batches that draw every language equally often."""
        rng, losses = np.random.default_rng(seed), []
        of = [np.flatnonzero(y == k) for k in range(len(self.languages))]
        m, v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(i, max(1, BATCH // len(of))) for i in of])
            loss, grad = self.gradients(windows[pick].T, live[pick].T, y[pick])
            losses.append(loss)
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities (rows, languages): the mean over all positions of a text; zeros for an empty one."""
        offsets = offsets - offsets[0]
        data, lengths = fold_case(data), np.diff(offsets)
        k = -(-lengths // WINDOW)
        row = np.repeat(np.arange(len(lengths)), k)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
        total = np.zeros((len(lengths), len(self.languages)))
        for i in range(0, len(row), 8192):
            of = row[i : i + 8192]
            s = offsets[of] + nth[i : i + 8192] * WINDOW
            e = np.minimum(s + WINDOW, offsets[of + 1])
            at = s + np.arange(WINDOW)[:, None]
            live = at < e
            p = self.positions(data[np.minimum(at, len(data) - 1)], live)
            sums = np.where(live[..., None], p, 0).sum(0)
            for j in range(total.shape[1]):
                total[:, j] += np.bincount(of, sums[:, j], len(lengths))
        return total / np.maximum(lengths, 1)[:, None]


def sample_windows(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """(doc_id, lang, piece) for training: windows spread over the whole texts of sampled documents."""
    known = docs.where((fold(F.col("doc_id"), folds) != held) & F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    counts = known.groupBy("lang").count().collect()  # a row for each language, as the network has a column for each
    if not counts:
        return docs.sparkSession.createDataFrame([], "doc_id long, lang string, piece binary")
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, DOCUMENTS / r["count"]))])[F.col("lang")]
    chosen = known.where((F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)) & F.col("text").rlike(r"\p{L}"))

    def cut(batches):
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            data, ids, langs, pieces_of = fold_case(data), [], [], []
            for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                for j in range(WINDOWS):
                    s = a + max(0, b - a - WINDOW) * j // max(1, WINDOWS - 1)
                    ids.append(batch.column("doc_id")[i].as_py())
                    langs.append(batch.column("lang")[i].as_py())
                    pieces_of.append(data[s : min(b, s + WINDOW)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(pieces_of, pa.binary())], names=["doc_id", "lang", "piece"])

    chosen = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    return arrow_map(chosen, cut, "doc_id long, lang string, piece binary")


def fit(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> Network:
    got = sample_windows(docs, folds, held).toPandas().sort_values(["doc_id", "lang", "piece"], kind="stable")
    languages = sorted(set(got["lang"]))
    net = Network(languages)
    if len(languages) > 1:
        windows, live = np.zeros((len(got), WINDOW), np.uint8), np.zeros((len(got), WINDOW), bool)
        for i, x in enumerate(got["piece"]):
            windows[i, : len(x)] = np.frombuffer(bytes(x), np.uint8)
            live[i, : len(x)] = True
        net.train(windows, live, got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy())
    return net


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    names = np.array([*net.languages, UNKNOWN], object)

    def labelled(batches):
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in pieces(offsets, 1 << 20):
                if len(names) > 1:
                    p = net.documents(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
                    best, score = p.argmax(1), np.clip(p.max(1), 0, 1)
                else:
                    best, score = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                best, score = np.where(letters[lo:hi], best, len(names) - 1), np.where(letters[lo:hi], score, 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return arrow_map(rows, labelled, "doc_id long, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = predict(docs, fit(docs))
    return labelled.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score")
