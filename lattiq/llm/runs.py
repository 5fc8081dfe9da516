"""Periodic runs of words, by longest previous factors.

The documents of a batch are sorted together, as words numbered within their documents: prefix doubling ranks all
suffixes, only those not yet told apart in each step, and keeps the ranks of every step, by which the common
extension of any two places, forwards or backwards, takes one look-up a step. From suffix array and neighbours with
smaller places come the longest previous factors, from these the blocks of the Lempel-Ziv factorisation. A run that
isn't strictly inside a block touches a boundary between two, and its period is at most half of their lengths together
(it has three periods, and what follows its first one has a previous factor that reaches its end), so all such
runs are found by extending every boundary for each period up to that: as many steps as the text has words. A run
strictly inside a block is a copy of one inside the block's previous occurrence: runs are kept in buckets by their start,
and blocks copy theirs in the order of the text. Of equal stretches found with several periods the smallest counts.

A run here has MIN_LENGTH words and MIN_PERIODS periods at least, so what follows its first period repeats
MIN_LENGTH * 2 / 3 words of the document. Documents in which no so long stretch (rounded down to a power of two) occurs
twice have no run and are left out before the suffix array is made.

A document is the work of one task, about 100 bytes a word of those with long repeats; documents are sorted in batches of
PIECE bytes, longer ones alone and whole.

Defined results: a null or empty text has no words and no runs; a null doc_id counts as the empty text in the checksum;
repeated rows are worked out one by one; of equal exponents the smallest start, then the smallest period counts; an
empty table gives an empty result; further columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import arrow_map, pieces, raw_text, span_hashes, table

MIN_LENGTH, MIN_PERIODS = 24, 3
PIECE = 1 << 20
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Ranks:
    """Ranks of the suffixes of documents by their first 2**k words, for each step k.

    ``words`` are numbers, ``begin`` and ``end`` the places of each word's document. Equal ranks in step k: the same
    2**k words of one document. Ends after step ``last``, or when all are told apart.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray, last: int | None = None):
        n = self.n = len(words)
        self.begin, self.end, self.levels = begin, end, []
        key = doc.astype(np.int64) * (int(words.max()) + 1 if n else 1) + words
        order = np.argsort(key, kind="stable")
        rank, self.open = self._grouped(key[order], order, np.zeros(n, np.int64), np.arange(n))
        k = 0
        while True:
            self.levels.append(np.append(rank, -1).astype(np.int32))
            if not len(self.open) or k == last:
                break
            at = self.open
            further = at + (1 << k)
            inside = further < end[at]
            second = np.where(inside, rank[np.where(inside, further, 0)] + 1, 0)
            key = rank[at] * (n + 1) + second
            order = np.argsort(key, kind="stable")
            base = rank[at[order]]
            first = np.flatnonzero(np.append(True, base[1:] != base[:-1]))  # places of the groups among the sorted ones
            offset = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            rank = rank.copy()
            rank, self.open = self._grouped(key[order], at[order], rank, base + offset)
            k += 1
        self.rank = rank

    @staticmethod
    def _grouped(keys, at, rank, place):
        """Ranks of ``at``: the first place of its group of equal keys; and those in groups of several."""
        if not len(keys):
            return rank, at
        new = np.append(True, keys[1:] != keys[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(keys)))
        rank[at] = np.repeat(place[first], size)
        return rank, at[np.repeat(size > 1, size)]

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x and y on are the same; x and y differ."""
        x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = (self.levels[k][x] == self.levels[k][y]).astype(np.int64) << k
            x += step
            y += step
            out += step
        return out

    def backward(self, x: np.ndarray, y: np.ndarray, low: np.ndarray) -> np.ndarray:
        """How many words before x and y are the same; ``low`` is where their document begins."""
        x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = x - (1 << k), y - (1 << k)
            inside = (a >= low) & (b >= low)
            step = (inside & (self.levels[k][np.where(inside, a, 0)] == self.levels[k][np.where(inside, b, 0)])).astype(np.int64) << k
            x -= step
            y -= step
            out += step
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """By place: the length of the longest factor that also starts before it, and where."""
        suffix = np.empty(self.n, np.int64)
        suffix[self.rank] = np.arange(self.n)
        value = np.concatenate([[-1], suffix, [-1]])
        length, source = np.zeros(self.n, np.int64), np.full(self.n, -1, np.int64)
        for step in (-1, 1):  # the nearest smaller place on either side, by jumps over what is larger
            near = np.arange(self.n + 2) + step
            near[[0, -1]] = 0
            todo = np.arange(1, self.n + 1)
            while len(todo := todo[value[near[todo]] > value[todo]]):
                near[todo] = near[near[todo]]
            other = value[near[1:-1]]
            known = np.flatnonzero(other >= 0)
            at = suffix[known]
            common = self.forward(at, other[known])
            better = common > length[at]
            length[at[better]], source[at[better]] = common[better], other[known][better]
        return length, source


def boundary_runs(r: Ranks, left: np.ndarray, at: np.ndarray, right: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(start, end, period) of the runs that touch a block's boundary ``at``, the blocks beside it having ``left`` and
    ``right`` words; ``begin`` and ``end`` are the document's."""
    periods = (left + right) // 2
    k = np.repeat(np.arange(len(at)), periods)
    q = np.arange(len(k)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    b, lo, hi, word = at[k], begin[k], end[k], r.levels[0]
    found = []
    for y in (b - q, b + q):  # the word a period before, and that a period behind the boundary
        x, z = np.minimum(b, y), np.maximum(b, y)
        inside = (x >= lo) & (z <= hi)
        same = inside & (z < hi) & (word[np.where(inside, x, 0)] == word[np.where(inside, z, 0)])
        before = inside & (x > lo)
        same |= before & (word[np.where(before, x - 1, 0)] == word[np.where(before, z - 1, 0)])
        s = np.flatnonzero(same)
        x, z, p = x[s], z[s], q[s]
        ahead = np.where(z < hi[s], r.forward(x, z), 0)
        start, stop = x - r.backward(x, z, lo[s]), z + ahead
        long = stop - start >= np.maximum(MIN_LENGTH, MIN_PERIODS * p)
        found.append(np.stack([start[long], stop[long], p[long]], 1))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[fresh]


def runs_of(words: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """By document: (start, end, period) of its runs, in the order of start and period; ``words`` are numbers."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    ends = np.cumsum(sizes)
    doc, begin, end = (np.repeat(v, sizes) for v in (np.arange(len(sizes)), ends - sizes, ends))
    last = (MIN_LENGTH - MIN_LENGTH // MIN_PERIODS).bit_length() - 1
    some = np.unique(doc[Ranks(words, doc, begin, end, last).open])
    if not len(some):
        return out
    words, sizes = words[np.isin(doc, some)], sizes[some]
    ends = np.cumsum(sizes)
    doc, begin, end = (np.repeat(v, sizes) for v in (np.arange(len(sizes)), ends - sizes, ends))
    r = Ranks(words, doc, begin, end)
    length, source = r.previous_factors()
    steps, blocks, at = np.maximum(length, 1).tolist(), [], 0
    while at < r.n:  # factors never reach beyond their document
        blocks.append(at)
        at += steps[at]
    blocks = np.array(blocks)
    size = np.diff(np.append(blocks, r.n))
    first = blocks == begin[blocks]
    # boundaries: where a block follows another of its document, and where a document ends
    k = np.flatnonzero(~first)
    final = np.flatnonzero(np.append(first[1:], True))
    places = np.concatenate([blocks[k], end[blocks[final]]])
    rows = boundary_runs(r, np.concatenate([size[k - 1], size[final]]), places, np.concatenate([size[k], np.zeros(len(final), np.int64)]), *(np.concatenate([v[blocks[k]], v[blocks[final]]]) for v in (begin, end)))
    buckets: dict[int, list[tuple[int, int, int]]] = {}
    for start, stop, period in rows.tolist():
        insort(buckets.setdefault(int(doc[start]), []), (start, stop, period))
    wide = np.flatnonzero((size > MIN_LENGTH + 1) & (length[blocks] > 0))
    for b, n in zip(blocks[wide].tolist(), size[wide].tolist()):
        known = buckets.get(int(doc[b]))
        if not known:
            continue
        p = int(source[b])
        i = bisect_right(known, (p, r.n, 0))
        while i < len(known) and known[i][0] < p + n:
            start, stop, period = known[i]
            if stop < p + n:
                copy = (start + b - p, stop + b - p, period)
                j = bisect_right(known, copy)
                if not j or known[j - 1] != copy:
                    known.insert(j, copy)
            i += 1
    for d, known in buckets.items():
        low = int(ends[d] - sizes[d])
        out[int(some[d])] = sorted(((a - low, b - low, q) for a, b, q in known), key=lambda x: (x[0], x[2]))
    return out


def repeated(n: int, h: int) -> np.ndarray | None:
    """Places of the original words for a document of checksum h, if its text is made periodic."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def digest(text: bytes, order: np.ndarray | None, runs: list[tuple[int, int, int]]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of a document."""
    words = text.split()
    if order is not None:
        words = [words[k] for k in order.tolist()]
    best = None
    if runs:
        keep = np.ones(len(words), bool)
        for a, b, q in runs:
            keep[a + q : b] = False
            if best is None or (b - a) * best[2] > best[1] * q or (b - a) * best[2] == best[1] * q and (a, q) < (best[0], best[2]):
                best = (a, b - a, q)
        words = [words[k] for k in np.flatnonzero(keep).tolist()]
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *one, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """A row for each document: its runs of words, the one of greatest exponent, and digests of all runs and of the text
    without the repeats that they hold."""

    def kernel(batches):
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for first, stop in pieces(offsets, PIECE):
                part, at = data[offsets[first] : offsets[stop]], offsets[first : stop + 1] - offsets[first]
                blank, edge = _BLANK[part], np.zeros(len(part) + 1, bool)
                edge[at] = True
                word = ~blank
                begin = np.flatnonzero(word & (np.append(True, blank[:-1]) | edge[:-1])[: len(part)])
                end = np.flatnonzero(word & (np.append(blank[1:], True) | edge[1:])[: len(part)]) + 1
                sizes = np.diff(np.searchsorted(begin, at))
                words = np.unique(span_hashes(part, begin, end), return_inverse=True)[1]
                orders, low = [], 0
                for doc_id, n in zip(ids[first:stop], sizes.tolist()):
                    order = repeated(n, zlib.crc32(b"" if doc_id is None else str(doc_id).encode()))
                    if order is not None:
                        words[low : low + n] = words[low : low + n][order]
                    orders.append(order)
                    low += n
                texts = [part[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                rows += map(digest, texts, orders, runs_of(words, sizes))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, SCHEMA)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"))
