"""Removal of repeated 50-byte strings by suffix sorting in shards.

Equal strings must meet in one shard whatever documents hold them, so shards are cut by content: every
window of LENGTH bytes has the least hash of its GRAM-byte substrings as key, and neighbouring windows of
equal key make one segment. Of equal texts only the first document's is cut; the others go whole. Keys
that occur in one document only are left out. A task passes on a segment only where it first meets it,
and settles the later documents that hold it itself, so a passage that a third of all documents share
comes once from each task. Within a shard, windows whose hash no other window of its distinct segments has are
equal to none and left out, so that a shard whose segments share no more than a key sorts nothing; the stretches that
remain, each once, are suffix-sorted by induced sorting: the leftmost-smaller
suffixes are named by their substrings and ranked by prefix doubling where names repeat; all others are
induced bucket by bucket from queues kept in one array, a bucket's runs of one symbol at once. The array
lies in a file of the task's own folder beyond MEMORY suffixes. Runs of suffixes whose common prefix
reaches LENGTH are equal windows; each takes the smallest document of its run.

This is not the named method in full: the queues hold positions, and a symbol before a position is read
from the text, in place of disk-backed priority queues of tuples that carry symbols and common-prefix
values; there is no recursion, as prefix doubling ranks the names; common prefixes are only compared with
LENGTH after sorting; a shard's text and its ranks are in memory. See README for figures.

Equal texts are known by their 128-bit MD5.

Defined results: null texts are empty; texts shorter than LENGTH keep all bytes; rows with a null doc_id
are not compared and keep all bytes; rows that repeat a doc_id are copies of one document and don't count
against each other; a text of any length is cut whole, in overlapping parts; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import PIECE, pieces, powers, raw_text, table

LENGTH, GRAM = 50, 16
SHARD_BYTES, MEMORY = 4 << 20, 1 << 25
#: Bytes of segments that a task remembers; with more it starts anew and only passes on more of them.
SEEN = 32 << 20
_R, _R2 = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD


def octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; a view of the bytes."""
    data = np.ascontiguousarray(data)
    return np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))


def run_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts: row, start in the row, bytes, and key."""
    offsets = offsets - offsets[0]
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    low = octets(data)[:-8] * np.uint64(_R)  # hashes of GRAM bytes
    low ^= low >> np.uint64(32)
    low += octets(data)[8:]
    low *= np.uint64(_R2)
    low ^= low >> np.uint64(29)
    low *= np.uint64(_R)
    low ^= low >> np.uint64(32)
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    cut = np.ones(len(low), bool)  # a segment or a stretch without windows begins
    np.not_equal(low[1:], low[:-1], out=cut[1:])
    cut[offsets[offsets < len(low)]] = True
    outside = np.zeros(len(low), bool)  # windows that would reach beyond their row
    beyond = (offsets[1:, None] - np.arange(1, LENGTH)).ravel()
    outside[beyond[(beyond >= 0) & (beyond < len(low))]] = True
    cut = np.flatnonzero(cut | outside)
    window = np.flatnonzero(~outside[cut])
    begin, end = cut[window], np.append(cut, len(low))[window + 1]
    row = np.searchsorted(offsets, begin, "right") - 1
    return row, begin - offsets[row], end - begin + LENGTH - 1, low[begin]


# ---------------------------------------------------------------- suffix sorting


def _doubling(s: np.ndarray) -> np.ndarray:
    """Prefix doubling; a round sorts only the suffixes that are not yet told apart."""
    n = len(s)
    rank, k = np.zeros(n, np.int64), 0
    at, key = np.arange(n), s.astype(np.int64)
    while len(at):
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        old = rank[at]
        new = np.append(True, key[1:] != key[:-1])
        head = np.append(True, old[1:] != old[:-1])
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        nth = np.arange(len(at))
        rank[at] = old + np.maximum.accumulate(np.where(new, nth, 0)) - np.maximum.accumulate(np.where(head, nth, 0))
        at = at[np.repeat(size > 1, size)]
        k = 2 * k or 1
        after = np.where(at + k < n, rank[np.minimum(at + k, n - 1)], -1)
        key = rank[at] * (n + 1) + after + 1
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def _queue(n: int) -> np.ndarray:
    if n <= MEMORY:
        return np.full(n, -1, np.int32)
    with tempfile.TemporaryFile() as f:
        out = np.memmap(f, np.int64, "w+", shape=(n,))
        out[:] = -1
        return out


def suffix_order(s: np.ndarray, level: int = 0) -> np.ndarray:
    """Starts of the suffixes of s in ascending order; the last symbol is the smallest and occurs once."""
    n = len(s)
    if n < 64 or level:
        return _doubling(s)
    narrow = np.uint16 if s.max() < 1 << 16 else np.int64  # sorted by radix
    differs = np.append(s[1:] != s[:-1], True)
    nxt = np.flatnonzero(differs)
    begins = np.append(True, differs[:-1])
    first_of_run = np.repeat(np.append(0, nxt[:-1] + 1), np.diff(nxt, prepend=-1)).astype(np.int32 if n < 1 << 31 else np.int64)
    at = np.repeat(nxt, np.diff(nxt, prepend=-1))
    small = np.ones(n, bool)  # the suffix is smaller than the next
    small[: n - 1] = s[at[:-1]] < s[np.minimum(at[:-1] + 1, n - 1)]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    size = np.bincount(s)
    ends = np.cumsum(size)
    heads = ends - size

    def induce(order: np.ndarray) -> np.ndarray:
        """All suffixes from the leftmost-smaller ones, in ``order``."""
        out, head, tail = _queue(n), heads.copy(), ends.copy()
        first = np.searchsorted(s[order], np.arange(len(size) + 1))

        def push(pos, forward):
            pos = pos[pos > 0] - 1
            pos = pos[~small[pos]] if forward else pos[small[pos]]
            if not len(pos):
                return
            c = s[pos]
            by = np.argsort(c.astype(narrow), kind="stable")
            pos, c = pos[by], c[by]
            cut = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            kinds, count = c[cut], np.diff(np.append(cut, len(c)))
            nth = np.arange(len(c)) - np.repeat(cut, count)
            if forward:
                out[head[c] + nth] = pos
                head[kinds] += count
            else:
                out[tail[c] - 1 - nth] = pos
                tail[kinds] -= count

        def runs(pos):
            """The suffixes that start earlier in the run of equal symbols that ends at each of pos: all of the
            shortest way back first, each in the order of pos. They follow in the same bucket."""
            pos = pos[~begins[pos]]
            if not len(pos):
                return pos
            back = pos - first_of_run[pos]
            k = np.repeat(np.arange(len(pos)), back)
            step = np.arange(len(k)) - np.repeat(np.cumsum(back) - back, back) + 1
            by = np.argsort(step, kind="stable")
            return (pos[k] - step)[by]

        # a bucket takes all of its runs at once, then gives the suffixes before them to other buckets
        for c in np.flatnonzero(size):
            more = runs(out[heads[c] : head[c]])
            out[head[c] : head[c] + len(more)] = more
            head[c] += len(more)
            every = out[heads[c] : head[c]]
            push(every[begins[every]], True)
            push(order[first[c] : first[c + 1]], True)
        for c in np.flatnonzero(size)[::-1]:
            more = runs(out[tail[c] : ends[c]][::-1])
            out[tail[c] - len(more) : tail[c]] = more[::-1]
            tail[c] -= len(more)
            every = out[tail[c] : ends[c]][::-1]
            push(every[begins[every]], False)
            push(out[heads[c] : head[c]][::-1], False)
        out[0] = n - 1
        return out

    order = induce(lms[np.argsort(s[lms].astype(narrow), kind="stable")])
    is_lms = np.zeros(n + 1, bool)
    is_lms[lms] = True
    sorted_lms = np.asarray(order[is_lms[order]])
    end_of = np.append(lms[1:], n - 1)
    where = np.full(n, 0)
    where[lms] = np.arange(len(lms))
    a, b = sorted_lms[:-1], sorted_lms[1:]
    la, lb = end_of[where[a]] - a, end_of[where[b]] - b
    same = la == lb
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        ok = s[np.minimum(a[open_] + k, n - 1)] == s[np.minimum(b[open_] + k, n - 1)]
        same[open_[~ok]] = False
        open_ = open_[ok & (k < la[open_])]
        k += 1
    names = np.zeros(n, np.int64)
    names[sorted_lms] = np.concatenate([[0], np.cumsum(~same)])
    reduced = names[lms]
    ranked = lms[np.argsort(reduced, kind="stable")] if reduced.max() == len(lms) - 1 else lms[suffix_order(reduced, level + 1)]
    return induce(ranked)


def least_documents(segments: list[bytes], lows: np.ndarray) -> list[np.ndarray]:
    """For each window of each segment the smallest document of all windows equal to it."""
    lengths = np.array([len(x) for x in segments])
    text = np.zeros(int((lengths + 1).sum()) + 1, np.uint16)
    starts = np.cumsum(lengths + 1) - lengths - 1
    raw = np.frombuffer(b"\0".join(segments) + bytes(2 + LENGTH), np.uint8)
    text[:-1] = raw[: len(text) - 1]
    text[:-1] += 2
    text[starts + lengths] = 1
    order = suffix_order(text)
    segment = np.append(np.repeat(np.arange(len(segments)), lengths + 1), len(segments) - 1)
    whole = np.arange(len(text)) - starts[segment] <= lengths[segment] - LENGTH
    order = np.asarray(order[whole[order]])
    equal = np.ones(max(len(order) - 1, 0), bool)
    eight = octets(raw)  # windows hold text only
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        part = eight[order + k]
        equal &= part[1:] == part[:-1]
    begin = np.flatnonzero(np.append(True, ~equal))
    low = np.minimum.reduceat(lows[segment[order]], begin)
    out = np.zeros(len(text), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(begin, len(order))))
    return [out[a : a + n - LENGTH + 1] for a, n in zip(starts, lengths)]


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place i the n[i] numbers from first[i] on: (i, number)."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) + (first - (np.cumsum(n) - n))[i]


def repeated(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows that may be equal to another window of the segments: segment, start in it, bytes. A window
    whose hash no other has is equal to none; whether the rest are equal is left to the sort."""
    lengths = np.array([len(x) for x in segments], np.int64)
    starts = np.cumsum(lengths) - lengths
    of, window = _ranges(starts, lengths - LENGTH + 1)
    eight, low = octets(np.frombuffer(b"".join(segments), np.uint8)), np.zeros(len(window), np.uint64)
    for k, c in zip([*range(0, LENGTH - 8, 8), LENGTH - 8], powers(_R, LENGTH)[1:]):
        low += eight[window + k] * c
    by = np.argsort(low)
    low = low[by]
    same = np.flatnonzero(low[1:] == low[:-1])
    twice = np.zeros(len(window), bool)
    twice[by[same]] = twice[by[same + 1]] = True
    of, window = of[twice], window[twice]
    begin = np.flatnonzero(np.append(True, window[1:] != window[:-1] + 1)[: len(window)])
    end = np.append(begin[1:], len(window))[: len(begin)] - 1
    return of[begin], window[begin] - starts[of[begin]], window[end] - window[begin] + LENGTH


# ---------------------------------------------------------------- over Spark


def _segments(batch: pa.RecordBatch, part: int = PIECE):
    """Arrays (row, start, bytes, key) of the segments of a batch's texts, piece by piece, with the piece's bytes."""
    data, offsets = raw_text(batch.column("text"))
    for lo, hi in pieces(offsets, part):
        mine, cut = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        got = [run_keys(mine[at : at + part + LENGTH - 1], np.array([0, min(part + LENGTH - 1, len(mine) - at)])) for at in range(0, len(mine), part)] if hi == lo + 1 and len(mine) > part else []
        if got:  # a long text in parts that overlap, so that every window lies in one of them
            row, n, key = (np.concatenate([x[k] for x in got]) for k in (0, 2, 3))
            start = np.concatenate([x[1] + i * part for i, x in enumerate(got)])
        else:
            row, start, n, key = run_keys(mine, cut)
        yield mine, cut, lo + row, row, start, n, key.view(np.int64)


def _keys(batches):
    """(key, doc_id, known): a key in two documents of one piece is known to be shared. Of such only two rows go to
    the key's partition, the rest to their document's, which need not learn anything more. In the order of the
    documents, which makes the rows of a partition alike and small when compressed."""
    for batch in batches:
        batch = batch.filter(pc.greater(batch.column("text_no"), 0))
        ids = batch.column("doc_id").to_numpy()
        for _, _, row, _, _, _, key in _segments(batch):
            doc = ids[row]
            by = np.lexsort((doc, key))
            key, doc = key[by], doc[by]
            first = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)]
            key, doc = key[first], doc[first]
            begin = np.append(True, key[1:] != key[:-1])[: len(key)]
            nth = np.arange(len(key)) - np.repeat(np.flatnonzero(begin), np.diff(np.append(np.flatnonzero(begin), len(key))))
            by = np.argsort(doc, kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array(key[by]), pa.array(doc[by]), pa.array(nth[by] >= 2)], names=["key", "doc_id", "known"])


def _shared(batches):
    """(key, doc_id) of keys that occur in two documents, from rows in the order of their keys."""
    key, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = False  # the open key is shared already; its rows so far are out

    def settle(key, doc, held, last):
        """Rows to emit, and what stays open."""
        if not len(key):
            return (key, doc), key, doc, held
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.diff(np.append(begin, len(key)))
        shared = np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin)
        shared[0] |= held
        out = np.repeat(shared, length)
        if not last and not shared[-1]:
            keep = slice(begin[-1], begin[-1] + 1)
            return (key[out], doc[out]), key[keep], doc[keep], False
        return (key[out], doc[out]), key[-1:], doc[-1:], bool(shared[-1])

    for batch in batches:
        known = batch.column("known").to_numpy(zero_copy_only=False)
        k, d = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(k[known]), pa.array(d[known])], names=["key", "doc_id"])
        key, doc = np.concatenate([key, k[~known]]), np.concatenate([doc, d[~known]])
        (a, b), key, doc, held = settle(key, doc, held, False)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["key", "doc_id"])


def _found(batches):
    """(doc_id, text_no, start, n, segment): segments of wanted keys; a null segment is one that a smaller document
    of this task has too, so that it goes whole, or a run of such."""
    seen: dict[bytes, int] = {}
    held = 0
    for batch in batches:
        batch = batch.filter(pc.and_(pc.greater(batch.column("text_no"), 0), batch.column("keys").is_valid()))
        ids, no = batch.column("doc_id").to_numpy(), batch.column("text_no").to_numpy()
        keys = batch.column("keys")
        of, wanted = np.repeat(np.arange(len(ids)), keys.value_lengths().to_numpy(zero_copy_only=False)), keys.flatten().to_numpy()
        for data, offsets, row, local, start, n, key in _segments(batch):
            lo, hi = (row[0], row[-1] + 1) if len(row) else (0, 0)
            part = slice(np.searchsorted(of, lo), np.searchsorted(of, hi))
            pair = np.zeros(len(row) + part.stop - part.start, [("row", np.int64), ("key", np.int64)])
            pair["row"], pair["key"] = np.concatenate([row, of[part]]), np.concatenate([key, wanted[part]])
            by = np.lexsort((pair["key"], pair["row"]))
            p = pair[by]
            group = np.cumsum(np.append(0, (p["key"][1:] != p["key"][:-1]) | (p["row"][1:] != p["row"][:-1])))[: len(p)]
            asked = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
            asked[group[by >= len(row)]] = True
            take = np.zeros(len(pair), bool)
            take[by] = asked[group]
            take = np.flatnonzero(take[: len(row)])
            at, raw = (offsets[local] + start)[take], data.tobytes()
            segments, r, n = [], row[take], n[take]
            for a, size, doc in zip(at.tolist(), n.tolist(), ids[r].tolist()):
                x = raw[a : a + size]
                low = seen.get(x)
                if low is not None and low < doc:
                    segments.append(None)
                    continue
                if held >= SEEN:
                    seen.clear()
                    held = 0
                if low is None or not held:
                    held += size + 150  # and what an entry takes
                seen[x] = doc
                segments.append(x)
            # neighbouring null segments of a text become one
            begin, none = start[take], np.fromiter((x is None for x in segments), bool, len(segments))
            end = begin + n
            new = np.ones(len(segments), bool)
            new[1:] = ~none[1:] | ~none[:-1] | (r[1:] != r[:-1]) | (begin[1:] > end[:-1])
            first = np.flatnonzero(new)
            n = end[np.append(first[1:], len(new))[: len(first)] - 1] - begin[first]
            cols = [ids[r[first]], no[r[first]], begin[first].astype(np.int32), n.astype(np.int32), key[take][first]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([segments[i] for i in first], pa.binary())], names=["doc_id", "text_no", "start", "n", "key", "segment"])


def _sort(t: pa.Table) -> pa.Table:
    """Spans of a shard's rows that a smaller document has too; rows without segment are such spans themselves."""
    own = t.filter(t.column("segment").is_valid())
    rest = t.filter(t.column("segment").is_null())
    doc, start = own.column("doc_id").to_numpy(), own.column("start").to_numpy().astype(np.int64)
    index: dict[bytes, int] = {}
    kind = np.array([index.setdefault(x, len(index)) for x in own.column("segment").to_pylist()], np.int64)
    segments, lows = list(index), np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(lows, kind, doc)
    of, first, n = repeated(segments)
    index = {}
    part = np.array([index.setdefault(segments[i][a : a + m], len(index)) for i, a, m in zip(of.tolist(), first.tolist(), n.tolist())], np.int64)
    least = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(least, part, lows[of])
    size = np.array([len(x) - LENGTH + 1 for x in index], np.int64)
    flat = np.concatenate(least_documents(list(index), least)) if len(index) else least
    # a row of a segment that a smaller document has goes whole; the others by their windows, stretch by stretch
    mine, count, head = np.flatnonzero(doc == lows[kind]), np.bincount(of, minlength=len(segments)), np.cumsum(size) - size
    i, k = _ranges((np.cumsum(count) - count)[kind[mine]], count[kind[mine]])
    j, window = _ranges(head[part[k]], size[part[k]])
    at, k = mine[i[j]], k[j]
    gone = flat[window] < doc[at]
    at, begin = at[gone], (start[at] + first[k] + window - head[part[k]])[gone]
    new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (begin[1:] != begin[:-1] + 1))[: len(at)])
    end = (begin[np.append(new[1:], len(at)) - 1] if len(at) else begin) + LENGTH
    at, begin = at[new], begin[new]
    whole = np.flatnonzero(doc > lows[kind])
    end = np.concatenate([end, start[whole] + own.column("n").to_numpy()[whole]])
    at, begin = np.concatenate([at, whole]), np.concatenate([begin, start[whole]])
    spans = pa.table({"doc_id": doc[at], "text_no": own.column("text_no").to_numpy()[at], "start": begin.astype(np.int32), "n": (end - begin).astype(np.int32)})
    return pa.concat_tables([spans, rest.select(["doc_id", "text_no", "start", "n"]).cast(spans.schema)])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept: the bytes that stay."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    md5 = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    firsts = rows.where("doc_id is not null").groupBy(F.unhex(md5).alias("cls")).agg(F.min("doc_id").alias("doc_id"))
    firsts = firsts.groupBy("doc_id").agg(F.array_sort(F.collect_list("cls")).alias("firsts"))
    # every use of the texts has this form, so that they are dealt by document once; text_no is 0 where a smaller
    # document has the same text
    texts = rows.hint("merge").join(firsts, "doc_id", "left").withColumn("text_no", F.coalesce(F.array_position("firsts", F.unhex(md5)).cast("int"), F.lit(0))).drop("firsts")
    pairs = texts.select("doc_id", "text", "text_no").mapInArrow(_keys, "key long, doc_id long, known boolean")
    shared = pairs.repartition(F.when(F.col("known"), F.col("doc_id")).otherwise(F.col("key"))).sortWithinPartitions("key").mapInArrow(_shared, "key long, doc_id long")
    wanted = shared.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    held = texts.join(wanted.hint("merge"), "doc_id", "left")  # filtered in Python: a filter here would turn the join into another and deal the texts again
    found = held.select("doc_id", "text", "text_no", "keys").mapInArrow(_found, "doc_id long, text_no int, start int, n int, key long, segment binary")
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = max(1, -(-size // SHARD_BYTES))
    # what is settled already needs no sorting and is dealt at random
    shard = F.pmod(F.when(F.col("segment").isNull(), F.xxhash64("doc_id", "start")).otherwise(F.xxhash64("key")), F.lit(count))
    spans = found.withColumn("shard", shard).drop("key").groupBy("shard").applyInArrow(_sort, "doc_id long, text_no int, start int, n int")
    gone = spans.groupBy("doc_id").agg(F.collect_list(F.struct("text_no", "start", "n")).alias("spans"))
    joined = texts.join(gone.hint("merge"), "doc_id", "left").select("doc_id", "text", "text_no", "spans")

    def keep(batches):
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            numbers, known = batch.column("text_no").to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for i, spans in enumerate(batch.column("spans")):
                mine = data[offsets[i] : offsets[i + 1]]
                steps = np.zeros(len(mine) + 1, np.int64)
                if known[i] and not numbers[i] and len(mine) >= LENGTH:
                    steps[0] = 1
                elif spans.is_valid:
                    no, start, n = (x.to_numpy() for x in spans.values.flatten())
                    start, n = start[no == numbers[i]], n[no == numbers[i]]
                    np.add.at(steps, start, 1)
                    np.add.at(steps, start + n, -1)
                covered = np.cumsum(steps)[:-1] > 0
                kept = mine[~covered].tobytes()
                for k, v in (("n_bytes", len(mine)), ("n_removed", int(covered.sum())), ("n_spans", int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum())), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())], names=["doc_id", *out])

    return joined.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
