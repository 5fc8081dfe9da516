"""Token-ID output: bit-plane shuffled blocks, one zstandard frame per plane, a chunk index.

Documents are range-partitioned by doc_id; each partition becomes one shard file in the shared
folder. A task streams its documents: texts are cut into pre-tokens with array operations, only
pre-tokens not met before go through the tokenizers library, ids are cut into blocks of BLOCK, each
block is transposed into bit planes and each plane compressed. A shard is written under a name with
the attempt number and moved to its own name when complete, so a lost or repeated task leaves no
torn shard; the manifest names only complete ones.

File: MAGIC; the planes of all blocks; the index (zstandard): per block its offset, number of ids and
the length of every plane, then per document its id, a null flag and its number of ids; the index's
offset and length as two unsigned 64-bit integers.

Defined results: a null or empty text is the end id alone; null doc_ids come first; rows with equal
doc_id are written one after the other, in the order of their texts (null first); a text of any length
is encoded whole; an empty table gives no shard and no rows; further columns are ignored.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lattiq.llm.common import arrow_map, new_path, pieces, raw_text, span_hashes, table

MAGIC = b"LQBP0001"
#: Ids to a block, and the level of compression of a plane.
BLOCK, LEVEL = 16384, 3
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Pre-tokens a worker remembers before it starts anew (about 40 bytes each); bounds its memory, not its results.
REMEMBERED = 800_000
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


# ---------------------------------------------------------------- tokenizing


def _classes(library) -> np.ndarray:
    """Letter, number, space or other, for each code point of the first plane, as the library splits."""
    import regex

    out = np.full(1 << 16, _OTHER, np.uint8)
    out[[ord(c) for c in regex.findall(r"\p{White_Space}", "".join(map(chr, range(0xD800))))]] = _SPACE
    rest = [c for c in [*range(0xD800), *range(0xE000, 1 << 16)] if out[c] == _OTHER and c not in (10, 39)]
    # of "a?1": a letter joins the a, a number the 1
    starts = {x[1][0] for x in library.pre_tokenizer.pre_tokenize_str("".join(f"a{chr(c)}1\n" for c in rest))}
    for i, c in enumerate(rest):
        out[c] = _LETTER if 4 * i + 1 not in starts else _NUMBER if 4 * i + 2 not in starts else _OTHER
    return out


def token_starts(codes: np.ndarray, firsts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Flags of where pre-tokens start; ``firsts`` flags the first code point of each text.

    The rules are those of the byte-level pattern: a word, number or run of symbols takes one blank
    before it; white space keeps its last character for what follows; after a bare apostrophe the
    endings s, t, m, d, re, ve and ll go with it.
    """
    n = len(codes)
    kind = classes[codes]
    change = firsts.copy()
    change[1:] |= kind[1:] != kind[:-1]
    starts, begin = change.copy(), np.flatnonzero(change)
    end = np.append(begin[1:], n)
    inner = end < n
    inner[inner] = ~firsts[end[inner]]
    last = end[(kind[begin] == _SPACE) & inner]
    starts[last - 1] = True
    starts[last[codes[last - 1] == 32]] = False
    bare = (end - begin == 1) & inner
    at = begin[bare]
    at = at[(codes[at] == 39) & starts[at] & (kind[at + 1] == _LETTER)] + 1
    if len(at):
        a = codes[at]
        more = (at + 1 < n) & ~change[np.minimum(at + 1, n - 1)]
        b = np.where(more, codes[np.minimum(at + 1, n - 1)], 0)
        short = np.isin(a, [115, 116, 109, 100])
        long = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        starts[at[short | long]] = False
        after = np.where(long & ~short, at + 2, at + 1)[short | long]
        starts[after[after < n]] = True
    return starts


class Encoder:
    """Ids of whole texts, equal to those of the library, which sees each distinct pre-token once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.classes = _classes(self.library)
        names = self.library.get_vocab()
        self.id_bytes = np.zeros(max(names.values()) + 1, np.int64)
        self.id_bytes[list(names.values())] = [len(x) for x in names]
        self.forget()

    def forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # keys ascending
        self.begins, self.flat, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Ids of new words, with ascending keys. Those with one blank before them are encoded as one text, as they
        split apart again."""
        joined = np.array([len(w) > 1 and w[0] == " " and not w[1].isspace() for w in words])
        run, rest = np.flatnonzero(joined).tolist(), np.flatnonzero(~joined).tolist()
        parts, lengths = [], []
        if run:
            got = self.whole(["".join([words[i] for i in run])])[0]
            cuts = np.searchsorted(np.cumsum(self.id_bytes[got]), np.cumsum([len(words[i].encode()) for i in run])) + 1
            parts.append(got)
            lengths.append(np.diff(cuts, prepend=0))
        if rest:
            each = self.whole([words[i] for i in rest])
            parts += each
            lengths.append(np.array([len(x) for x in each], np.int64))
        ends = self.used + np.cumsum(np.concatenate(lengths))
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(ends[-1], 2 * len(self.flat)) - self.used, np.uint32)])
        self.flat[self.used : ends[-1]] = np.concatenate(parts)
        first = len(self.begins) - 1
        slots = np.empty(len(keys), np.int32)
        slots[run + rest] = np.arange(first, first + len(keys))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)
        self.begins, self.used = np.concatenate([self.begins, ends]), int(ends[-1])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        text = "".join(texts)
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if codes.max() >= 1 << 16:  # beyond the table of classes
            each = self.whole(texts)
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        sizes = np.array([len(x) for x in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        firsts = np.zeros(len(codes), bool)
        firsts[bounds[:-1][sizes > 0]] = True
        start = np.flatnonzero(token_starts(codes, firsts, self.classes))
        end = np.append(start[1:], len(codes))
        keys = span_hashes(codes, start, end)
        distinct, first, where = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != distinct[inside]
        if new.any():
            self.learn(distinct[new], [text[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
        slot = self.slots[np.searchsorted(self.keys, distinct)][where]
        length = self.begins[slot + 1] - self.begins[slot]
        out_end = np.cumsum(length)
        pick = np.arange(out_end[-1]) + np.repeat(self.begins[slot] - (out_end - length), length)
        counted = np.concatenate([[0], out_end])
        return self.flat[pick], np.diff(counted[np.searchsorted(start, bounds)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- the format


def to_planes(ids: np.ndarray) -> list[bytes]:
    """Bit planes of a block, lowest bit first, as many as its largest id needs."""
    return [np.packbits((ids >> np.uint32(b) & np.uint32(1)).astype(np.uint8)).tobytes() for b in range(max(1, int(ids.max()).bit_length()))]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for b, plane in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(b)
    return out


class ShardWriter:
    def __init__(self, sink):
        self.sink, self.at = sink, len(MAGIC)
        self.pack, self.blocks, self.docs = zstandard.ZstdCompressor(level=LEVEL), [], []
        self.rest = np.zeros(0, np.uint32)
        sink.write(MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.docs.append((np.array([x or 0 for x in doc_ids], np.int64), np.array([x is None for x in doc_ids], np.uint8), sizes.astype(np.int64)))
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self.block(ids[i : i + BLOCK])
        self.rest = ids[whole:]

    def block(self, ids: np.ndarray) -> None:
        planes = [self.pack.compress(x) for x in to_planes(ids)]
        self.blocks.append((self.at, len(ids), [len(x) for x in planes]))
        for x in planes:
            self.sink.write(x)
            self.at += len(x)

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self.block(self.rest)
        index = io.BytesIO()
        index.write(struct.pack("<QQ", len(self.blocks), sum(len(x[0]) for x in self.docs)))
        for at, n, lengths in self.blocks:
            index.write(struct.pack(f"<QII{len(lengths)}I", at, n, len(lengths), *lengths))
        for k in range(3):
            for x in self.docs:
                index.write(x[k].tobytes())
        packed = self.pack.compress(index.getvalue())
        self.sink.write(packed + struct.pack("<QQ", self.at, len(packed)))
        return sum(len(x[0]) for x in self.docs), int(sum(x[2].sum() for x in self.docs))


class ShardReader:
    """Random access by block; ``documents`` streams whole documents in order."""

    def __init__(self, source):
        self.source = source
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token shard")
        source.seek(source.size() - 16)
        at, size = struct.unpack("<QQ", source.read(16))
        source.seek(at)
        index = zstandard.ZstdDecompressor().decompress(source.read(size))
        (n_blocks, n_docs), pos, self.blocks = struct.unpack_from("<QQ", index), 16, []
        for _ in range(n_blocks):
            at, n, k = struct.unpack_from("<QII", index, pos)
            self.blocks.append((at, n, struct.unpack_from(f"<{k}I", index, pos + 16)))
            pos += 16 + 4 * k
        self.doc_ids = np.frombuffer(index, np.int64, n_docs, pos)
        self.nulls = np.frombuffer(index, np.uint8, n_docs, pos + 8 * n_docs).astype(bool)
        self.sizes = np.frombuffer(index[pos + 9 * n_docs :], np.int64, n_docs)

    def block(self, i: int) -> np.ndarray:
        at, n, lengths = self.blocks[i]
        self.source.seek(at)
        unpack = zstandard.ZstdDecompressor()
        return from_planes([unpack.decompress(self.source.read(k)) for k in lengths], n)

    def documents(self) -> Iterator[np.ndarray]:
        got, i = np.zeros(0, np.uint32), 0
        for size in self.sizes:
            parts = [got]
            have = len(got)
            while have < size:
                parts.append(self.block(i))
                have += len(parts[-1])
                i += 1
            got = np.concatenate(parts) if len(parts) > 1 else got
            yield got[:size]
            got = got[size:]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")


# ---------------------------------------------------------------- over Spark


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> list[dict]:
    """Writes shards in ascending doc_id order; the manifest has a dict for each shard, in order.

    The manifest has one entry to a partition, whatever the number of documents.
    """
    tokenizer = tokenizer or default_tokenizer()

    def shard(batches):
        task, name, writer = TaskContext.get(), None, None
        where, root = _open(folder)
        enc = encoder(tokenizer)
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            ids_of_rows = batch.column("doc_id").to_pylist()
            for lo, hi in pieces(offsets, 1 << 20):
                if writer is None:
                    name = f"{root}/shard-{task.partitionId():07d}"
                    where.create_dir(root, recursive=True)
                    sink = where.open_output_stream(attempt := f"{name}.{task.taskAttemptId()}.part")
                    writer = ShardWriter(sink)
                blob = data[offsets[lo] : offsets[hi]].tobytes()
                cut = (offsets[lo : hi + 1] - offsets[lo]).tolist()
                ids, sizes = enc.encode([str(blob[a:b], "utf-8", "replace") for a, b in zip(cut, cut[1:])])
                with_end = np.insert(ids, np.cumsum(sizes), end_id)
                writer.add(ids_of_rows[lo:hi], with_end, sizes + 1)
        if writer is not None:
            n_docs, n_ids = writer.close()
            sink.close()
            where.move(attempt, f"{name}.bin")
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    # rows of one doc_id lie in one partition, in the order of their texts
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = arrow_map(dealt, shard, "shard long, n_docs long, n_ids long").collect()
    manifest, start = [], 0
    for r in sorted(rows, key=lambda r: r["shard"]):
        manifest.append({"path": f"{folder}/shard-{r['shard']:07d}.bin", "start": start, "n_docs": r["n_docs"], "n_ids": r["n_ids"]})
        start += r["n_ids"]
    return manifest


def read_tokens(spark: SparkSession, manifest: list[dict], with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read from the shards."""
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    entries = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                where, name = _open(path)
                with where.open_input_file(name) as source:
                    shard = ShardReader(source)
                    starts = start + np.concatenate([[0], np.cumsum(shard.sizes)[:-1]]) if len(shard.sizes) else np.zeros(0, np.int64)
                    rows, held = [], 0
                    for i, ids in enumerate(shard.documents()):
                        rows.append((None if shard.nulls[i] else int(shard.doc_ids[i]), int(starts[i]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int64) if with_ids else None))
                        held += len(ids) if with_ids else 1
                        if held >= 1 << 20 or i + 1 == len(shard.sizes):
                            columns = [pa.array(list(x), pa.int64()) for x in list(zip(*rows))[:4]]
                            if with_ids:
                                columns.append(pa.array([r[4] for r in rows], pa.list_(pa.int64())))
                            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                            rows, held = [], 0

    if len(manifest) > 1:
        entries = entries.repartitionByRange(len(manifest), "start")
    return arrow_map(entries, read, fields)


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "tokens"))
    return read_tokens(spark, manifest, with_ids=False)
