"""Token counts by finite-state transducers compiled from a byte-pair vocabulary.

Two deterministic machines in a row. The first marks where pre-tokens start; what it does at a character depends on its
neighbours alone, so it runs as array comparisons (``tokens.token_starts``). The second reads the bytes of a pre-token and
tells how many tokens its beginning so far encodes to. Its states come from this property of byte-pair encodings:
the last token of an encoding is the one vocabulary entry that ends the string and stands validly behind the
last token of what is before it. A state is therefore the set of places from which an entry can still grow: for each
the node in the vocabulary's tree, the last token before it, and the number of tokens up to it, relative to now. A transition is
annotated with the tokens it adds (negative where tokens melt into one). States and transitions are compiled when first
met and kept in a hash table of arrays, which is started anew beyond MAX_STATES.

All pre-tokens of a batch run through the table in lockstep. A pre-token longer than CHUNK bytes is cut into chunks, each of
which is a map from the state it is entered in to the state it is left in and the tokens between. Maps are worked out for
the states that can occur: first as if a chunk were a beginning, then from what the chunk before gives, until
nothing new appears; the chunks' maps then compose in doubled steps, as a parallel prefix scan does.

Defined results: a null or empty text has no bytes and no tokens; the vocabulary's special strings are one token each
wherever they stand, as the library's default has it; null doc_ids and repeated rows are counted one by one; a text of
any length is counted whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm.common import arrow_map, pieces, raw_text, table
from lattiq.llm.tokens import _classes, default_tokenizer, token_starts

LIMIT = 1024
CHUNK, PIECE = 64, 1 << 20
#: States (about 350 bytes each) beyond which a batch starts with an empty table; bounds memory, not results.
MAX_STATES = 1 << 18
#: Answers about pairs that are remembered, and entries below a node up to which all are looked at.
MAX_KNOWN, MANY = 1 << 19, 64
_UNKNOWN = 255


def _packed(node: int, before: int, count: int) -> int:
    return (node << 17 | before + 1) << 8 | count + 128


class Transducer:
    """``keys`` and ``moves`` are a hash table with open addressing: state * 256 + byte to next state * 256 + added
    tokens + 128. A state is a tuple of numbers, node, token before + 1 and tokens + 128 in one."""

    def __init__(self, model: dict):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: the bytes that stand for themselves
        letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
        self.entry = {t: bytes(letter[c] for c in s) for s, t in model["vocab"].items()}
        ids = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.made = {t: (rank, *pair) for pair, (rank, t) in self.merge.items()}
        self.sorted = sorted(self.entry, key=self.entry.get)
        self.tree: dict[int, int] = {}  # node * 256 + byte: child; the root is 0
        self.token, self.below = [-1], [[0, 0]]
        for k, t in enumerate(self.sorted):  # entries that go on from a node stand in a row
            at = 0
            for b in self.entry[t]:
                nxt = self.tree.get(at << 8 | b)
                if nxt is None:
                    nxt = self.tree[at << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.below.append([k, k])
                at = nxt
                self.below[at][1] = k + 1
            self.token[at] = t
            self.below[at][0] = k + 1
        self.follows: dict[tuple[int, int], bool] = {}
        self.grows: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.states = [(_packed(0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.table(1 << 12)

    def table(self, size: int) -> None:
        self.keys, self.moves, self.used = np.full(size, -1, np.int64), np.zeros(size, np.int32), 0

    def slots(self, key: np.ndarray) -> np.ndarray:
        """Where each key is, or the free place where it belongs."""
        mask = len(self.keys) - 1
        slot = ((key * 0x9E3779B1) >> 12) & mask
        found = self.keys[slot]
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            found = self.keys[slot[todo]]
            todo = todo[(found != key[todo]) & (found >= 0)]
        return slot

    def learn(self, keys: np.ndarray, moves: np.ndarray) -> None:
        """Adds keys that the table lacks."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            known = self.keys >= 0
            keys, moves = np.append(self.keys[known], keys), np.append(self.moves[known], moves)
            size = len(self.keys)
            while 2 * len(keys) > size:
                size *= 2
            self.table(size)
        self.used += len(keys)
        while len(keys):  # of keys that belong in one place, one gets it in each round
            slot = self.slots(keys)
            self.keys[slot] = keys
            self.moves[slot] = moves
            late = self.keys[slot] != keys
            keys, moves = keys[late], moves[late]

    def valid(self, before: int, token: int) -> bool:
        """Whether ``token`` can stand behind ``before`` (-1: at the start).

        Merges are undone, the latest first: a pair that touches where the two meet must not have been merged before the
        one that was made then. Of equal merges the left one comes first."""
        known = self.follows.get((before, token))
        if known is None:
            if len(self.follows) > MAX_KNOWN:
                self.follows.clear()
            known, left, right, until = True, before, token, 1 << 30
            while left >= 0:
                rank = self.merge.get((left, right), (1 << 30, 0))[0]
                if rank < until:
                    known = False
                    break
                one, other = self.made.get(left, (-1,)), self.made.get(right, (-1,))
                if one[0] > other[0]:
                    until, left = one[0], one[2]
                elif other[0] >= 0:
                    until, right = other[0] + 1, other[1]
                else:
                    break
            self.follows[before, token] = known
        return known

    def can_grow(self, node: int, before: int) -> bool:
        """Whether an entry further down the tree can stand behind ``before``; not looked at where there are many."""
        low, high = self.below[node]
        if high - low > MANY:
            return True
        known = self.grows.get((node, before))
        if known is None:
            if len(self.grows) > MAX_KNOWN:
                self.grows.clear()
            known = self.grows[node, before] = any(self.valid(before, t) for t in self.sorted[low:high])
        return known

    def compile(self, keys: np.ndarray) -> None:
        """The transitions of these state * 256 + byte."""
        moves = []
        for key in keys.tolist():
            byte, grown, last, added = key & 255, [], -1, 0
            for x in self.states[key >> 8]:
                child = self.tree.get(x >> 25 << 8 | byte)
                if child is None:
                    continue
                before, count = (x >> 8 & 0x1FFFF) - 1, (x & 255) - 128
                if self.can_grow(child, before):
                    grown.append((child, before, count))
                token = self.token[child]
                if last < 0 and token >= 0 and self.valid(before, token):
                    last, added = token, count + 1
            if last < 0:
                raise ValueError("the vocabulary lacks a byte, or its merges are not those of byte-pair encoding")
            to = (*(_packed(node, before, count - added) for node, before, count in grown), _packed(0, last, 0))
            nxt = self.number.setdefault(to, len(self.states))
            if nxt == len(self.states):
                self.states.append(to)
            moves.append(nxt << 8 | added + 128)
        self.learn(keys, np.array(moves, np.int32))

    def run(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states in which these pieces, entered in ``state``, are left, and the tokens they add."""
        order = np.argsort(-size, kind="stable")
        at, left, now, count = begin[order], size[order], state[order].astype(np.int64), np.zeros(len(size), np.int64)
        for k in range(int(left[0]) if len(left) else 0):
            m = int(np.searchsorted(-left, -k, "left"))  # those longer than k
            key = now[:m] << 8 | data[at[:m] + k]
            slot = self.slots(key)
            new = self.keys[slot] < 0
            if new.any():
                self.compile(np.unique(key[new]))
                slot = self.slots(key)
            got = self.moves[slot]
            now[:m] = got >> 8
            count[:m] += (got & 255) - 128
        out, tokens = np.empty_like(now), np.empty_like(count)
        out[order], tokens[order] = now, count
        return out, tokens

    def count(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The tokens of each span."""
        if len(self.states) > MAX_STATES:
            self.forget()
        size = end - begin
        out = np.zeros(len(size), np.int64)
        short = size <= CHUNK
        out[short] = self.run(data, begin[short], size[short], np.zeros(int(short.sum()), np.int64))[1]
        if not short.all():
            out[~short] = self.scan(data, begin[~short], end[~short])
        return out

    def scan(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``count`` of long spans, by composing the maps of their chunks."""
        chunks = -((begin - end) // CHUNK)
        first = np.cumsum(chunks) - chunks
        n = int(chunks.sum())
        start = np.repeat(begin - first * CHUNK, chunks) + np.arange(n) * CHUNK
        size = np.minimum(start + CHUNK, np.repeat(end, chunks)) - start
        final = np.zeros(n, bool)
        final[first + chunks - 1] = True
        # entries (chunk, state) with their exits; each round adds those that the last one leads to
        at, state, seen, parts = np.arange(n), np.zeros(n, np.int64), {}, []
        while len(at):
            exits, tokens = self.run(data, start[at], size[at], state)
            parts.append((at, exits, tokens))
            for key in zip(at.tolist(), state.tolist()):
                seen[key] = len(seen)
            lead = ~final[at]
            todo = dict.fromkeys(key for key in zip((at[lead] + 1).tolist(), exits[lead].tolist()) if key not in seen)
            at, state = (np.array([key[i] for key in todo], np.int64) for i in (0, 1))
        at, exits, tokens = (np.concatenate(x) for x in zip(*parts))
        over = len(at)  # behind the last chunk of a span
        ahead = np.array([over if final[c] else seen[c + 1, s] for c, s in zip(at.tolist(), exits.tolist())] + [over], np.int64)
        total = np.append(tokens, 0)
        while (ahead != over).any():  # each map is composed with the one it leads to
            total = total + total[ahead]
            ahead = ahead[ahead]
        return total[first]  # the first n entries are the chunks from the start state


class Counter:
    """Tokens of whole texts, as the library counts them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary is wanted")
        self.machine = Transducer(spec["model"])
        special = [x["content"].encode() for x in spec["added_tokens"]]
        self.special = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.classes[: 1 << 16] = _classes(self.library)

    def learn(self, codes: np.ndarray) -> None:
        """Classes of code points beyond the first plane, as the library splits."""
        rare = codes[codes >= 1 << 16]
        for c in np.unique(rare[self.classes[rare] == _UNKNOWN]).tolist():
            cuts = {x[1][0] for x in self.library.pre_tokenizer.pre_tokenize_str(f"a{chr(c)}1")}
            self.classes[c] = 1 if 1 not in cuts else 2 if 2 not in cuts else 3

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The tokens of each text; ``data`` is UTF-8."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        raw = data.tobytes()
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        codes = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        self.learn(codes)
        cuts = [offsets[:-1]]
        alone = np.zeros(0, np.int64)
        if self.special:
            spans = np.array([m.span() for m in self.special.finditer(raw)], np.int64).reshape(-1, 2)
            spans = spans[np.searchsorted(offsets, spans[:, 0], "right") == np.searchsorted(offsets, spans[:, 1], "left")]
            cuts += [spans[:, 0], spans[:, 1]]
            alone = spans[:, 0]
        cuts = np.unique(np.concatenate(cuts))
        firsts = np.zeros(len(codes) + 1, bool)
        firsts[np.searchsorted(lead, cuts)] = True
        starts = token_starts(codes, firsts[:-1], self.classes)
        for a in alone.tolist():  # a special string is one piece
            i, j = np.searchsorted(lead, [a, self.special.match(raw, a).end()])
            starts[i + 1 : j] = False
        begin = lead[:-1][starts]
        end = np.append(begin[1:], len(data))
        special = np.isin(begin, alone)
        tokens = np.ones(len(begin), np.int64)
        tokens[~special] = self.machine.count(data, begin[~special], end[~special])
        return np.diff(np.append(0, np.cumsum(tokens))[np.searchsorted(begin, offsets)])


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text; ``tokenizer`` is the path of a byte-level BPE vocabulary."""
    path = tokenizer or default_tokenizer()

    def kernel(batches):
        for batch in batches:
            data, offsets = raw_text(batch.column("text"))
            found = [counter(path).count(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets, PIECE)]
            tokens = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
