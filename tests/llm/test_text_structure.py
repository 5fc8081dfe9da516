"""Periodic runs, token counts and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from lattiq.llm import runs, spelling, tokencount
from lattiq.llm.tokens import default_tokenizer

SCHEMA = "doc_id long, text string, lang string, n long, start long, word string, run string, h long, size long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, 1, 2, "w", "r", 3, 4) for i, t in rows], SCHEMA)


# ------------------------------------------------------------ periodic runs


def brute_runs(w):
    out, n = {}, len(w)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and j > i:
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in out.items())


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
    gone = {k for a, b, q in found for k in range(a + q, b)}
    best = min(found, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    one = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *one, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def stretch(rng):
    w = []
    for _ in range(rng.randrange(1, 7)):
        base = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 20))]
        w += (base * rng.randrange(1, 12))[: rng.randrange(1, 150)]
        if rng.random() < 0.4:
            a = rng.randrange(len(w))
            w += w[a : a + rng.randrange(120)]
    return w


def test_runs_of_many_sequences():
    rng = random.Random(3)
    docs = [stretch(rng) for _ in range(1200)] + [[], [1] * 30, [1] * 23, [1, 2] * 12, [rng.randrange(2) for _ in range(400)]]
    got = []
    for k in range(0, len(docs), 90):
        part = docs[k : k + 90]
        got += runs.runs_of(np.array([x for d in part for x in d], np.int64), np.array([len(d) for d in part]))
    assert got == [sorted(brute_runs(d), key=lambda r: (r[0], r[2])) for d in docs]
    assert max(map(len, got)) > 5


def test_runs_of_documents(spark):
    rng = random.Random(4)
    blank = lambda: rng.choice([" ", "\n", " \t ", "\x0b", "\x0c\r"])
    texts = [None, "", " \n ", "ein", "a " * 5000, "é x " * 40, "".join(f"w{i}é " for i in range(900))]
    texts += ["".join(f"w{x}" + blank() for x in stretch(rng)) for _ in range(300)]
    rows = [*enumerate(texts), (None, "b " * 30), (7, texts[7]), (7, "c " * 50)]
    got = runs.periodic_runs(table(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute_row(*r)) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 100 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts)))
    assert runs.periodic_runs(table(spark, [])).count() == 0


def test_a_long_document_is_worked_on_whole(spark, monkeypatch):
    monkeypatch.setattr(runs, "PIECE", 100)
    text = " ".join(str(i * i % 977) for i in range(30000))
    assert tuple(runs.periodic_runs(table(spark, [(5, text), (6, "x " * 24)])).orderBy("doc_id").first())[:5] == brute_row(5, text)[:5]


# ------------------------------------------------------------ token counts


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_tokenizer())
    rng = random.Random(5)
    alphabet = "ab st re'’ \n\t\r1²½.,éß漢😀　\x85𝐀𝟘"
    texts = [None, "", "   ", "x" * 20000, "ab" * 3000, "=" * 777, "the" * 500, " " * 300 + "a", "<|endoftext|>", "a  <|endoftext|> 's<|endof", "text|>" + "<|endoftext|>" * 3]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(2000)]
    texts += ["".join(rng.choice("abcdefgehtion") for _ in range(rng.randrange(300))) for _ in range(300)]
    words = sorted(library.get_vocab())
    texts += ["".join(rng.choice(words) for _ in range(rng.randrange(600))) for _ in range(60)]
    rows = [*enumerate(texts), (None, "null id"), (4, "again"), (4, "again")]
    got = sorted(map(str, map(tuple, tokencount.count_tokens(table(spark, rows)).collect())))
    sizes = [len(x.ids) for x in library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)]
    assert got == sorted(str((i, len((t or "").encode()), n, n > 1024)) for (i, t), n in zip(rows, sizes))
    assert any(n > 1024 for n in sizes)
    assert tokencount.count_tokens(table(spark, [])).count() == 0


def test_token_counts_do_not_depend_on_chunks_or_on_forgetting(monkeypatch):
    count = tokencount.Counter(default_tokenizer())
    rng = random.Random(6)
    texts = ["".join(rng.choice("abtheion1=") for _ in range(rng.randrange(2000))).encode() for _ in range(30)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    want = [len(x.ids) for x in count.library.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
    for chunk, states in ((64, 1 << 18), (3, 1 << 18), (64, 100)):
        monkeypatch.setattr(tokencount, "CHUNK", chunk)
        monkeypatch.setattr(tokencount, "MAX_STATES", states)
        assert count.count(data, offsets).tolist() == want
    machine = count.machine
    assert all(machine.valid(-1, t) for t in machine.entry)


def test_pretoken_classes_of_all_code_points():
    """Two characters that the library keeps together or cuts apart are so here, over all code points."""
    count = tokencount.Counter(default_tokenizer())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][:: 7]
    texts = [f"a{chr(c)}1 {chr(c)}" for c in points]
    raw = [t.encode() for t in texts]
    got = count.count(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw])))
    assert got.tolist() == [len(x.ids) for x in count.library.encode_batch(texts, add_special_tokens=False)]


# ------------------------------------------------------------ spelling variants


def brute_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, []
    close = {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None))
    return sorted(map(str, out))


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefghÀÿ"])
def test_spelling_against_all_pairs(spark, letters):
    rng = random.Random(letters)
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    words = []
    for w in base:
        for _ in range(4):
            k, c = rng.randrange(len(w)), rng.choice(letters)
            words += [rng.choice([w, w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + c + w[k:]])] * rng.choice([1, 2, 3, 5, 9, 20])
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "1", "-_"]).join(words[k : k + 25])) for i, k in enumerate(range(0, len(words), 25))]
    rows += [(None, " ".join(words[:90]).upper()), (3, None), (4, ""), (0, rows[0][1])]
    got = spelling.variants(table(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == brute_variants(rows)
    assert any(r.form for r in got)


def test_spelling_chains_and_nothing(spark):
    words = ["house"] * 100 + ["housee"] * 50 + ["houseee"] * 25 + ["houseeee"] * 12 + ["houseeeee"] * 6 + ["houseeeeee"] * 3 + ["other"] * 3
    got = {r.word: r for r in spelling.variants(table(spark, [(1, " ".join(words))]), typo=1 << 40).collect()}
    assert {r.root for r in got.values()} == {"house", "other"} and got["houseeeeee"].form == "houseeeee" and got["other"].n_near == 0
    assert spelling.variants(table(spark, [])).count() == 0


def test_no_table_of_words_is_gathered_in_the_driver(spark, monkeypatch):
    plans, real = [], spelling.Stash

    def recorded(df, tag):
        plans.append(df)
        return real(df, tag)

    monkeypatch.setattr(spelling, "Stash", recorded)
    plans.append(spelling.variants(table(spark, [(1, " ".join(["spelled", "spellt"] * 9 + ["spelledd"] * 4))]), typo=1 << 40))
    lines = [x for p in plans for x in p._jdf.queryExecution().optimizedPlan().toString().split("\n") if re.search(r"\bJoin\b", x)]
    kinds = Counter((re.search(r"strategy=(\w+)", x) or [0, "none"])[1] for x in lines)
    assert set(kinds) == {"merge", "broadcast"} and kinds["broadcast"] == sum("gram" in x for x in lines if "broadcast" in x)
