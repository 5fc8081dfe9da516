import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattiq.llm import decontaminate, graph, html, language, mixing, neardup, quality, suffixes, tokens, toxicity, vectors
from lattiq.llm.common import new_path

random.seed(4)
WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(random.choice(WORDS) for _ in range(300))
EDGE = [None, "", "  \n ", "Ein Wort", LONG, LONG, LONG + " tail", "x" * 20000, LONG.upper(), "a b c d e f"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, label string"


def documents(spark, texts=EDGE):
    rows = [(None if i == 9 else i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", 0, 1.0, 2, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 102), (7, 3), (50, 50)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[102] == 100 and 50 not in got


def test_tokens(spark, docs, nothing):
    from tokenizers import Tokenizer

    manifest = tokens.write_tokens(docs, new_path(spark, "t"))
    rows = tokens.read_tokens(spark, manifest).collect()
    library = Tokenizer.from_file(tokens.default_tokenizer())
    want, start = [], 0
    for i, t in sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in docs.collect()):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((None if i < 0 else i, start, ids, zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(r.doc_id, r.start, r.ids, r.ids_crc32) for r in sorted(rows, key=lambda r: r.start)] == want
    assert tokens.read_tokens(spark, tokens.write_tokens(nothing, new_path(spark, "t"))).count() == 0
    enc = tokens.encoder(tokens.default_tokenizer())
    alphabet = "ab st re'’ \n\t\r1²½.,éß漢😀　\x85"
    fuzz = ["".join(random.choice(alphabet) for _ in range(random.randrange(30))) for _ in range(2000)]
    ids, sizes = enc.encode(fuzz)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [x.ids for x in enc.library.encode_batch(fuzz, add_special_tokens=False)]


def test_planes():
    ids = np.random.default_rng(0).integers(0, 50257, 5000).astype(np.uint32)
    assert (tokens.from_planes(tokens.to_planes(ids), 5000) == ids).all()


def test_near_duplicates(spark, docs, nothing):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert got[5].component_id == got[6].component_id == got[8].component_id == 4 and not got[5].kept and got[4].kept
    assert got[0].n_shingles == got[2].n_shingles == 0 and got[3].n_shingles == 1 and got[None].kept
    assert neardup.near_duplicates(nothing).count() == 0


def test_near_duplicates_brute(spark):
    base = [[random.choice(WORDS) for _ in range(120)] for _ in range(6)]
    texts = []
    for _ in range(250):  # families with all degrees of overlap, short texts too
        w = list(random.choice(base))[: random.choice([6, 30, 120])]
        for _ in range(random.randrange(5)):
            w[random.randrange(len(w))] = random.choice(WORDS)
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    low = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(low))


def test_near_duplicates_of_an_id_with_two_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, "other words that nobody else has")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


@pytest.mark.parametrize("apart", [False, True])
def test_confirmed_in_small_blocks(spark, apart):
    """One family in many blocks: a chain, groups that fall apart, and single documents, against all pairs."""
    rng, texts = random.Random(11), []
    for _ in range(1 if not apart else 4):
        w = [f"t{rng.randrange(10**6)}" for _ in range(100)]
        for _ in range(15):  # each a step away from the one before, so that ends of the chain are unlike
            texts.append(" ".join(w))
            w[rng.randrange(100)] = f"t{rng.randrange(10**6)}"
    texts += [" ".join(f"z{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6 if apart else 0)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    family = spark.createDataFrame([(i, 0) for i in range(len(texts))], "id long, family long")
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    n = len(texts)
    i, j = np.array([(i, j) for i in range(n) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]).T
    got = neardup.confirmed(docs, family, 5, 85, block=4).collect()
    a, b = np.array([(r.a, r.b) for r in got]).T
    assert (graph.smallest_reachable(n, a, b) == graph.smallest_reachable(n, i, j)).all()
    assert all(100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]) or graph.smallest_reachable(n, i, j)[x] == graph.smallest_reachable(n, i, j)[y] for x, y in zip(a, b))


def test_confirm_is_exact():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(400) < rng.choice([0.0, 0.05, 0.1, 0.5]), rng.integers(0, 1 << 60, 400).astype(np.uint64), base)) for _ in range(60)]
    for left, right in ((sets, None), (sets[:25], sets[25:])):
        want = [(i, j) for i in range(60) for j in range(i) if (right is None or j < 25 <= i) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
        i, j = np.array(want).T
        forest = neardup.confirm(left, right)
        assert (graph.smallest_reachable(60, *np.array(forest).T) == graph.smallest_reachable(60, i, j)).all() and len(forest) < 60


def test_pipeline_drops_near_duplicates_from_080(spark):
    import corpus_pipeline as c

    rng, texts = random.Random(7), []
    for _ in range(20):  # n shingles each; a changed tail of k words changes k of them
        n = rng.choice([64, 100, 300])
        w = [f"u{rng.randrange(10**9)}" for _ in range(n + 4)]
        for share in (0.82, 0.78):
            k = round(n * (1 - share) / (1 + share))
            texts += [" ".join(w), " ".join(w[: n + 4 - k] + [f"v{i}" for i in range(k)])]
            w = [x + "z" for x in w]
    left = c.drop_near_duplicates(spark, documents(spark, texts).withColumn("doc_id", F.coalesce("doc_id", F.lit(9))), "")
    assert {r.doc_id for r in left.select("doc_id").collect()} == {i for i in range(len(texts)) if i % 4 != 1}


def test_mixing(spark, docs, nothing):
    plan = mixing.mix_counts(docs).collect()
    assert len(plan) == 10 and all(r.taken <= 3 * r["size"] for r in plan)
    targets = {r.source: r.target for r in plan}
    assert sum(targets.values()) == pytest.approx(sum(r["size"] for r in plan))
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(nothing).count() == 0
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_mixing_comes_near_the_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(None if i % 97 == 0 else i, " ".join(["w"] * int(n) + [str(i)]), None if s == 9 else f"s{s}") for i, (n, s) in enumerate(zip(rng.lognormal(4, 1.3, 4000), rng.choice(10, 4000, p=[0.37] + [0.07] * 9)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_counts(docs).toPandas()
    assert len(got) == 4000
    for _, g in got.groupby(got["source"].fillna("none")):
        target = g["target"].iloc[0]
        assert abs(g["taken"].sum() - target) <= g["size"].max() + 0.03 * target and (g["taken"] <= 3 * g["size"]).all()
    again = mixing.mix_counts(docs.repartition(7)).toPandas()
    by = ["source", "doc_id", "size", "taken"]
    assert got.sort_values(by)[by].fillna(-1).values.tolist() == again.sort_values(by)[by].fillna(-1).values.tolist()
    assert mixing.mix(docs).count() == int((got["taken"] / got["size"]).sum())


def test_many_sources_are_numbered_in_order(spark):
    from lattiq.llm.common import numbered

    names = [f"http://www.example.org/{i * 7919 % 1000}" for i in range(1000)] + [None]
    got = numbered(spark.createDataFrame([(x,) for x in names], "source string"), F.col("source").asc_nulls_last()).collect()
    assert [r.source for r in sorted(got, key=lambda r: r.nth)] == [*sorted(names[:-1]), None] and {r.nth for r in got} == set(range(1001))


def test_suffixes(spark, docs, nothing):
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    first = {}
    for i, t in sorted((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None):
        b, gone, mine = t.encode(), set(), []
        for k in range(len(b) - 49):
            gone.update(range(k, k + 50)) if first.get(b[k : k + 50], i) < i else mine.append(b[k : k + 50])
        for w in mine:
            first.setdefault(w, i)
        kept = bytes(c for k, c in enumerate(b) if k not in gone)
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(b), len(gone), hashlib.sha256(kept).hexdigest())
    assert suffixes.remove_repeats(nothing).count() == 0
    for n, a in ((70, 2), (500, 1), (2000, 2), (3000, 200)):
        rng = np.random.default_rng(n)
        for s in (rng.integers(1, a + 1, n), np.repeat(rng.integers(1, a + 1, n // 8), rng.integers(1, 16, n // 8))):
            s = np.append(s, 0)
            assert list(suffixes.suffix_order(s)) == sorted(range(len(s)), key=lambda i: s.tolist()[i:])


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(12, 16))
    x = np.concatenate([base[i % 12] + rng.normal(size=16) * random.choice([0.0, 0.2, 0.4]) for i in range(300)]).reshape(300, 16)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] * 16, 1), (304, x[0].tolist(), None), (305, [1.0], 1), (306, [], 1)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for size in (1e200, 1e-200):  # finite components whose squares are not
        assert vectors.linked(x[:20] * size, None, 0.93)[2] and [a.tolist() for a in vectors.linked(x * size, None, 0.93)[:2]] == [a.tolist() for a in vectors.linked(x, None, 0.93)[:2]]
    near = (u @ u.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300)[None, :] % 2) & ~np.eye(300, dtype=bool)
    assert [got[i].n_links for i in range(300)] == near.sum(1).tolist()
    low = vectors.smallest_reachable(300, *np.nonzero(near))
    assert [got[i].component_id for i in range(300)] == low.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(300, 307))
    q, s, e = vectors.quantise(u)
    assert np.allclose(np.linalg.norm(u - q * s[:, None], axis=1), e)


def test_decontamination(spark, docs, nothing):
    item = " ".join(WORDS[:40])
    texts = [f"{LONG} {item.upper()}. {LONG}", item, " ".join(WORDS[2:40]), LONG, None, "", " ".join(WORDS[:20])]
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, "only three words"), (1, item)], "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(documents(spark, texts), bench).collect()}
    assert set(rows) == {(0, 1), (1, 1), (2, 1)} and rows[0, 1] == 1 and rows[2, 1] == pytest.approx(34 / 36)
    assert decontaminate.leaks(nothing, bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert sorted(r.doc_id for r in decontaminate.clean(documents(spark, texts), bench).collect()) == [3, 4, 5, 6]


def test_decontamination_against_all_windows(spark, monkeypatch):
    """Edited items in long texts, items whose passages are moved or shuffled, an item that occurs twice, repeated words; both
    ways to bring the index."""
    rng, low = random.Random(11), Counter
    items = [[rng.choice(WORDS) for _ in range(rng.choice([12, 25, 40]))] for _ in range(12)] + [["same"] * 30]
    texts = []
    for k in range(60):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(5, 80))]
        mine = list(items[k % 13])
        for _ in range(k % 4):
            i = rng.randrange(len(mine))
            mine[i : i + rng.randrange(2)] = [rng.choice(WORDS)]
        at = rng.randrange(len(w))
        texts.append(w[:at] + mine + w[at:])
    long = [rng.choice(WORDS) for _ in range(100)]
    items.append(long)
    for cuts in ([50], [30], [20, 70], [25, 50, 75]):  # the passages of an item, last first
        parts = [long[a:b] for a, b in zip([0, *cuts], [*cuts, 100])][::-1]
        for around in (0, 12, 700):
            w = [rng.choice(WORDS) for _ in range(around)]
            texts.append(w + [x for part in parts for x in part] + w)
    parts = [long[a : a + 25] for a in (25, 75, 0, 50)]
    texts += [[x for part in parts for x in part], [x for part in parts[::-1] for x in part], long[40:], long[12:]]
    texts.append(["same"] * 500)
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {}
    for d, w in enumerate(texts):
        s = grams(w)
        for k, item in enumerate(items):
            t = low(grams(item))
            m = sum(t.values())
            best = 0
            for start in range(-m + 1, len(s)):
                mine = low(s[max(start, 0) : start + m])
                both = sum((mine & t).values())
                best = max(best, both / (sum(mine.values()) + m - both))
            if best >= 0.8:
                want[d, k] = best
    assert sum(k == 13 for _, k in want) >= 9
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(texts)] + [(0, LONG), (0, LONG)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in enumerate(items)], "item_id long, text string, doc_id string")
    for limit in (decontaminate.BROADCAST_ROWS, 0):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, bench, broadcast_rows=limit).collect()}
        assert got == pytest.approx(want) and len(want) > 25
    monkeypatch.setattr(decontaminate, "PART", 7)  # windows over many parts of a text
    assert {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, bench).collect()} == pytest.approx(want)


def test_scores(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)] + [(8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    s = quality.score(docs, quality.fit_labelled(docs, labels)).collect()
    assert len(s) == 10 and all(0 <= r.score <= 1 for r in s)
    nobody = quality.fit_labelled(docs, labels.limit(0))
    assert quality.keep_good(docs, nobody).columns == docs.columns and {r.score for r in quality.score(docs, nobody).collect()} == {0.5}
    assert quality.score(nothing, nobody).count() == quality.keep_good(nothing, quality.fit_labelled(nothing, labels)).count() == 0
    t = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(t) == 10 and all(0 <= r.score <= 1 for r in t)
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0


def test_additive_learns():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # an interaction only
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


STRONG = toxicity.Strong(np.array([toxicity.SHORT << 56 | 1 << 20 | 2 << 15, toxicity.LONG << 56 | 7]), np.array([2.0, 1.5]))


def test_beginnings_of_words_against_brute_force(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdé.  x") for _ in range(rng.randrange(60))).encode() for _ in range(300)] + [b"", b"  ", b"a" * 50]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    want = []
    for row, t in enumerate(texts):
        folded = toxicity.FOLD[np.frombuffer(t, np.uint8)].tolist()
        words = "".join(map(chr, folded)).split(chr(0))
        for w in filter(None, words):
            code = lambda n, w=w: sum(ord(c) << 5 * (n - 1 - k) for k, c in enumerate(w[:n])) | n << 56
            want += [(row, code(5))] + ([(row, code(8))] if len(w) > 5 else [])
    for piece in (toxicity.PIECE, 7, 64):
        monkeypatch.setattr(toxicity, "PIECE", piece)
        keys, rows = toxicity.beginnings(data, offsets)
        assert sorted(zip(rows.tolist(), keys.tolist())) == sorted(want)
    strong = toxicity.Strong(np.array([want[0][1], 5]), np.array([3.0, 1.0]))
    mine = [k for r, k in want if r == want[0][0]]
    assert strong.evidence(data, offsets)[want[0][0]] == pytest.approx(3 * mine.count(want[0][1]) / len(mine))
    assert toxicity.Strong(np.zeros(0, np.int64), np.zeros(0)).evidence(data, offsets).tolist() == [0.0] * len(texts)


def test_toxic_documents_are_recalled(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.op7_toxicity(spark, sf).where("held_out").join(labels.where("toxic IS NOT NULL"), "doc_id")
    both, said, true = found.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert both > 0.93 * said and both > 0.75 * true and docs.count() > true


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    shared = toxicity.shared_backoff((rng.random(32**4) < 0.01) * rng.integers(1, 9, 32**4))
    assert np.allclose(shared.reshape(-1, 32).sum(1), 1, atol=1e-4)
    counts = rng.integers(0, 3, (50, 32)) * (rng.random((50, 1)) < 0.8)
    lower = shared.reshape(-1, 32)[:50]
    assert np.allclose(toxicity.probabilities(counts.astype(float), lower).sum(1), 1, atol=1e-4)
    contexts = np.arange(50)
    assert (toxicity.log_ratios(contexts, counts, counts, shared) == 0).all()


def test_kneser_ney_against_brute_force(spark):
    """The table from Spark equals log-ratios computed n-gram by n-gram with dictionaries."""
    texts = [("the cat sat on the mat", 0), ("you idiot sat on the cat", 1), ("the mat", 0), ("idiot idiot", 1)]
    grams = [Counter(), Counter()]
    for text, y in texts:
        symbols = [0] * 4 + [0 if c == " " else ord(c) - 96 for c in text] + [0]
        grams[y].update(tuple(symbols[i : i + 5]) for i in range(len(symbols) - 4))
    types = {5: set(grams[0]) | set(grams[1])}
    for k in (4, 3, 2, 1):
        types[k] = {g[1:] for g in types[k + 1]}

    def below(gram):
        if not gram:
            return 1 / 32
        before = lambda g: len({x[0] for x in types[len(g) + 1] if x[1:] == g})
        row = [before(gram[:-1] + (s,)) for s in range(32)]
        lower = below(gram[1:])
        return lower if not sum(row) else max(row[gram[-1]] - 0.75, 0) / sum(row) + 0.75 * sum(x > 0 for x in row) / sum(row) * lower

    def top(counts, gram):
        row = [counts[gram[:-1] + (s,)] for s in range(32)]
        lower = below(gram[1:])
        return lower if not sum(row) else max(row[gram[-1]] - 0.75, 0) / sum(row) + 0.75 * sum(x > 0 for x in row) / sum(row) * lower

    table = toxicity.ratio_table(toxicity.count_ngrams(spark.createDataFrame(texts, "text string, y int")))
    for gram in sorted(types[5])[::3] + [next(iter(types[5]))[:-1] + (30,)]:
        code = sum(s << 5 * (4 - i) for i, s in enumerate(gram))
        assert table[code] == pytest.approx(16 * np.log(top(grams[1], gram) / top(grams[0], gram)), abs=0.51)


def test_long_texts_are_read_whole(spark, monkeypatch):
    """Kernels give the same for a text in one part and in many, across every bound of a part."""
    rng = np.random.default_rng(3)
    text = " ".join(rng.choice(["one", "two", "dreiundzwanzig", "x" * 90, "é漢", "!!", "\n"], 4000)).encode()
    data = np.frombuffer(text, np.uint8)
    offsets = np.array([0, 0, 700, 700, len(data)])
    rows = [np.array([0, len(data)]), offsets]
    ratios = rng.integers(-127, 128, 32**5).astype(np.int8)
    want = [(quality.features(data, o), neardup.shingles(data, o)) for o in rows], toxicity.features(data, rows[0], ratios, STRONG)
    for part in (64, 1000, 4097):
        from lattiq.llm import common

        monkeypatch.setattr(common.span_hashes, "__defaults__", (part,))
        for module in (quality, toxicity):
            monkeypatch.setattr(module, "PIECE", part)
        got = [(quality.features(data, o), neardup.shingles(data, o)) for o in rows], toxicity.features(data, rows[0], ratios, STRONG)
        for (f, (h, at)), (g, (k, cut)) in zip(want[0], got[0]):
            assert np.allclose(f, g) and (h == k).all() and (at == cut).all()
        assert np.allclose(want[1], got[1])
    docs = [(1, text.decode()), (2, "z" + text.decode()[3000:]), (3, text.decode()[:-7])]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in docs]})
    windows = []
    for part in (1 << 20, 500):
        seen = set()
        for mine, cut, row, local, start, n, key in suffixes._segments(batch, part):
            for r, a, s, size, k in zip(row, cut[local], start, n, key):
                seen |= {(r, s + j, k) for j in range(size - 49)}
        windows.append(seen)
    assert windows[0] == windows[1] and len(windows[0]) == sum(len(t.encode()) - 49 for _, t in docs)


def test_language(spark, docs, nothing):
    net = language.Network(["a", "b"], seed=1)
    x = np.frombuffer(b"hello world this is a byte text.", np.uint8).reshape(2, 16).T.copy()
    live, y = np.ones(x.shape, bool), np.array([0, 1])
    loss, grad = net.gradients(x, live, y)
    for name in ("Wnf", "Wzb", "V"):  # numerical gradient
        i, step = (0, 1), 1e-2
        old = net.w[name][i]
        sides = []
        for d in (step, -step):
            net.w[name][i] = old + d
            sides.append(net.gradients(x, live, y)[0])
        net.w[name][i] = old
        assert (sides[0] - sides[1]) / (2 * step) == pytest.approx(float(grad[name][i]), abs=2e-3)
    losses = net.train(np.array([x.T[0], x.T[1]] * 8), np.ones((16, 16), bool), np.array([0, 1] * 8), 30)
    assert losses[-1] < losses[0]
    got = {r.doc_id: r for r in language.predict(docs, net).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[4].lang_pred in ("a", "b")
    assert language.predict(nothing, net).count() == 0 and language.fit(nothing).languages == []


def test_held_out_accuracy(spark):
    """Models of the registered queries, on documents that they did not learn from."""
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.01"
    labels, docs = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("labels", "documents"))
    run = lambda name, truth: entry.queries()[name](spark, d).where("held_out").join(truth, "doc_id").collect()
    good = run("op1_quality", labels.where("quality is not null").select("doc_id", "quality"))
    assert len(good) > 50 and np.mean([r.predicted == r.quality for r in good]) > 0.95
    lang = run("op3_language", docs.where("lang is not null").select("doc_id", "lang"))
    assert len(lang) > 200 and np.mean([r.lang_pred == r.lang for r in lang]) > 0.98
    bad = run("op7_toxicity", labels.where("toxic is not null").select("doc_id", "toxic"))
    caught = sum(r.predicted == r.toxic == 1 for r in bad)
    assert caught > 0.9 * sum(r.predicted for r in bad) and caught > 0.5 * sum(r.toxic for r in bad)


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='cookie-notice'>c</div>{}<article><header><h1>A &amp; B</h1></header><p>one\n two<br>three<p>four <b>five</b></article><section class=comments><article>bad</article></section><footer>f</footer>"
    assert html.extract_text(page.format("")) == "A & B\n\none two three\n\nfour five"
    assert html.extract_text(None) == html.extract_text("") == html.extract_text("<script>x</script>") == ""
    assert html.extract_text("<p>a &lt; b<div>c</div><!-- d --><p hidden>e") == "a < b\n\nc"
    rows = [(i, "http://h.example/x", f"<body><div><p>same box</p></div><p>text {i}</p>") for i in range(8)] + [(9, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (10**6, 0):  # both ways to bring the hashes to the pages
        got = {r.page_id: r.text for r in html.extract(pages, limit).collect()}
        assert got == {i: f"text {i}" for i in range(8)} | {9: ""}


def test_html_copies_keep_the_article(spark):
    bodies = ["<article><div><p>one</p></div><ul><li>two</ul></article>", "<div role=main><section>one</section>two</div>", "<main><table><tr><td>one</table><figure>two</figure></main>"]
    rows = [(10 * k + i, f"http://h{k}.example/x", f"<body><div>box</div>{body}") for k, body in enumerate(bodies) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in html.extract(pages).collect() if r.page_id >= 0} == {"one\n\ntwo"}
    # mirrors that differ outside the text only, without a marked article
    rows = [(i, "http://m.example/x", f"<title>{i}</title><div class='content'><p>The whole article text.</p></div>") for i in range(6)] * 2
    assert {r.text for r in html.extract(spark.createDataFrame(rows, pages.schema)).collect()} == {"The whole article text."}
    rows = [(i, "http://n.example/x", f"<article><h1>T</h1><p>The whole article text.</p><p>by {i}</p></article>") for i in range(6)]
    assert html.extract(spark.createDataFrame(rows, pages.schema)).first().text == "T\n\nThe whole article text.\n\nby 0"


def test_html_names_only_whole_tokens():
    cases = {
        '<article class="hentry comments-open"><p>X</article>': "X",
        '<div class="page has-sidebar"><article>X</article></div>': "X",
        "<form><article>X</article></form>": "X",
        '<p>a <span class="search">term</span> and <em class="notice">note</em> b</p>': "a term and note b",
        "<p>a <button>no</button> b <span hidden>h</span> c</p>": "a b c",
        "<div class=sidebar-left>no</div><p>X<div id=related-posts>no</div>": "X",
    }
    assert {k: html.extract_text(k) for k in cases} == cases


def test_html_templates_found_by_counts_only(spark):
    """Subtrees without any telling name, inside and outside articles, against counts in plain Python."""
    rng, rows = random.Random(2), []
    shared = [f"<div class=z{k}><p>shared {k}</p></div>" for k in range(6)]
    for i in range(60):
        host = f"h{i % 3}.example"
        boxes = "".join(x for k, x in enumerate(shared) if rng.random() < (0.9, 0.7, 0.5, 0.3, 0.1, 0.05)[k])
        body = f"<article><p>own text {i} of a page that is long enough</p>{boxes}</article>" if i % 2 else f"{boxes}<p>own text {i} of a page that is long enough</p>"
        rows += [(i, f"https://{host}/{i}", f"<body>{body}", "extra", 1)] * (1 + i % 4)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    per_host = {h: {(u, x) for _, u, x, *_ in rows if u.split("/")[2] == h} for h in ("h0.example", "h1.example", "h2.example")}
    want = {}
    for i, u, page, *_ in rows:
        mine = {x for _, x in per_host[u.split("/")[2]]}
        gone = [k for k in range(6) if sum(shared[k] in re.sub("<article>.*", "", x) for x in mine) >= 5 and "<article>" not in page]
        want[i] = "\n\n".join(t for t in re.findall(r"<p>(.*?)</p>", page) if t not in [f"shared {k}" for k in gone])
    assert any("shared" in t for t in want.values()) and any(t.count("shared") < rows[[r[0] for r in rows].index(i)][2].count("shared") for i, t in want.items())
    for limit in (10**6, 0):
        got = html.extract(pages, limit).collect()
        assert len(got) == len(rows) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)
    assert html.extract(pages.limit(0)).count() == html.extract(pages.limit(0), -1).count() == 0


def test_html_counts_pages_not_shares_and_keeps_articles(spark):
    """A box on 20 of 40 or of 100 pages goes; near copies without article keep their text; what recurs in a named article stays."""
    own = lambda i: " ".join(f"word{i}x{k}" for k in range(12))
    rows, want = [], {}
    for host, n in (("a.example", 40), ("b.example", 100)):
        for i in range(n):
            box = "<div class=q><p>Read our magazine every week</p></div>" if i < 20 else ""
            layout = ["{box}<div class=c><p>{own}</p><p>and more</p></div>", "<section><p>{own}</p><p>and more</p></section>{box}", "<p>{own}</p>{box}<p>and more</p>"][i % 3]
            text = own(f"{host[0]}{i}")
            rows.append((len(rows), f"http://{host}/{i}", "<body>" + layout.format(box=box, own=text)))
            want[rows[-1][0]] = text  # "and more" itself recurs on all pages
    for i in range(6):
        rows.append((len(rows), f"http://c.example/{i}", f"<body><h1>Title</h1><p>{own('p')}</p><p>{own('q')}</p><p>read {i} times</p>"))
        want[rows[-1][0]] = f"Title\n\n{own('p')}\n\n{own('q')}\n\nread {i} times"
    for i in range(6):
        rows.append((len(rows), f"http://d.example/{i}", f"<div>box</div><article><p>As said before.</p><p>{own(i)}</p></article>"))
        want[rows[-1][0]] = f"As said before.\n\n{own(i)}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (10**6, 0):
        assert {r.page_id: r.text for r in html.extract(pages, limit).collect()} == want


def test_html_of_a_long_page():
    text = "\n\n".join(f"word {i}" for i in range(60000))
    page = "<body><article>" + "".join(f"<p>word {i}</p>" for i in range(60000)) + "</article>" + "<div>" * 500
    assert html.extract_text(page) == text


def test_pipeline(spark):
    import __spark_entry__ as entry
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    docs = c.table(spark, d, "documents")
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, d).persist()
        assert out.columns == docs.columns and out.count() > 0
        if name == "near_duplicates":  # against all pairs
            words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in docs.collect()}
            ids = sorted(words)
            sets = [{tuple(words[i][k : k + 5]) for k in range(max(len(words[i]) - 4, min(len(words[i]), 1)))} for i in ids]
            links = [(i, j) for i in range(len(ids)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
            low = graph.smallest_reachable(len(ids), *np.array(links, np.int64).reshape(-1, 2).T)
            assert sorted(r.doc_id for r in out.collect()) == [ids[i] for i in range(len(ids)) if low[i] == i]
        docs = out
    counts = Counter(r.doc_id for r in docs.collect())
    got = Counter(r.doc_id for r in entry.queries()["pipeline"](spark, d).collect())
    assert got == counts and max(counts.values()) <= 3
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in entry.queries() if re.match(r"op\d+_", q)) == list(range(1, 14))
