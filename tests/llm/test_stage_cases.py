"""Pipeline stages and operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import zlib

import numpy as np
import pytest
import corpus_pipeline
from lattiq.llm import mixing, suffixes, vectors

SF = "/root/testdata/sf0.001"
#: Columns of the documents, and further ones whose names operators use themselves, or that have a dot.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, gone long, bad long, y int, version long, `a.b` string, taken long, key long"
rng = random.Random(5)
LONG = " ".join(rng.choice(["the", "river", "old", "stone", "house", "wind", "quiet", "road"]) + str(rng.randrange(30)) for _ in range(4000))
TEXTS = [None, "", " \n ", "Ein Wort", LONG, LONG[:3000], LONG[:3000], "same words here " * 40, "a b c d e f", "x" * 20000]


def documents(spark, texts=TEXTS):
    rows = [(None if i == 8 else i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 2}", 0, 1.0, 2, 3, 4, 1, 5, "dot", 6, 7) for i, t in enumerate(texts)]
    rows += rows[7:8] * 2  # repeated rows
    return spark.createDataFrame(rows[: len(texts) + 2] if texts else [], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).persist()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_whole_rows(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    before, after = ({} for _ in range(2))
    for table, rows in ((before, docs.collect()), (after, out.collect())):
        for r in rows:
            table[tuple(r)] = table.get(tuple(r), 0) + 1
    assert set(after) <= set(before)
    if name == "mixing":
        assert all(n <= 3 * before[r] for r, n in after.items())
    else:
        assert all(n == before[r] for r, n in after.items())  # repeated rows stay or go together
    if name == "near_duplicates":
        gone = {r[0] for r in before} - {r[0] for r in after}
        assert gone == {6}
    if name == "decontamination":
        assert len(after) == len(before)
    empty = stage(spark, documents(spark, []), SF)
    assert empty.count() == 0 and empty.columns == docs.columns


def test_token_stage(spark, docs):
    out = dict(corpus_pipeline.STAGES)["tokens"](spark, docs, SF).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out) == sorted(-1 if r.doc_id is None else r.doc_id for r in docs.collect())
    assert [r.start for r in sorted(out, key=lambda r: r.start)] == np.append(0, np.cumsum([r.n_tokens for r in sorted(out, key=lambda r: r.start)])[:-1]).tolist()
    end = zlib.crc32(np.array([0], "<u4").tobytes())
    assert {r.ids_crc32 for r in out if r.doc_id in (0, 1)} == {end}
    assert dict(corpus_pipeline.STAGES)["tokens"](spark, documents(spark, []), SF).count() == 0


def test_vectors_on_edges(spark):
    schema = "vec_id long, embedding array<float>, label int, u long, n_links long, component_id long"
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (2, [1.0, 0.01], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 2), (8, [1.0, None], 1)]
    t = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], schema)
    got = {r.vec_id: r for r in vectors.near_vectors(t).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[1].kept and not got[2].kept
    assert all(got[i].component_id == i and got[i].n_links == 0 and got[i].kept for i in (3, 4, 5, 6, 7, 8))
    assert vectors.near_vectors(t.limit(0)).count() == 0


def test_repeats_of_null_and_repeated_ids(spark):
    """Equal doc_ids never take from each other; what a smaller one holds goes from every row of a larger one."""
    text = "".join(rng.choice("abcdefghij") for _ in range(200))
    rows = [(1, text), (2, text + "!"), (2, text + "!"), (2, "other " * 20), (3, None), (4, ""), (5, "short"), (6, "x" + text[40:160])]
    t = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in rows], "doc_id long, text string, n_bytes long, at long, key long")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeats(t).collect())
    assert got == [(1, 200, 0, 0), (2, 120, 0, 0), (2, 201, 200, 1), (2, 201, 200, 1), (3, 0, 0, 0), (4, 0, 0, 0), (5, 5, 0, 0), (6, 121, 120, 1)]


def test_mixing_of_a_source_without_words(spark):
    t = spark.createDataFrame([(1, None, "a", 1), (2, " ", "a", 1), (3, "one two three", "b", 1), (4, "four", None, 1), (4, "four", None, 1)], "doc_id long, text string, source string, target long")
    got = sorted((r.doc_id, r.size, r.source_size, r.taken <= 3 * r.size, r.taken if r.size == 0 else None) for r in mixing.mix_counts(t).collect())
    assert got == [(1, 0, 0, True, 0), (2, 0, 0, True, 0), (3, 3, 3, True, None), (4, 1, 2, True, None), (4, 1, 2, True, None)]
    assert mixing.mix_counts(t.limit(0)).count() == mixing.mix(t.limit(0)).count() == 0


def test_suffixes_sort_only_what_may_repeat(monkeypatch):
    """Segments that share little with others are not sorted, and the spans are those of all windows."""
    import pyarrow as pa

    letters = random.Random(5)
    draw = lambda n: "".join(letters.choice("abcdefgh") for _ in range(n))
    shared, gram = draw(70), draw(16)
    rows = [(10 * i, draw(34) + gram + draw(34)) for i in range(200)] + [(5, draw(30) + shared), (7, shared + draw(30)), (8, "x" + shared[3:60] + "y"), (9, twice := draw(60)), (11, twice), (11, twice)]
    sorted_, real = [], suffixes.suffix_order
    monkeypatch.setattr(suffixes, "suffix_order", lambda s, level=0: (level or sorted_.append(len(s)), real(s, level))[1])
    t = pa.table({"doc_id": [i for i, _ in rows], "text_no": pa.array([1] * len(rows), pa.int32()), "start": pa.array([100 * k for k in range(len(rows))], pa.int32()), "n": pa.array([len(x) for _, x in rows], pa.int32()), "segment": pa.array([x.encode() for _, x in rows], pa.binary())})
    got = sorted((r["doc_id"], r["start"], r["n"]) for r in suffixes._sort(t).to_pylist())
    want = []
    for k, (i, x) in enumerate(rows):
        gone = [a for a in range(len(x) - 49) if any(j < i and x[a : a + 50] in y for j, y in rows)]
        if gone:
            assert gone == list(range(gone[0], gone[-1] + 1))
            want.append((i, 100 * k + gone[0], gone[-1] + 50 - gone[0]))
    assert got == sorted(want) and len(got) == 4
    assert sum(sorted_) < 400  # of 14,000 bytes
