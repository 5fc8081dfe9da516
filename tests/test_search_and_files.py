"""Searches that resume, window caches that add parts, report files."""

import numpy as np
import pytest

from lattiq.operators import cells, contest, folders
from lattiq.plans import evaluation, files, queries, results, search
from lattiq.sources import panels

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def long(spark):
    return search._panel(spark, SF).persist()


def test_a_space_is_drawn_by_number(spark):
    one, other = (sorted(search.space(spark, n, (5, 50)).collect()) for n in (40, 100))
    assert one == other[:40] and len({r.trial for r in other}) == 100
    assert {r.lookback for r in other} == {2, 4} and {r.scaled for r in other} == {True, False}
    assert min(r["rank"] for r in other) >= 5 and max(r["rank"] for r in other) <= 50
    assert all(1e-4 <= r.penalty <= 100 for r in other) and min(r.penalty for r in other) < 0.01 and max(r.penalty for r in other) > 1


def test_a_search_is_resumed_and_a_batch_is_written_once(spark, long, tmp_path):
    path, space = f"file://{tmp_path}/study", search.space(spark, 7, (1, 3))
    assert search.search(spark, long, space.where("trial < 3"), path, batch=2) == 3
    first = {r.trial: r.scores for r in spark.read.parquet(path).collect()}
    assert search.search(spark, long, space, path, batch=2) == 4 and search.search(spark, long, space, path) == 0
    store = spark.read.parquet(path).drop("batch")
    rows = {r.trial: r for r in store.collect()}
    assert len(rows) == store.count() == 7 and all(rows[t].scores == s for t, s in first.items())
    # a batch that was being written when the search was killed is written again under its name
    again = store.where("trial = 6")
    results.append_trials(again, f"file://{tmp_path}/two", "b")
    results.append_trials(again, f"file://{tmp_path}/two", "b")
    assert spark.read.parquet(f"file://{tmp_path}/two").count() == 1
    p = contest.load(long)
    gxx = cells.cell_gramian(p.rows, p.axes)
    for t in (rows[0], rows[6]):  # the scores are those of the models, fitted one by one
        f = contest.fit(p, gxx, "levels", t.lookback, t["rank"], t.penalty, None if t.scaled else 0, t.scaled)
        table = contest.predictions(p.rows, p.axes, f).where("cut < 3").groupBy("cut").agg(contest.r2("cp").alias("r2")).orderBy("cut")
        assert [r.r2 for r in table.collect()] == pytest.approx([np.nan if s is None else s for s in t.scores], abs=1e-9, nan_ok=True) or None in t.scores
    p.drop()


def test_trials_are_judged(spark):
    rows = [(0, [0.2, 0.4, -3.0]), (1, [0.1, None, None]), (2, [-0.5, -0.4, 0.9]), (3, [0.3, None, 0.5])]
    got = {r.trial: (r.state, r.score) for r in search.judged(spark.createDataFrame(rows, "trial long, scores array<double>")).collect()}
    assert got[0] == ("complete", pytest.approx(-0.4 / 3)) and got[1] == ("pruned", None) and got[2] == ("pruned", None) and got[3] == ("complete", pytest.approx(0.4))
    with pytest.raises(ValueError):
        results.top_trials(spark.createDataFrame([(1, "a", 0.5), (2, "a", None)], "trial int, mode string, score double"), ["mode"], 2)


def test_a_cache_builds_only_what_it_lacks(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert results.cached_parts(spark, path) == set()
    assert files.build_cache(spark, SF, path, [("levels", 2)]) == [("levels", 2)]
    before = sorted(p.name for p in (tmp_path / "cache/mode=levels/lookback=2").glob("*.parquet"))
    assert files.build_cache(spark, SF, path, [("levels", 2), ("surprise", 2)]) == [("surprise", 2)]
    assert sorted(p.name for p in (tmp_path / "cache/mode=levels/lookback=2").glob("*.parquet")) == before
    assert files.build_cache(spark, SF, path, [("levels", 2), ("surprise", 2)]) == []
    assert results.load_windows(spark, path, "levels", 2).count() == queries.windows3(spark, SF).count()
    assert results.load_windows(spark, path, "levels", 4) is None


def test_all_parts_come_from_one_pass_that_several_tasks_share(spark, monkeypatch, tmp_path):
    read = []
    monkeypatch.setattr(queries, "p3", lambda s, d: read.append(d) or panels.users(s, d))
    assert files.build_cache(spark, SF, f"file://{tmp_path}/cache") == files.PARTS and len(read) == 1
    assert queries.windows3(spark, SF).rdd.getNumPartitions() > 1


def test_windows_of_odd_events(spark, tmp_path):
    """Gaps, days without events, users without some types, missing users, days, and values: as DuckDB has them."""
    import duckdb

    rows = [(1, "a", 1, 3.5), (1, "a", 1, -1.0), (1, "a", 2, -4.0), (1, "a", 4, 0.0), (1, "b", 4, 7.25), (1, "b", 9, 2.0), (2, "b", 1, None), (2, "b", 2, 5.0), (2, "b", 3, None), (3, "a", 8, 11.0), (3, "a", 9, 1.0),
            (None, "a", 6, 2.0), (None, "b", 8, 4.0), (None, "b", 11, 4.0), (4, "a", None, 3.0), (5, "b", 10, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?::TIMESTAMP, ?, ?, ?)", [(None if day is None else f"2024-01-{day:02d} 10:00:00", user, kind, v) for user, kind, day, v in rows])
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT PARQUET)")
    key = lambda r: tuple((v is not None, v) for v in r)
    for name in ("window_cache", "lookback_windows", "window_rms"):
        got = sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()), key=key)
        assert got and got == sorted(con.execute(queries.ORACLE_SQL[name]).fetchall(), key=key), name


def test_files_of_the_final_evaluation(spark):
    folder = folders.new(spark, "test")
    one = {("levels", 2): (2, 1.0)}
    schemas = files.write_comparison(spark, SF, folder, one)
    assert set(schemas) == {"results", "per_feature", "persistence", "stats"}
    back = {name: results.read_csv(spark, f"{folder}/{name}", schema).collect() for name, schema in schemas.items()}
    rows = evaluation.compared(spark, SF, one)[0]
    assert len(back["per_feature"]) == len(back["persistence"]) == 5 and len(back["results"]) == len(back["stats"]) == 1
    assert {r.feature: r.cp_cv_r2 for r in back["per_feature"]} == pytest.approx({r["feature"]: r["cp_cv_r2"] for r in rows}, nan_ok=True)
