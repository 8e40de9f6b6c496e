"""Commits of the stored table: a change that stops anywhere leaves the old
rows or the new ones (S5, S7, S9), and the newest version of a key wins
whatever the order of delivery (R1)."""

import datetime as dt
import os
import uuid
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import commits as CM
from evidentia.operators import corpus as CO
from evidentia.schemas import PAPERS
from evidentia.session import checkpoint_dir
from evidentia.streaming.ingest import start_stream_upsert
from tests.test_corpus import new_table, rows

T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


class Stop(RuntimeError):
    pass


def texts(spark, path):
    return {r.id: r.abstract for r in CO.read_table_at(spark, path).collect()}


def stop_after(fn):
    def run(*a, **kw):
        fn(*a, **kw)
        raise Stop()
    return run


def stop_before(fn):
    return lambda *a, **kw: (_ for _ in ()).throw(Stop())


# every step of a change, stopped before and after it; what readers see then
STEPS = [("stage", stop_before, False), ("stage", stop_after, False), ("write_generation", stop_before, False),
         ("write_generation", stop_after, False), ("publish", stop_before, False), ("publish", stop_after, True),
         ("vacuum", stop_before, True), ("vacuum", stop_after, True)]


@pytest.mark.parametrize("step,how,done", STEPS)
def test_a_stopped_upsert_is_seen_whole_or_not_at_all(spark, monkeypatch, step, how, done):
    path = new_table(spark)
    old = {str(i): f"old{i}" for i in range(20)}
    CO.upsert_table(spark, path, rows(spark, list(old), "old", T1))
    src = rows(spark, ["3", "4", "x"], "new", T2)
    new = old | {i: f"new{i}" for i in ("3", "4", "x")}
    with monkeypatch.context() as m:
        m.setattr(CO, step, how(getattr(CO, step)))
        with pytest.raises(Stop):
            CO.upsert_table(spark, path, src)
    assert texts(spark, path) == (new if done else old)
    CO.upsert_table(spark, path, src)
    assert texts(spark, path) == new and CM.commit_at(spark, path).rows == 21


@pytest.mark.parametrize("step,how,done", [s for s in STEPS if s[0] in ("publish", "vacuum")])
def test_a_stopped_clear_is_seen_whole_or_not_at_all(spark, monkeypatch, step, how, done):
    path = new_table(spark)
    CO.upsert_table(spark, path, rows(spark, ["1", "2"], "a", T1), buckets=8)
    with monkeypatch.context() as m:
        m.setattr(CO, step, how(getattr(CO, step)))
        with pytest.raises(Stop):
            CO.clear_table(spark, path)
    assert texts(spark, path) == ({} if done else {"1": "a1", "2": "a2"})
    assert CO.table_buckets(spark, path) == 8
    CO.clear_table(spark, path)
    CO.upsert_table(spark, path, rows(spark, ["9"], "z", T1))
    assert texts(spark, path) == {"9": "z9"}


@pytest.mark.parametrize("step,how,done", [s for s in STEPS if s[0] in ("write_generation", "publish")])
def test_a_stopped_first_load_can_be_done_again(spark, monkeypatch, step, how, done):
    path = new_table(spark)
    with monkeypatch.context() as m:
        m.setattr(CO, step, how(getattr(CO, step)))
        with pytest.raises(Stop):
            CO.write_table(path, rows(spark, ["1", "2"], "a", T1), 8)
    if done:
        with pytest.raises(FileExistsError):
            CO.write_table(path, rows(spark, ["1", "2"], "a", T1), 8)
    else:
        with pytest.raises(CO.BucketCountError):
            CO.read_table_at(spark, path)
        CO.write_table(path, rows(spark, ["1", "2"], "a", T1), 8)
    assert texts(spark, path) == {"1": "a1", "2": "a2"}


def test_a_half_written_commit_is_not_read(spark):
    path = new_table(spark)
    CO.upsert_table(spark, path, rows(spark, ["1"], "a", T1))
    with open(os.path.join(path.replace("file:", ""), CM.LOG, f".{uuid.uuid4().hex}.tmp"), "w") as f:
        f.write('{"version": 99, "buck')
    assert texts(spark, path) == {"1": "a1"}


def test_of_two_writers_from_one_version_the_second_is_told(spark, monkeypatch):
    path = new_table(spark)
    CO.upsert_table(spark, path, rows(spark, ["1", "2"], "a", T1))
    inner = CO.write_generation

    def meanwhile(*a):
        with monkeypatch.context() as m:
            m.setattr(CO, "write_generation", inner)
            CO.upsert_table(spark, path, rows(spark, ["1"], "first", T2))
        return inner(*a)

    with monkeypatch.context() as m:
        m.setattr(CO, "write_generation", meanwhile)
        with pytest.raises(CM.ConcurrentChangeError):
            CO.upsert_table(spark, path, rows(spark, ["1", "3"], "second", T2))
    assert texts(spark, path) == {"1": "first1", "2": "a2"}


def test_old_versions_stay_readable_until_vacuumed(spark):
    path = new_table(spark)
    CO.upsert_table(spark, path, rows(spark, ["1"], "v1-", T1))
    first = CM.versions(spark, path)[-1]
    reader = CO.read_table_at(spark, path)
    CO.upsert_table(spark, path, rows(spark, ["1"], "v2-", T2))
    assert [r.abstract for r in reader.collect()] == ["v1-1"] and texts(spark, path) == {"1": "v2-1"}
    assert [r.abstract for r in CO.read_table_at(spark, path, first).collect()] == ["v1-1"]
    for n in range(3, 7):
        CO.upsert_table(spark, path, rows(spark, ["1"], f"v{n}-", T2))
    kept = CM.versions(spark, path)
    assert len(kept) <= CM.KEEP_VERSIONS + 1 and first not in kept
    assert CM.vacuum(spark, path, keep=1) >= 1
    folders = [n for n, _ in CM.folder_names(spark, path) if n.startswith("gen=")]
    assert len(folders) == 1 and texts(spark, path) == {"1": "v6-1"}
    h = CM.history(spark, path).collect()
    assert [(r.rows, r.filled) for r in h] == [(1, 1)]


def test_orphans_are_left_to_their_writer_for_a_while(spark):
    path = new_table(spark)
    CO.upsert_table(spark, path, rows(spark, ["1"], "a", T1))
    CM.write_generation(path, CO.with_bucket(rows(spark, ["2"], "b", T1)))
    count = lambda: len([n for n, _ in CM.folder_names(spark, path) if n.startswith("gen=")])
    assert CM.vacuum(spark, path) == 0 and count() == 2
    assert CM.vacuum(spark, path, orphan_hours=0) == 1 and count() == 1
    assert texts(spark, path) == {"1": "a1"}


def test_a_folder_of_other_files_is_refused(spark):
    path = new_table(spark)
    spark.range(3).write.parquet(path)
    with pytest.raises(CO.BucketCountError):
        CO.upsert_table(spark, path, rows(spark, ["1"], "a", T1))
    assert spark.read.parquet(path).count() == 3


# --- newest version by key ---------------------------------------------------------------

def deliveries(spark):
    """Five files: versions of three keys, one of them with equal times."""
    day = lambda d: dt.datetime(2024, 3, d)
    return [rows(spark, ["a", "b"], "first-", day(1)), rows(spark, ["a"], "third-", day(9)), rows(spark, ["a", "c"], "second-", day(5)),
            rows(spark, ["b"], "tie-x-", day(7)), rows(spark, ["b"], "tie-y-", day(7))]


@pytest.mark.parametrize("per_trigger", [1, 2, 10])
@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4), (4, 3, 2, 1, 0), (1, 4, 0, 2, 3)])
def test_the_newest_version_wins_in_any_order(spark, per_trigger, order):
    base = os.path.join(checkpoint_dir(spark), f"order-{uuid.uuid4().hex}")
    files = deliveries(spark)
    for i in order:
        files[i].coalesce(1).write.mode("append").parquet(os.path.join(base, "in"))
    table = os.path.join(base, "table")
    CO.write_table(table, rows(spark, ["a", "z"], "stored-", dt.datetime(2024, 3, 3)), 8)
    for _ in range(2):                                       # a second start finds nothing new
        q = start_stream_upsert(spark, os.path.join(base, "in"), table, os.path.join(base, "ckpt"), per_trigger)
        q.awaitTermination()
        assert q.exception() is None
    assert texts(spark, table) == {"a": "third-a", "b": "tie-y-b", "c": "second-c", "z": "stored-z"}


def test_nothing_newer_commits_nothing(spark):
    path = new_table(spark)
    src = rows(spark, ["a", "b"], "x", T2)
    assert CO.upsert_table(spark, path, src, newest_by="ingested_at") == 2
    before = CM.versions(spark, path)
    assert CO.upsert_table(spark, path, src, newest_by="ingested_at") == 0
    assert CO.upsert_table(spark, path, rows(spark, ["a"], "old", T1), newest_by="ingested_at") == 0
    assert CM.versions(spark, path) == before and texts(spark, path) == {"a": "xa", "b": "xb"}


def test_keep_last_takes_the_latest_and_breaks_ties_by_the_row(spark):
    df = rows(spark, ["a"], "1", T1).unionByName(rows(spark, ["a"], "2", T2)).unionByName(rows(spark, ["a"], "3", T2))
    got = CO.keep_last(df).collect()
    assert [(r.id, r.abstract) for r in got] == [("a", "3a")] and CO.keep_last(df).columns == PAPERS.fieldNames()
    by_date = CO.keep_last(df.withColumn("published_date", F.expr("date_add(published_date, length(abstract))")), order="published_date")
    assert by_date.count() == 1


# --- a change costs what it changes (F3, F9) ---------------------------------------------

def rows_written(spark, path):
    """Rows in all generations that were ever written (none vacuumed)."""
    folders = [f"{path}/{n}" for n, _ in CM.folder_names(spark, path) if n.startswith("gen=")]
    return sum(spark.read.parquet(f).count() for f in folders)


def stream_in(spark, monkeypatch, n, batches, small=0, runs=16):
    """A stored table of n rows, all of them re-ingested in as many files as batches: (rows written, table)."""
    base = os.path.join(checkpoint_dir(spark), f"runs-{uuid.uuid4().hex}")
    ids = [str(i) for i in range(n)]
    for i in range(batches):
        rows(spark, ids[i::batches], "new", T2).coalesce(1).write.mode("append").parquet(os.path.join(base, "in"))
    table = os.path.join(base, "table")
    CO.write_table(table, rows(spark, [*ids, "z"], "old", T1), 2)
    with monkeypatch.context() as m:
        m.setattr(CO, "SMALL_RUN", small)
        m.setattr(CO, "RUNS", runs)
        m.setattr(CO, "vacuum", lambda *a, **k: 0)
        q = start_stream_upsert(spark, os.path.join(base, "in"), table, os.path.join(base, "ckpt"), 1)
        q.awaitTermination()
        assert q.exception() is None
    assert texts(spark, table) == {i: f"new{i}" for i in ids} | {"z": "oldz"}
    assert CO.read_table_at(spark, table).count() == n + 1 == CM.commit_at(spark, table).rows
    assert max(len(r) for r in CM.commit_at(spark, table).generations.values()) <= runs
    return rows_written(spark, table)


def test_many_batches_do_not_write_the_table_again_and_again(spark, monkeypatch):
    assert stream_in(spark, monkeypatch, 60, 6) == 61 + 60


def test_many_runs_are_merged(spark, monkeypatch):
    assert stream_in(spark, monkeypatch, 60, 6, runs=3) > 61 + 60


def test_a_row_is_merged_few_times_whatever_the_number_of_batches():
    def written(batches, rows=2000):
        runs, out = [CM.Run("base", 0, batches * rows)], 0
        for v in range(batches):
            k = CO.runs_kept(runs, rows)
            n = rows + sum(r.rows for r in runs[k:])
            runs, out = [*runs[:k], CM.Run(str(v), v, n)], out + n
            assert len(runs) <= CO.RUNS
        return out / (batches * rows)
    assert written(100) < 4 and written(1000) < 8 and written(3000) < 10
    assert CO.runs_kept([CM.Run("a", 0, 50), CM.Run("b", 1, 3)], 1) == 0         # small buckets are written whole


def test_stored_rows_that_repeat_a_key_are_replaced_together(spark, monkeypatch):
    """A loaded table may repeat keys: both rows stay until a newer version comes, as often as before."""
    monkeypatch.setattr(CO, "SMALL_RUN", 0)
    path = new_table(spark)
    CO.write_table(path, rows(spark, ["a", "a", "b"], "old", T1), 1)
    assert sorted(r.abstract for r in CO.read_table_at(spark, path).collect()) == ["olda", "olda", "oldb"]
    assert CO.upsert_table(spark, path, rows(spark, ["b", "c"], "new", T2), newest_by="ingested_at") == 2
    assert sorted(r.abstract for r in CO.read_table_at(spark, path).collect()) == ["newb", "newc", "olda", "olda"]
    assert CO.upsert_table(spark, path, rows(spark, ["a"], "new", T2)) == 1
    assert texts(spark, path) == {"a": "newa", "b": "newb", "c": "newc"} and CM.commit_at(spark, path).rows == 3
    assert CO.read_ids(spark, path, spark.createDataFrame([("b",)], "id string")).first().abstract == "newb"


def test_keys_of_newer_rows_are_those_of_the_rows(spark):
    """Found from keys, times and digests, they are those that whole rows give: ties, copies, repeats and new keys."""
    day = lambda d: dt.datetime(2024, 3, d)
    parts = lambda *p: [rows(spark, ids, text, at) for ids, text, at in p]
    stored = parts((["a", "b"], "same-", day(3)), (["c"], "m-", day(3)), (["d"], "m-", day(3)), (["e"], "x", day(1)),
                   (["e"], "y", day(1)), (["f"], "x", day(9)), (["g"], "m-", day(2)), (["g"], "m-", day(4)))
    source = parts((["a"], "same-", day(3)), (["c"], "n-", day(3)), (["d"], "l-", day(3)), (["e"], "z", day(2)),
                   (["f"], "z", day(2)), (["g"], "z", day(3)), (["h"], "new", day(1)))
    t, s = (reduce(DataFrame.unionByName, p) for p in (stored, source))
    want = sorted(r.id for r in CO.newer_rows(t, s).collect())
    keys, n, pairs, met = CO.newer_keys(t.select, s, "id", "ingested_at")
    assert sorted(r.id for r in keys.collect()) == want == ["c", "e", "e", "g", "h"] and n == 5
    assert (pairs, met) == (8, 9)


def test_only_keys_that_come_again_are_folded(spark):
    df = rows(spark, ["a", "b"], "1", T1).unionByName(rows(spark, ["a"], "2", T2))
    assert sorted((r.id, r.abstract) for r in CO.fold_repeats(df).collect()) == [("a", "2a"), ("b", "1b")]
    once = rows(spark, ["a", "b"], "1", T1)
    assert CO.fold_repeats(once) is once
