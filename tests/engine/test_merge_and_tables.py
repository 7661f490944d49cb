import datetime
import logging
import threading

import pytest
from pyspark.sql import functions as F

from fluxmill.operators import merge
from fluxmill.schemas import ddl
from fluxmill.streaming import files as files_module
from fluxmill.streaming import storage
from fluxmill.streaming.files import Files
from fluxmill.streaming.runner import run_available_now
from fluxmill.streaming.storage import AppendTable, ColumnExists, Conflict, SnapshotTable, open_table


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


KV, KSV = "k string, v int", "k string, s int, v int"


def test_insert_only_replay(spark):
    t, s = frame(spark, [("a", 1)], KV), frame(spark, [("a", 9), ("b", 2)], KV)
    assert rows(merge.insert_only(t, s, ["k"])) == [("b", 2)]


def test_upsert(spark):
    t, s = frame(spark, [("a", 1), ("c", 3)], KV), frame(spark, [("a", 9), ("b", 2)], KV)
    assert rows(merge.upsert(t, s, ["k"])) == [("a", 9), ("b", 2), ("c", 3)]


@pytest.mark.parametrize("ts, ss, v", [(5, 6, 2), (5, 5, 2), (5, 4, 1), (None, 9, 1), (5, None, 1)])
def test_guard(spark, ts, ss, v):
    got = rows(merge.upsert(frame(spark, [("a", ts, 1)], KSV), frame(spark, [("a", ss, 2)], KSV), ["k"], "s"))
    assert got == [("a", ss if v == 2 else ts, v)]


def test_columns_on_one_side_only(spark, caplog):
    t = frame(spark, [("a", 1, 7)], "k string, v int, y int")
    s = frame(spark, [("a", 2, "x"), ("b", 3, "x")], "k string, v int, x string")
    with caplog.at_level(logging.WARNING):
        assert rows(merge.upsert(t, s, ["k"])) == [("a", 2, 7), ("b", 3, None)]
    assert "x" in caplog.text


def test_duplicate_and_keys_only_sources(spark):
    empty = frame(spark, [], KSV)
    assert rows(merge.upsert(empty, frame(spark, [("a", 1, 1), ("a", 2, 5)], KSV), ["k"], "s")) == [("a", 2, 5)]
    t = frame(spark, [("a", 1, 1)], KSV)
    assert rows(merge.upsert(t, frame(spark, [("a",), ("b",)], "k string"), ["k"])) == [("a", 1, 1), ("b", None, None)]


def test_null_keys_never_match_and_tables_refuse_them(spark, tmp_path):
    t, s = frame(spark, [(None, 1)], KV), frame(spark, [(None, 2)], KV)
    assert rows(merge.insert_only(t, s, ["k"])) == [(None, 2)]
    assert len(rows(merge.upsert(t, s, ["k"]))) == 2
    table = SnapshotTable.create(spark, str(tmp_path / "t"), ddl("k STRING NOT NULL, v INT"), ["k"])
    with pytest.raises(Exception, match="null in key column k"):
        table.merge_upsert(s)


def test_snapshot_rewrites_only_touched_buckets(spark, tmp_path):
    table = SnapshotTable.create(spark, str(tmp_path / "t"), ddl("k STRING NOT NULL, v INT"), ["k"], buckets=8)
    table.merge_upsert(frame(spark, [(str(k), k) for k in range(100)], KV))
    before = table.entry()["parts"]
    table.merge_upsert(frame(spark, [("5", -1)], KV))
    after = table.entry()["parts"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == 8
    assert rows(table.read()) == rows(frame(spark, [(str(k), -1 if k == 5 else k) for k in range(100)], KV))
    assert rows(table.read(1)) == rows(frame(spark, [(str(k), k) for k in range(100)], KV))
    table.restore(1)
    assert table.read().where("k = '5'").first()["v"] == 5
    assert table.vacuum(1) >= 1 and table.read().count() == 100


def test_changes_of_rows_and_columns(spark, tmp_path):
    table = SnapshotTable.create(spark, str(tmp_path / "t"), ddl("k STRING NOT NULL, v INT"), ["k"])
    table.insert(frame(spark, [("a", 1), ("b", None)], KV))
    table.add_columns(ddl("w DOUBLE"))
    assert rows(table.read()) == [("a", 1, None), ("b", None, None)]
    with pytest.raises(ColumnExists, match="already exists"):
        table.add_columns(ddl("W DOUBLE"))
    table.update({"w": F.col("v") * 2}, F.col("v") > 0)
    assert rows(table.read()) == [("a", 1, 2.0), ("b", None, None)]
    table.delete(F.col("v").isNull())
    table.rename_column("v", "x")
    table.drop_columns(["w"])
    assert table.columns == ["k", "x"] and rows(table.read()) == [("a", 1)]
    table.add_columns(ddl("w DOUBLE"))
    assert rows(table.read()) == [("a", 1, None)]
    with pytest.raises(ValueError):
        table.drop_columns(["k"])


def test_appends_happen_once(spark, tmp_path):
    table = AppendTable.create(spark, str(tmp_path / "t"), ddl("k STRING NOT NULL, v INT"), ["k"])
    df = frame(spark, [("a", 1)], KV)
    assert table.append(df, "one") and not table.append(df, "one")
    table.merge_insert(frame(spark, [("a", 2), ("b", 2)], KV), label="two")
    assert rows(table.read()) == [("a", 1), ("b", 2)]
    # a folder that was moved in but never committed is taken as it is by the next try
    table.files.rename(f"{table.path}/log/{table.version:012d}.json", f"{table.path}/gone")
    assert rows(table.read()) == [("a", 1)]
    table.merge_insert(frame(spark, [("a", 2), ("b", 2)], KV), label="two")
    assert rows(table.read()) == [("a", 1), ("b", 2)] == rows(table.added(table.versions()))


def test_compaction_keeps_rows_labels_and_streams(spark, tmp_path):
    table = AppendTable.create(spark, str(tmp_path / "t"), ddl("k STRING NOT NULL, v INT"), ["k"])
    for k in range(3):
        table.append(frame(spark, [(str(k), k)], KV), f"b{k}")
    before = table.versions()
    table.compact()
    assert not table.append(frame(spark, [("2", 2)], KV), "b2")
    assert sum(map(len, table.entry()["parts"].values())) == 1 and rows(table.read()) == [("0", 0), ("1", 1), ("2", 2)]
    new = [v for v in table.versions() if v not in before]
    assert new and table.added(new).count() == 0 and table.added(table.versions()).count() == 3
    assert table.vacuum(1) == 3 and table.read().count() == 3
    # a stream that begins now sees what the versions that are gone left
    assert table.added(table.versions(), True).count() == 3


def test_shared_column_prunes_the_target(spark, tmp_path):
    table = AppendTable.create(spark, str(tmp_path / "t"), ddl("k STRING NOT NULL, v INT"), ["k"])
    table.append(frame(spark, [(str(k), k) for k in range(50)], KV))
    table.merge_insert(frame(spark, [("7", 7), ("60", 60)], KV), shared="v")
    table.merge_insert(frame(spark, [], KV), shared="v")
    assert table.read().count() == 51
    plan = table.read().where(F.col("v").between(7, 60))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v,7)" in plan


def test_second_committer_loses(spark, tmp_path):
    table = SnapshotTable.create(spark, str(tmp_path / "t"), ddl("k STRING NOT NULL, v INT"), ["k"])
    base, entry = table.version, table.entry()
    table.merge_upsert(frame(spark, [("a", 1)], KV))
    with pytest.raises(Conflict):
        table._commit(base, entry)
    assert open_table(spark, table.path).read().count() == 1
    with pytest.raises(FileNotFoundError):
        open_table(spark, str(tmp_path / "none"))


def test_one_of_many_writers_wins(spark, tmp_path):
    """A thousand names, each created by two threads at once: one winner, whose text is there whole."""
    files, wins = Files(spark, str(tmp_path)), []
    gate = threading.Barrier(2)

    def race(who):
        for k in range(1000):
            gate.wait()
            wins.append((k, who, files.create(f"{tmp_path}/{k:04d}.json", f"{who}-{k}")))

    threads = [threading.Thread(target=race, args=(w,)) for w in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = {k: who for k, who, won in wins if won}
    assert len(wins) == 2000 and len(winners) == sum(won for _, _, won in wins) == 1000
    assert all((tmp_path / f"{k:04d}.json").read_text() == f"{who}-{k}" for k, who in winners.items())
    assert len(list(tmp_path.iterdir())) == 1000  # no drafts are left


def test_old_labels_stay_known(spark, tmp_path):
    table = AppendTable.create(spark, str(tmp_path / "t"), ddl("k STRING NOT NULL, v INT"), ["k"])
    for k in range(20):
        assert table.append(frame(spark, [(str(k), k)], KV), ("w", k))
    assert table.append(frame(spark, [("0", 0)], KV), ("w", 0)) is None and table.append(frame(spark, [("19", 0)], KV), ("w", 19)) is None
    # the list of folders grows with the logarithm of the appends, and rows stay
    assert {t: len(p) for t, p in table.entry()["parts"].items()} == {"0": 4, "1": 1}
    assert rows(table.read()) == rows(frame(spark, [(str(k), k) for k in range(20)], KV))


def drained(table, checkpoint, seen):
    writer = table.stream(lambda df, n: seen.extend(tuple(r) for r in df.collect()))
    run_available_now(writer.option("checkpointLocation", checkpoint), "t")
    return seen


def test_streams_see_commits_only(spark, tmp_path):
    """Neither a rewrite nor a folder without its commit reaches a stream."""
    table, seen, checkpoint = AppendTable.create(spark, str(tmp_path / "t"), ddl("k STRING NOT NULL, v INT, w INT"), ["k"]), [], str(tmp_path / "c")
    table.append(frame(spark, [("a", 1), ("b", 2)], KV), "one")
    assert sorted(drained(table, checkpoint, seen)) == [("a", 1, None), ("b", 2, None)]
    table.drop_columns(["w"])
    assert len(drained(table, checkpoint, seen)) == 2
    frame(spark, [("x", 9)], KV).write.parquet(f"{table.path}/data/__f=orphan")
    table.compact()
    assert len(drained(table, checkpoint, seen)) == 2
    table.append(frame(spark, [("c", 3)], KV), "two")
    assert drained(table, checkpoint, seen)[2:] == [("c", 3)]
    table.restore(1)
    assert len(drained(table, checkpoint, seen)) == 3


def test_clustered_tables_read_and_rewrite_days(spark, tmp_path):
    schema = ddl("k STRING NOT NULL, d DATE, v INT")
    table = AppendTable.create(spark, str(tmp_path / "t"), schema, ["k"], cluster=["d"])
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(n) for n in range(30)]
    table.append(frame(spark, [(f"{n}-{k}", d, k) for n, d in enumerate(days) for k in range(5)], "k string, d date, v int"))
    # one late row reads one day
    late = frame(spark, [("3-1", days[3], 1), ("new", days[3], 7)], "k string, d date, v int")
    target = table.read().where(F.col("d").isin([days[3]]))
    plan = target._jdf.queryExecution().executedPlan().toString()
    filters = plan.partition("PartitionFilters: [")[2].partition("]")[0]
    assert "d#" in filters and "2024-01-04" in filters or "19726" in filters, plan
    assert target.select(F.input_file_name()).distinct().count() == 1
    table.merge_insert(late, shared="d")
    assert table.read().count() == 151 and table.columns == ["k", "d", "v"] == table.read().columns
    with pytest.raises(ValueError):
        table.drop_columns(["d"])

    held = SnapshotTable.create(spark, str(tmp_path / "s"), ddl("r STRING NOT NULL, at TIMESTAMP NOT NULL, n INT"), ["r", "at"], cluster=["r", "at"])
    many = spark.range(30).select(F.lit("x").alias("r"), F.expr("timestamp'2024-01-01 10:00:00' + make_interval(0, 0, 0, int(id))").alias("at"), F.col("id").cast("int").alias("n"))
    held.merge_upsert(many)
    before = held.entry()["parts"]
    held.merge_upsert(many.where("n = 4").withColumn("n", F.lit(-1)))
    after = held.entry()["parts"]
    assert len(before) == 30 and [d for d in before if before[d] != after[d]] == ["2024-01-05"]
    held.delete_keys(many.where("n = 6").select("r", "at"))
    assert held.read().count() == 29 and held.read().where("n = -1").count() == 1


def test_buckets_follow_the_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "PART_BYTES", 2000)
    table = SnapshotTable.create(spark, str(tmp_path / "t"), ddl("k STRING NOT NULL, v INT"), ["k"], buckets=1)
    table.merge_upsert(frame(spark, [(str(k), k) for k in range(4000)], KV))
    assert table.entry()["buckets"] >= 8 and len(table.entry()["parts"]) == table.entry()["buckets"]
    table.merge_upsert(frame(spark, [("7", -7)], KV))
    assert table.read().count() == 4000 and table.read().where("v = -7").count() == 1


def test_scratch_needs_a_shared_folder_on_clusters(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                class sc:
                    def getCheckpointDir(self):
                        return self

                    def isDefined(self):
                        return False

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        files_module.shared_root(Session)
