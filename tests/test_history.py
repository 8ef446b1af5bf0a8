"""The history as snapshots, its stream and the recovery store: lost writers, repeated deliveries, concurrent commits."""

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from skein.config import TeeOptions
from skein.operators.ledger import marginals
from skein.sources.recovery import RecoveryStore
from skein.sources.tables import HISTORY_SCHEMA
from skein.streaming.history import History, ledger_stream, once_each

DAY = dt.date(2024, 1, 1)


def batch(spark, key="Bash", events=1, day=DAY):
    return spark.createDataFrame([(day, "tool", key, events, 10, 5)], HISTORY_SCHEMA)


def totals(history, version=None):
    return {r["key"]: r["events"] for r in history.read(version).collect()}


def parts(tmp_path):
    return len([p for p in (tmp_path / "h" / "data").iterdir() if p.is_dir()])


def test_a_reader_keeps_to_its_version(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    assert h.read().count() == 0 and h.versions() == [] and h.compact() == 0
    h.expire()
    h.add(batch(spark))
    h.add(batch(spark, "Read", 2))
    opened = h.read()
    assert h.compact() == 3
    h.add(batch(spark, "Read", 5))
    assert {r["key"]: r["events"] for r in opened.collect()} == {"Bash": 1, "Read": 2}
    assert totals(h) == {"Bash": 1, "Read": 7} and totals(h, 1) == {"Bash": 1}
    h.expire(keep=2)
    assert h.versions() == [3, 4] and parts(tmp_path) == 2
    assert totals(h, 3) == {"Bash": 1, "Read": 2} and totals(h) == {"Bash": 1, "Read": 7}
    old = dt.date(2023, 1, 1)
    h.add(batch(spark, "Old", 1, old))
    h.compact(dt.date(2024, 2, 1))
    assert totals(h) == {"Bash": 1, "Read": 7}
    h.expire(keep=1)
    assert parts(tmp_path) == 1 and totals(h) == {"Bash": 1, "Read": 7}


def test_of_two_writers_one_wins_and_one_retries(spark, tmp_path):
    h, other = History(spark, str(tmp_path / "h")), History(spark, str(tmp_path / "h"))
    h.add(batch(spark))
    assert not h._placed(1, {"parts": [], "done": {}}) and totals(h) == {"Bash": 1}
    first = h._commit

    def late(change):  # the other commits after this one has read the newest manifest
        tried = []

        def watched(m):
            if not tried:
                tried.append(1)
                other.add(batch(spark, "Read"))
            return change(m)

        return first(watched)

    h._commit = late
    assert h.add(batch(spark, "Grep")) == 3
    assert h.compact() == 5  # what came in meanwhile stays beside the base
    assert totals(h) == {"Bash": 1, "Read": 2, "Grep": 1}
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: History(spark, str(tmp_path / "h")).add(batch(spark, f"w{k % 3}")), range(12)))
    assert totals(other) == {"Bash": 1, "Read": 2, "Grep": 1, "w0": 4, "w1": 4, "w2": 4}


def test_a_second_compaction_changes_nothing(spark, tmp_path):
    h, other = History(spark, str(tmp_path / "h")), History(spark, str(tmp_path / "h"))
    h.add(batch(spark))
    h.add(batch(spark))
    first = h._commit
    h._commit = lambda change: (other.compact(), first(change))[1]
    h.compact()
    assert totals(h) == {"Bash": 2} and h.versions() == [1, 2, 3]


def test_batches_of_two_writers_count_once_each(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    for writer, number in (("a", 0), ("b", 0), ("a", 0), ("a", 1), ("b", 0), ("a", 0)):
        h.add(batch(spark, writer), writer, number)
    h.compact()
    h.add(batch(spark, "a"), "a", 1)
    assert totals(h) == {"a": 2, "b": 1}


FACTS = "event_id long, ts timestamp, session_id string, day date, tool string, command string, project string, bytes_in long, bytes_out long, events long"


def facts(spark, numbers):
    rows = [(k, dt.datetime(2024, 1, 1 + k // 8, k % 8), "s", dt.date(2024, 1, 1 + k // 8), f"t{k % 3}", "c", "p", 100 + k, 10, 1) for k in numbers]
    return spark.createDataFrame(rows, FACTS)


def deliver(spark, tmp_path, numbers):
    facts(spark, numbers).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def incoming(spark, tmp_path):
    return spark.readStream.schema(FACTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_a_failed_batch_and_repeated_events_count_once(spark, tmp_path):
    deliver(spark, tmp_path, range(0, 20))
    deliver(spark, tmp_path, [*range(10, 30), 29, 29])
    deliver(spark, tmp_path, range(25, 48))
    h = History(spark, str(tmp_path / "h"))
    add, failed = h.add, []

    def add_and_fail(rows, writer, number):
        add(rows, writer, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost after the commit")

    h.add = add_and_fail
    with pytest.raises(StreamingQueryException):
        ledger_stream(incoming(spark, tmp_path), h, str(tmp_path / "cp"), "10 days").awaitTermination()
    ledger_stream(incoming(spark, tmp_path), h, str(tmp_path / "cp"), "10 days").awaitTermination()
    assert failed == [1]
    assert sorted(map(str, h.read().collect())) == sorted(map(str, marginals(facts(spark, range(48))).collect()))


def test_ids_are_forgotten_after_their_time(spark, tmp_path):
    for first in range(0, 200, 40):
        deliver(spark, tmp_path, range(first, first + 40))
    q = once_each(incoming(spark, tmp_path), "1 day").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    assert max(held) <= 64 and sum(op["numRowsUpdated"] for p in q.recentProgress for op in p["stateOperators"]) == 200


def test_facts_without_an_id_are_all_taken(spark, tmp_path):
    facts(spark, range(6)).withColumn("event_id", F.lit(None).cast("long")).withColumn("ts", F.when(F.col("bytes_in") > 100, F.col("ts"))).coalesce(1).write.parquet(str(tmp_path / "in"))
    h = History(spark, str(tmp_path / "h"))
    ledger_stream(incoming(spark, tmp_path), h, str(tmp_path / "cp")).awaitTermination()
    assert h.read().where("dim = 'project'").first()["events"] == 5


RESULTS = "session_id string, use_id string, seq long, original string, lossy boolean, failed boolean"


def originals(spark, numbers, session="s", size=10):
    return spark.createDataFrame([(session, f"u{k}", k, f"{k} " + "x" * size, True, k % 2 == 0) for k in numbers], RESULTS)


def kept(store):
    return sorted((r["session_id"], r["use_id"]) for r in store.read().collect())


def test_recovery_copies_are_pruned_by_session(spark, tmp_path):
    store = RecoveryStore(spark, str(tmp_path / "r"), TeeOptions(max_files=3, min_bytes=5))
    assert store.read().count() == 0
    got = store.add(originals(spark, range(5)))
    assert sorted(r["path"] for r in got.collect()) == ["s/u2.log", "s/u3.log", "s/u4.log"]
    other = store.add(originals(spark, range(2), "a/b.c"))
    assert {r["path"] for r in other.collect()} == {"a%2Fb%2Ec/u0.log", "a%2Fb%2Ec/u1.log"}
    bucket = store._table(store.folder).where("session_id = 'a/b.c'").first()["bucket"]
    files = lambda: sorted(p.name for p in (tmp_path / "r" / f"bucket={bucket}").iterdir() if p.suffix == ".parquet")
    untouched = files()
    late = store.add(originals(spark, [1, 6]))  # of these the older is beyond the bound
    assert [r["path"] for r in late.collect()] == ["s/u6.log"]
    assert kept(store) == [("a/b.c", "u0"), ("a/b.c", "u1"), ("s", "u3"), ("s", "u4"), ("s", "u6")]
    assert files() == untouched
    again = originals(spark, [6]).withColumn("original", F.lit("another text"))
    store.add(again)
    assert store.read().where("path = 's/u6.log'").collect()[0]["original"] == "another text"


def test_what_is_not_worth_a_copy(spark, tmp_path):
    rows = originals(spark, range(4)).unionByName(originals(spark, [9], None)).unionByName(originals(spark, [9], "")).unionByName(originals(spark, [9], "s", 0).withColumn("use_id", F.lit("")))
    store = RecoveryStore(spark, str(tmp_path / "r"), TeeOptions(mode="failures", min_bytes=5))
    store.add(rows.withColumn("lossy", F.col("seq") != 2))
    assert kept(store) == [("s", "u0")]
    for off in (TeeOptions(enabled=False, min_bytes=5), TeeOptions(mode="never", min_bytes=5), TeeOptions(max_files=0, min_bytes=5), TeeOptions(min_bytes=1000)):
        assert RecoveryStore(spark, str(tmp_path / "r"), off).add(rows).count() == 0
    assert kept(store) == [("s", "u0")]


def test_a_lost_writer_is_made_good(spark, tmp_path):
    store = RecoveryStore(spark, str(tmp_path / "r"), TeeOptions(max_files=2, min_bytes=5))
    store.add(originals(spark, range(3)))
    put = store.put_staged
    calls = []
    store.put_staged = lambda: put() if not calls.append(1) and len(calls) == 1 else (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        store.add(originals(spark, [7, 8]))
    store = RecoveryStore(spark, str(tmp_path / "r"), TeeOptions(max_files=2, min_bytes=5))
    assert kept(store) == [("s", "u1"), ("s", "u2")]
    store.add(originals(spark, range(1), "t"))
    assert kept(store) == [("s", "u7"), ("s", "u8"), ("t", "u0")]
