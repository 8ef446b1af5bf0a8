"""State of sessions: equal to batch over restarts, read back as a table, seeded from one, gone after its time."""

import random
import time

from skein.config import Config
from skein.operators.reads import read_cache
from skein.streaming.sessions import held_state, last_set, session_reads, session_reads_to_table

SCHEMA = "session_id string, path string, seq long, op string, bounded boolean, failed boolean, content string"
KEY = ["session_id", "path", "seq", "op", "hit", "source", "header_lines"]
ANY = Config(min_chars=0)


def some(n=160):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    return [(f"s{pick(0, 0, 1)}", f"f{pick(0, 1, 2)}", k, pick("Read", "Read", "Read", "Edit", "Write"), rng.random() < 0.1, rng.random() < 0.1, "line\n" * pick(1, 2)) for k in range(n)]


def deliver(spark, folder, rows):
    rows = list(rows)
    random.Random(len(rows)).shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, name="", **more):
    stream = session_reads(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / f"in{name}")), ANY, **more)
    session_reads_to_table(stream, str(tmp_path / f"out{name}"), str(tmp_path / f"cp{name}")).awaitTermination()


def rows_of(df, columns=KEY):
    return sorted(map(str, df.select(columns).collect()))


def test_state_over_restarts_as_a_table_and_as_a_seed(spark, tmp_path):
    rows = some()
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in (rows[:50], rows[50:90], rows[90:]):
        deliver(spark, tmp_path / "in", part)
        run(spark, tmp_path)
        if part[-1] is rows[89]:
            half = spark.createDataFrame(rows[:90], SCHEMA)
            columns = ["session_id", "path", "hash", "header_lines", "source"]
            seed = spark.createDataFrame(held_state(spark, str(tmp_path / "cp")).collect(), "session_id string, path string, hash string, header_lines int, source string")
            assert rows_of(seed, columns) == rows_of(last_set(half, ANY), columns)
    whole = read_cache(spark.createDataFrame(rows, SCHEMA), ANY)
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(whole)
    deliver(spark, tmp_path / "in2", rows[90:])
    run(spark, tmp_path, "2", seed=seed)
    assert rows_of(spark.read.parquet(str(tmp_path / "out2"))) == rows_of(whole.where("seq >= 90"))
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_entries_go_after_their_time(spark, tmp_path):
    one = [("s", "f", 0, "Read", False, False, "x")]
    deliver(spark, tmp_path / "in", one)
    run(spark, tmp_path, keep_ms=1000)
    time.sleep(1.5)
    deliver(spark, tmp_path / "in", [("s", "f", 1, "Read", False, False, "x")])
    run(spark, tmp_path, keep_ms=1000)
    got = {r["seq"]: (r["hit"], r["source"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (False, None), 1: (False, None)}
