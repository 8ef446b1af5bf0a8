"""Ranged reads of files: what is read, what comes out, and what is left alone."""

import random

from pyspark.sql import functions as F

from skein.config import Config
from skein.functions import fixed as K
from skein.functions import folds
from skein.operators import reads as D
from skein.operators import segments as G
from skein.sources import files
from skein.sources import tables as S


def test_counts_stop_at_the_limit(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    big = ("x" * 99 + "\n") * 80000  # 8 MB
    for name, text in (("a.log", big), ("sub/b.log", "one\ntwo"), ("c.log", ""), ("d.txt", "\n" * 50), ("_hidden.log", "x")):
        (tmp_path / name).write_text(text)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.line_counts(spark, str(tmp_path), "*.log").collect()}
    assert {k: (r["size"], r["n_lines"], r["bytes_read"]) for k, r in rows.items()} == {"a.log": (len(big), 1 + K.COUNT_CAP_BYTES // 100, K.COUNT_CAP_BYTES), "b.log": (7, 2, 7), "c.log": (0, 1, 0)}
    got = {r["path"].rsplit("/", 1)[1]: r for r in D.read_guard_files(spark, "file://" + str(tmp_path), config=Config(read_guard_lines=12)).collect()}
    assert set(got) == {"a.log", "d.txt"} and got["a.log"]["capped"] and got["a.log"]["advice"].endswith("lines (~2666667 tokens); read it with offset/limit]")
    own = S.text_files(spark, str(tmp_path), "d.txt")
    assert D.read_guard(own, Config(read_guard_lines=12)).select("size", "n_lines", "capped", "tokens").first() == D.read_guard_files(spark, str(tmp_path), "d.txt", Config(read_guard_lines=12)).select("size", "n_lines", "capped", "tokens").first()


def test_small_files_share_tasks(spark, tmp_path, monkeypatch):
    for k in range(40):
        (tmp_path / f"{k:02}.txt").write_text("a\n" * k)
    assert files.line_counts(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(files, "TASK_BYTES", 100)
    parts = files._Counts({"path": str(tmp_path)}).partitions()
    assert len(parts) > 10 and sum(len(p.files) for p in parts) == 40 and all(sum(n for _, n in p.files) <= 100 for p in parts)


def test_blocks_are_the_file(spark, tmp_path):
    rng = random.Random(5)
    made = {}
    for k in range(12):
        lines = ["é😀x"[: rng.randrange(4)] * rng.randrange(30) for _ in range(rng.randrange(60))]
        made[f"{k}.log"] = "\n".join(lines) + rng.choice(["", "\n"])
    made |= {"e.log": "", "n.log": "\n", "long.log": "y" * 5000 + "\nz", "r.log": "a\r\nb\r\n"}
    for name, text in made.items():
        (tmp_path / name).write_bytes(text.encode())
    want = {n: t if t.endswith("\n") else t + "\n" for n, t in made.items() if t}

    def joined(rows):
        got = {}
        for path, _, text in sorted(rows):
            assert text.endswith("\n")
            got[path.rsplit("/", 1)[1]] = got.get(path.rsplit("/", 1)[1], "") + text
        return got

    for size in (1, 2, 7, 64, 1 << 20):
        reader = files._Blocks({"path": str(tmp_path), "pattern": "*.log", "blockbytes": str(size)})
        assert joined([tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]) == want
    assert joined([tuple(r) for r in files.file_blocks(spark, str(tmp_path), "*.log", 2000).collect()]) == want


def test_small_ranges_share_tasks(spark, tmp_path):
    lines = [f"line {k} " + "é" * (k % 40) for k in range(20000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    (tmp_path / "b.txt").write_text("x\n" * 50)
    size = 100
    parts = files._Blocks({"path": str(tmp_path), "blockbytes": str(size)}).partitions()
    ranges = [(p, k) for part in parts for p, _, first, end in part.files for k in range(first, end)]
    assert len(ranges) == len(set(ranges)) > 5000 and len(parts) <= 2 * files.TASKS
    rows = files.file_blocks(spark, str(tmp_path), "*.txt", size)
    assert rows.rdd.getNumPartitions() == len(parts)
    a = sorted((r["seq"], r["text"]) for r in rows.collect() if r["id"].endswith("a.txt"))
    assert len(a) > 1000 and "".join(t for _, t in a) == "\n".join(lines) + "\n"
    assert [len(p.files) for p in files._Blocks({"path": str(tmp_path / "a.txt"), "blockbytes": str(200000)}).partitions()] == [1] * -(-(tmp_path / "a.txt").stat().st_size // 200000)


def test_a_log_folds_by_its_blocks(spark, tmp_path):
    rng = random.Random(1)
    text = "\n".join(rng.choice(["compiling unit 7 of 90", "compiling unit 8 of 90", "linked", "", f"warning {rng.random()}"]) for _ in range(5000))
    (tmp_path / "big.log").write_text(text)
    rows = files.file_blocks(spark, str(tmp_path), size=3000)
    assert rows.count() > 20
    assert G.whole(G.reduced_blocks(rows)).first()["text"] == folds.chain(text)[0]


def test_only_the_files_of_a_project_are_listed(spark, tmp_path):
    for folder in ("-home-me-p", "-home-me-q", "-HOME-ME-other"):
        (tmp_path / folder).mkdir()
        for k in range(3):
            (tmp_path / folder / f"{k}.jsonl").write_text('{"a":1}\n\n{"a":2}\n')

    def listed(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.finalPhysicalPlan().collectLeaves() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan.collectLeaves()
        leaf = leaves.apply(0)
        while leaf.getClass().getSimpleName() != "FileSourceScanExec":
            leaf = leaf.plan() if hasattr(leaf, "plan") and "Stage" in leaf.getClass().getSimpleName() else leaf.child()
            leaf = leaf.collectLeaves().apply(0)
        return leaf.metrics().apply("numFiles").value()

    one = S.transcript_lines(spark, str(tmp_path), "/home/me/p")
    assert one.count() == 6 and listed(one) == 3
    some = S.transcript_lines(spark, str(tmp_path), "/home/me")  # no folder of that name: all that contain it
    assert some.count() == 18 and listed(S.transcript_lines(spark, str(tmp_path), "/me/other")) == 3
    assert listed(S.transcript_lines(spark, str(tmp_path))) == 9
    assert some.select(F.countDistinct("file")).first()[0] == 9
