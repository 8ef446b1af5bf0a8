"""The corpus pipeline, every stage against a plain version, on small tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from skein.llm import decontaminate, quality
from test_llm import bare, brute_components, edited, low, prose, stretch_distance

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(rng):
    """(documents, labels, items) with bad texts, copies, near copies, leaks, null ids and repeated rows."""
    items = [(k, prose(rng, rng.randrange(10, 25), 5000)) for k in range(8)]
    good = [prose(rng, rng.randrange(30, 90), 5000) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(good)]
    rows += [(1000 + k, " ".join(w.upper() + "!!" for w in prose(rng, 40).split())) for k in range(90)]
    rows += [(2000 + k, good[k % 10].capitalize()) for k in range(40)]  # copies
    rows += [(3000 + k, f"{good[20 + k % 5]} end{k}") for k in range(30)]  # near copies
    rows += [(4000 + k, f"{prose(rng, 20, 5000)} {' '.join(edited(rng, items[k % 8][1].split(), 1))} {prose(rng, 20, 5000)}") for k in range(16)]
    rows += [(None, good[100] + " of none"), (None, good[100] + " of none"), (None, good[5]), (140, good[140]), (140, good[140]), (5000, None), (5001, "")]
    labels = [(i, int(t == low(t)), 0) for i, t in rows if i is not None and t and i < 2000]
    return rows, labels, items


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(31)
    rows, labels, items = corpus(rng)
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def plain_exact(rows):
    most = {}
    for i, t in rows:
        key = low(t)
        if key not in most or (most[key] is None or i is not None and i > most[key]):
            most[key] = i
    return Counter((i, t) for t, i in most.items())


def plain_near(rows):
    label = brute_components([(k, t) for k, (_, t) in enumerate(rows)], 5, 80)
    best = {}
    for k, (i, t) in enumerate(rows):
        n, c = label[k]
        key = c if n else ("empty", k)
        best.setdefault(key, []).append((i is None, i or 0, k))
    return Counter((rows[min(v)[2]][0], low(rows[min(v)[2]][1])) for v in best.values())


def seen(df):
    return Counter((r["doc_id"], low(r["text"])) for r in df.collect())


def test_each_stage_against_a_plain_version(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_duplicates", "decontamination", "packing"]

    kept = stages["quality"](spark, docs, folder)
    assert kept.columns == docs.columns
    model = quality.fit(docs, labels)
    z = []
    for _, t in rows:
        parts = [(ids, p) for ids, p in quality.features(pa.array([t], pa.string()))]
        n = sum(len(ids) for ids, _ in parts)
        z.append(sum(float(model.projection[ids].sum(dtype=np.float64)) for ids, _ in parts) / max(1, n) + model.offset)
    want = Counter((i, low(t)) for (i, t), x in zip(rows, z) if 1 / (1 + np.exp(-x)) >= 0.3)
    assert seen(kept) == want
    assert all(want[i, low(t)] for i, t in rows if i is not None and i < 150) and not any(want[i, low(t)] for i, t in rows if i is not None and 1000 <= i < 1090)

    unique = stages["exact_dedup"](spark, docs, folder)
    assert unique.columns == docs.columns and seen(unique) == plain_exact(rows)

    one = stages["near_duplicates"](spark, docs, folder)
    assert one.columns == docs.columns and seen(one) == plain_near(rows)

    clean = stages["decontamination"](spark, docs, folder)
    leak = lambda t: any(stretch_distance(bare(s), bare(t)) <= len(bare(s)) // 5 for _, s in items)
    assert clean.columns == docs.columns and seen(clean) == Counter((i, low(t)) for i, t in rows if not leak(t))


def test_the_whole_pipeline(spark, tables):
    folder, rows, items = tables
    got = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    accepted = seen(dict(corpus_pipeline.STAGES)["quality"](spark, docs, folder))
    left = [(i, t) for (i, t), n in accepted.items() for _ in range(n)]
    left = list(plain_exact(left))
    left = [(i, t) for i, t in plain_near(left)]
    left = [(i, t) for i, t in left if not any(stretch_distance(bare(s), bare(t)) <= len(bare(s)) // 5 for _, s in items)]
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == Counter(i for i, _ in left)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_take_empty_tables(spark, tables, tmp_path):
    folder, _, _ = tables
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    some = spark.createDataFrame([(1, "some text", "en", "s", 9)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, some, str(tmp_path)).count() == 1, name


def test_repeated_rows_beside_any_column_name(spark):
    """The exact stage on rows with columns of the names that were used inside."""
    from skein.llm.exact_dedup import unique_documents

    rows = spark.createDataFrame([(1, "a b", 5, 6, 7)] * 3 + [(2, "c", 1, 2, 3)], "doc_id long, text string, _key0 int, _key1 int, _KEY0_0 int")
    assert sorted(map(tuple, unique_documents(rows).collect())) == [(1, "a b", 5, 6, 7), (2, "c", 1, 2, 3)]
