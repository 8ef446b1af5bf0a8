"""Ranked search against a plain loop over all documents, with ties, repeats, nulls, long texts and blocks of any size."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from skein.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, most=20):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    held = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in own:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:most])]
    return sorted(out, key=str)


def tables(spark, docs, items, parts=5):
    d = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in docs], "doc_id long, text string, block long, terms string, item int, score long").repartition(parts)
    return d, spark.createDataFrame([(i, t, 9, "y") for i, t in items], "item_id long, text string, rank int, doc_id string")


def corpus(rng, n):
    words = [f"w{k}" for k in range(300)] + ["Ñandú", "ñandú", "É", "日本", "x_y", "a-b", "İ"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 20, 60, 400])))) for k in range(n)]
    docs += [(1000 + k, docs[4][1]) for k in range(45)]  # more ties than ranks
    docs += [(7, docs[8][1]), (7, docs[8][1]), (None, docs[4][1]), (2000, None), (2001, ""), (2002, " .-\x00 "), (2003, "w1 " * 30000), (2004, "W1.w2")]
    rng.shuffle(docs)
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 4, 30])))) for k in range(12)]
    return docs, items + [(90, docs[4][1]), (91, None), (92, ""), (93, "nowhere"), (94, "w0 w0 w0 W0"), (95, "w1"), (94, "w0 w0 w0 W0"), (None, "w5 w9")]


@pytest.mark.parametrize("size", [200, 5000, 1 << 22])
def test_against_all_documents(spark, monkeypatch, size):
    docs, items = corpus(random.Random(size), 260)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", size)
    got = lexical.ranked(*tables(spark, docs, items, 7)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_blocks_of_items_and_shuffled_blocks(spark, monkeypatch):
    docs, items = corpus(random.Random(5), 90)
    monkeypatch.setattr(lexical, "ITEMS", 4)
    monkeypatch.setattr(lexical, "BROADCAST_IDS", 0)
    monkeypatch.setattr(lexical, "EXACT", 0)
    got = lexical.ranked(*tables(spark, docs, items), most=3).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 3)


def test_kept_index(spark, tmp_path):
    docs, items = corpus(random.Random(6), 60)
    d, i = tables(spark, docs, items)
    path = "file://" + str(tmp_path / "index")
    built = lexical.LexicalIndex.build(d, path)
    again = lexical.LexicalIndex.read(spark, path)
    assert (built.n_docs, built.n_terms) == (again.n_docs, again.n_terms) == (sum(bool(terms(t)) for _, t in docs), sum(len(terms(t)) for _, t in docs))
    assert sorted(map(tuple, again.search(i).collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(random.Random(7), 10)
    d, i = tables(spark, docs, items)
    assert lexical.ranked(d.limit(0), i).collect() == []
    assert lexical.ranked(d, i.limit(0)).collect() == []
    assert lexical.ranked(d.where("text is null"), i).collect() == []


def test_bounds_hold_and_blocks_are_skipped(spark):
    docs, items = corpus(random.Random(8), 200)
    import pyarrow as pa

    n_docs, n_terms = 250, 20000
    row = lexical.block_row(3, pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string()), n_docs, n_terms).to_pylist()[0]
    own = lexical.Items([i for i, _ in items], pa.array([t for _, t in items], pa.string()))
    own.weigh({k: k for k in range(len(own.terms))}, n_docs)
    block = lexical.Block(row, own)
    counts, m = lexical._widened(row["counts"], len(block.docs)), lexical.lengths(lexical._widened(row["sizes"], block.n), n_docs, n_terms)
    for k in range(len(items)):
        least, most = block.bounds(k)
        exact = block.scores(k, np.arange(block.n), counts, m)
        assert (least <= exact).all() and (exact <= most).all() and ((exact > 0) <= (most > 0)).all()


def test_lengths_beyond_64_bits():
    sizes = np.array([2**31, 7])
    assert lexical.lengths(sizes, 10**12, 10**15).tolist() == [75 + 25 * 2**31 * 10**12 // 10**15, 75]
