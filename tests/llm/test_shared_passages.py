"""Benchmark items that share passages: the same matches as by listing all windows, in bounded time and memory."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import decontaminate


def made(rng, n_items, n_docs, shared, own, words=6000):
    pool = [f"w{k}" for k in range(words)]
    passage = " ".join(rng.choices(pool, k=shared))
    items = [f"{passage} {' '.join(rng.choices(pool, k=own))}" for _ in range(n_items)]
    docs = [f"{' '.join(rng.choices(pool, k=30))} {passage} {' '.join(rng.choices(pool, k=31))}" for _ in range(n_docs)]
    for k in range(0, n_docs, 3):  # some hold an item, exact or with edits
        words_ = rng.choice(items).split()
        for _ in range(rng.randrange(5)):
            words_[rng.randrange(len(words_))] = rng.choice(pool)
        docs[k] += " " + " ".join(words_)
    return items, docs


@pytest.mark.parametrize(("shared", "own"), [(30, 12), (12, 30), (8, 1), (20, 3), (0, 25)])
def test_like_listing_every_window(monkeypatch, shared, own):
    items, docs = made(random.Random(shared), 40, 30, shared, own)
    index = decontaminate.ItemIndex(list(range(len(items))), items, 80, 1)
    col = pa.array([*docs, " ".join(docs[:9]), docs[0] + " x " + docs[0], ""])
    got = {}
    for limit in (1 << 40, 512, 0):
        monkeypatch.setattr(decontaminate, "LISTED", limit)
        monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", 7)
        got[limit] = sorted(index.matches(col))
    assert got[0] == got[512] == got[1 << 40] and got[0]


def test_every_match_is_found_by_brute_force():
    items, docs = made(random.Random(4), 60, 40, 14, 9, 300)
    index = decontaminate.ItemIndex(list(range(len(items))), items, 80, 1)
    h, ptr = decontaminate.symbols(pa.array(docs))
    x, at = decontaminate.symbols(pa.array(items))
    want = {(d, k) for d in range(len(docs)) for k in range(len(items)) if decontaminate.best_stretch(x[at[k] : at[k + 1]], h[ptr[d] : ptr[d + 1]], (at[k + 1] - at[k]) // 5)}
    got = {(r[0], r[1]) for r in index.matches(pa.array(docs))}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 10


def test_thousands_of_items_with_one_instruction():
    items, docs = made(random.Random(5), 3000, 600, 30, 12, 20000)
    index = decontaminate.ItemIndex(list(range(len(items))), items, 80, 1)
    began = time.process_time()
    found = index.matches(pa.array(docs))
    assert time.process_time() - began < 20
    assert len({r[0] for r in found}) >= 190  # of the 200 documents that hold an item


def test_missing_words_are_a_lower_bound():
    rng = np.random.default_rng(6)
    for _ in range(60):
        pool = [f"v{k}" for k in range(12)]
        items = [" ".join(rng.choice(pool, rng.integers(1, 12))) for _ in range(5)]
        index = decontaminate.ItemIndex(list(range(5)), items, 80, 1)
        text, _ = decontaminate.symbols(pa.array([" ".join(rng.choice(pool, 20))]))
        missing = index._missing(np.unique(text[:8]))
        for (_, x), least in zip(index.items, missing.tolist()):
            assert decontaminate.best_stretch(x, text[:8], 99)[0] >= least
