"""The language model's start counts every training document, however many there are and wherever a word stands in it."""

import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import lm_scoring


def test_neighbours_of_all_training_documents_count(spark, monkeypatch):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(12))) for i in range(3000)] + [(5000, "a b " * 4000 + "late tail late tail"), (5001, None), (5002, ""), (5003, "single"), (7000, "held held out out")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = {}
    real = lm_scoring.clustered
    monkeypatch.setattr(lm_scoring, "clustered", lambda met, *a: seen.setdefault("met", met) is None or real(met, *a))
    lm_scoring.score_texts(docs, F.col("doc_id") == 7000)
    width = lm_scoring.OWN_BINS + lm_scoring.OTHER_BINS
    n = [len((t or "").split()) for i, t in rows if i != 7000]
    # each word has a neighbour after it, and each end that isn't alone one before it
    assert seen["met"][:, width:].sum() == sum(n) == seen["met"][:, :width].sum()
    assert seen["met"][lm_scoring.END, :width].sum() == sum(x > 0 for x in n) and seen["met"][:, width].sum() == sum(x > 0 for x in n)


def test_neighbours_by_hand():
    kinds, size = np.array([3, 4, 3, lm_scoring.END, lm_scoring.END, 4, lm_scoring.END]), np.array([4, 1, 2])
    bins = lm_scoring.bins_of(np.array([0, 0, 0, 9, 5]))
    met = lm_scoring.neighbours(kinds, size, bins)
    width = lm_scoring.OWN_BINS + lm_scoring.OTHER_BINS
    want = np.zeros_like(met)
    for a, b in ((3, 4), (4, 3), (3, lm_scoring.END), (4, lm_scoring.END)):
        want[b, bins[a]] += 1
        want[a, width + bins[b]] += 1
    assert (met == want).all() and (bins[lm_scoring.END], bins[3], bins[4]) == (0, 1, 2)


def test_classes_with_like_neighbours_share_a_state():
    r = np.random.default_rng(0)
    seqs = [np.append(r.integers(0, 20, 50) + 100 * (i % 2), lm_scoring.END) for i in range(200)]
    kinds, size = np.concatenate(seqs), np.array([51] * 200)
    counts = np.bincount(kinds, minlength=lm_scoring.FREQUENT)[: lm_scoring.FREQUENT]
    m = lm_scoring.clustered(lm_scoring.neighbours(kinds, size, lm_scoring.bins_of(counts)), states=3)
    best = m.emit.argmax(1)
    assert not set(best[:20]) & set(best[100:120])
    for x in (m.start, m.turn.sum(1), m.emit.sum(0)):
        assert np.allclose(x.sum() if x is m.start else x, 1)
    assert lm_scoring.clustered(np.zeros((lm_scoring.CLASSES, 96), np.int64)).emit.shape == lm_scoring.untaught().emit.shape
