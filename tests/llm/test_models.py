import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language_id, lm_scoring, quality_classifier, quality_rules
from ledgerloom.llm.features import COUNTS, counts
from ledgerloom.llm.shared import held_out

from .helpers import corpus, empty, frame, words

SF = "/root/testdata/sf0.01"


def brute_counts(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(rep), "n_distinct": len(set(w))}


def test_counts_are_brute_force():
    texts = [r[1] for r in corpus(8)] + ["a\n\n a\na\nb|#\na \n", "\n", "é ü x %%"]
    got = counts(pa.array(texts))
    for i, t in enumerate(texts):
        for k, v in brute_counts(t).items():
            assert got[k][i] == v, (k, t)
    assert all(len(x) == 0 for x in counts(pa.array([], pa.string())).values())


def test_binomial_bound():
    for x, n, p in ((0, 10, 0.1), (3, 50, 0.02), (7, 2000, 0.01)):
        assert quality_rules.binomial_tail(x, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1)))
    # 0 of 100 good documents rejected doesn't certify 1 %; 0 of 1000 does
    assert quality_rules.certified(100, [0], 0.01, 0.01) == 0
    assert quality_rules.certified(1000, [0, 0, 500, 0], 0.01, 0.01) == 2


def test_rules_keep_every_row(spark):
    rows = corpus(3)
    labels = spark.createDataFrame([(i, i % 3 != 0 and 1 or 0, 0) for i in range(100)] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.apply_rules(frame(spark, rows), labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert all(r.kept in (True, False) and (not r.kept or not r.base_failed) for r in out)
    assert quality_rules.apply_rules(empty(spark), labels).count() == 0
    none = quality_rules.apply_rules(frame(spark, rows), labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)


def test_classifier_holds_out(spark):
    out = quality_classifier.op8_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in out) / len(out)
    assert right > 0.95 and all(0 <= r.score <= 1 for r in out)


def test_classifier_without_labels(spark):
    docs = frame(spark, corpus(6))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality_classifier.learn(docs, labels)
    out = quality_classifier.scored(docs, model)
    assert {r.score for r in out.collect()} == {0.5} and [c for c in out.columns if c != "score"] == [c for c in docs.columns if c != "score"]
    assert quality_classifier.scored(empty(spark), model).count() == 0


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = np.zeros((3000, len(quality_classifier.FEATURES)))
    x[:, :2] = r.random((3000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_classifier.fit(x, y)
    assert (((model.score(x) > 0.5) == y).mean()) > 0.95
    assert len(COUNTS) == 13


def test_unigram_base_is_brute_force(spark):
    rows = corpus(9)
    docs = frame(spark, rows)
    got = lm_scoring.score_texts(docs, held_out("doc_id", 7, 2)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    low = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words(t)] + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in rows if not held(i) for w in low(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        w = low(t)
        want[(i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_scoring.score_texts(empty(spark), held_out("doc_id", 7, 2)).count() == 0


def small_model(seed):
    r = np.random.default_rng(seed)
    n = lambda a, axis: a / a.sum(axis, keepdims=True)
    return lm_scoring.Markov(n(r.random(3), 0), n(r.random((3, 3)), 1), n(r.random((lm_scoring.CLASSES, 3)), 0))


def test_forward_recursion_sums_all_paths():
    m = small_model(1)
    seqs = [[5], [1, 2, 3], [7, 7, 2, 9, 4], [0, 8]]
    got = lm_scoring.forward_logs(m, np.concatenate(seqs), np.array([len(s) for s in seqs]))
    up, k = lm_scoring.expected(m, np.concatenate(seqs), np.array([len(s) for s in seqs])), 0
    starts, turns, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((lm_scoring.CLASSES, 3))
    for s, g in zip(seqs, got):
        paths = {}
        for p in itertools.product(range(3), repeat=len(s)):
            x = m.start[p[0]]
            for i, c in enumerate(s):
                x *= m.emit[c, p[i]] * (m.turn[p[i - 1], p[i]] if i else 1)
            paths[p] = x
        total = sum(paths.values())
        assert g == pytest.approx(math.log10(total))
        k += math.log(total)
        for p, x in paths.items():
            starts[p[0]] += x / total
            for i, c in enumerate(s):
                emits[c, p[i]] += x / total
                if i:
                    turns[p[i - 1], p[i]] += x / total
    assert np.allclose(up[0], starts) and np.allclose(up[1], turns) and np.allclose(up[2], emits) and up[3] == pytest.approx(k)


def test_counts_are_those_of_uncut_sequences():
    """A range of a few words at a time gives the counts of the whole at once; so do sequences in another order."""
    m, r = small_model(2), random.Random(1)
    seqs = [[r.randrange(12) for _ in range(n)] for n in (1, 700, 3, 40, 40, 1300, 2)]
    flat, size = np.concatenate(seqs), np.array([len(s) for s in seqs])
    whole = lm_scoring.expected(m, flat, size, 10**9)
    for most in (1, 7, 100, 1500):
        for a, b in zip(whole, lm_scoring.expected(m, flat, size, most)):
            assert np.allclose(a, b)
    kinds, n = lm_scoring._with_ends(flat, size, np.array([True] * 6 + [False]))
    assert n.tolist() == [1301, 701, 41, 41, 4, 2] and kinds[:1300].tolist() == seqs[5] and (kinds[np.cumsum(n) - 1] == lm_scoring.END).all() and len(kinds) == n.sum()


def test_baum_welch_climbs():
    r = random.Random(0)
    seqs = [[r.randrange(10) + 20 * (i % 2) for _ in range(30)] for i in range(60)]
    kinds, size = np.concatenate(seqs), np.array([30] * 60)
    m, last = lm_scoring.untaught(2), -math.inf
    for _ in range(8):
        starts, turns, emits, loss = lm_scoring.expected(m, kinds, size)
        assert loss > last - 1e-6
        last, m = loss, lm_scoring.improved(starts, turns, emits, prior=1e-9)


def test_hidden_states_beat_the_base(spark):
    h = lm_scoring.op4_lm_scoring(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert h.s > h.b


def test_network_gradients():
    net = language_id.fresh(["a", "b", "c"], 5)
    r = np.random.default_rng(3)
    x, y = r.integers(97, 105, (6, 4)), np.array([0, 1, 2, 0, 1, 2])
    _, grads = language_id.gradients(net, x, y)
    for a, g in zip(net.arrays(), grads):
        for _ in range(3):
            i = tuple(r.integers(0, n) for n in a.shape) if a.ndim > 1 and a.shape[0] != 256 else np.unravel_index(np.abs(g).argmax(), g.shape)
            old = a[i]
            a[i] = old + 1e-2
            up = language_id.gradients(net, x, y)[0]
            a[i] = old - 1e-2
            down = language_id.gradients(net, x, y)[0]
            a[i] = old
            assert (up - down) / 2e-2 == pytest.approx(float(g[i]), abs=2e-4)


def test_languages_hold_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language_id.op9_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_odd_texts_have_a_language(spark):
    net = language_id.train(["hello there the and", "der die das und nicht"] * 5, ["en", "de"] * 5, steps=60)
    rows = corpus(2)
    out = language_id.identify(frame(spark, rows), net).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    for r in out:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert language_id.identify(empty(spark), net).count() == 0
    assert language_id.sample_of(empty(spark)) == ([], []) and language_id.train([], []) is None
    assert {r.lang_pred for r in language_id.identify(frame(spark, rows), None).collect()} == {"und"}
    runs = language_id.positions("the und", net)
    assert runs and runs[0][0] == 0 and runs[-1][1] == 7
