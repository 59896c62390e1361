"""The queries themselves, over small tables: against plain Python, and over tables without rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import lm_scoring, packing, quality_classifier, queries
from ledgerloom.llm.features import COUNTS
from ledgerloom.llm.words import words_of

from .helpers import SCHEMA, corpus, frame, words
from .test_models import brute_counts

LABELS = "doc_id long, quality int, toxic int"


def test_queries_over_tables_without_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    full = {n: f(spark, "/root/testdata/sf0.001").schema for n, f in queries.QUERIES.items() if n in ("op1_exact_topk_search", "op10_best_fit_packing")}
    for name, query in queries.QUERIES.items():
        out = query(spark, str(tmp_path))
        assert out.count() == 0, name
        assert name not in full or out.schema.simpleString() == full[name].simpleString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The awkward corpus with labels: null, repeated and contradicting ones, ids that no document has."""
    folder = tmp_path_factory.mktemp("tables")
    rows = corpus(31)
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 3 != 0 or (t or "").startswith("w ")), 0) for i, t, *_ in rows if i is not None] + [(5, None, 0), (None, 1, 0), (8, 0, 0), (8, 1, 0), (10**9, 1, 0)]
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, labels


def plain_features(t):
    c, raw, text = brute_counts(t), (t or "").encode(), t or ""
    n = lambda chars: sum(x in chars for x in text)
    c |= {"n_upper": sum(65 <= b < 91 for b in raw), "n_digits": sum(48 <= b < 58 for b in raw), "n_marks": n(",;:'\"()-"), "n_ends": n(".?"), "n_shouts": n("!"), "n_wide": sum(b >= 192 for b in raw)}
    w, chars = max(1, c["n_words"]), max(1, c["word_chars"])
    return [math.log1p(c["n_words"]), c["word_chars"] / w, c["n_symbols"] / chars, c["n_dup_lines"] / max(1, c["n_lines"]), c["n_repeat_words"] / w, c["n_distinct"] / w, c["n_upper"] / chars,
            c["n_digits"] / chars, c["n_marks"] / w, c["n_ends"] / w, c["n_shouts"] / w, c["n_wide"] / chars, c["n_lines"] / w]


def test_classifier_scores_are_plain_additions(spark, tables):
    """Scores as returned: features counted plainly, the model of the same labelled rows, bins found and values added one by one."""
    folder, rows, labels = tables
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    worst = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            worst[i] = min(q, worst.get(i, 1))
    taught = list(dict.fromkeys((i, t) for i, t, *_ in rows if not held(i) and i in worst))  # a row that repeats teaches once
    model = quality_classifier.fit(np.array([plain_features(t) for _, t in taught]), np.array([float(worst[i] == 1) for i, _ in taught]))
    want = Counter()
    for i, t, *_ in rows:
        x = plain_features(t)
        bins = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges)]
        total = model.base + sum(table[b] for table, b in zip(model.tables, bins))
        coarse = [b * quality_classifier.PAIR_BINS // quality_classifier.BINS for b in bins]
        total += sum(table[coarse[a]][coarse[b]] for a, b, table in model.pairs)
        p = 1 / (1 + math.exp(-total))
        want[(i, held(i), round(p, 4), int(p >= 0.3))] += 1
    got = quality_classifier.op8_quality_classifier(spark, folder).collect()
    assert Counter((r.doc_id, r.held_out, round(r.score, 4), r.predicted) for r in got) == want and len({w[2] for w in want}) > 5
    assert len(COUNTS) == 13


def plain_packing(sizes, capacities=packing.CAPACITIES):
    """Best fit by looking at every open sequence, and the choice of a length by filling it piece by piece from a list."""
    bins, out = [], []
    for at, size in enumerate(sizes):
        free = [(b["room"], b["last"]) for b in bins if b["room"] >= size]
        if free:
            room = min(r for r, _ in free)
            # of sequences with the same room the one that got it last
            b = max((b for b in bins if b["room"] == room), key=lambda b: b["last"])
        else:
            rest = sizes[at + 1 :]
            spare = max(0, sum(rest) - sum(b["room"] for b in bins))

            def gets(c):
                room = c - size
                for s in rest:
                    if s <= room:
                        room -= s
                return size + min(spare, c - size - room)

            c = min((c for c in capacities if c >= size), key=lambda c: (packing.cost(c) / gets(c), c))
            b = {"room": c, "held": 0, "no": len(bins), "last": 0}
            bins.append(b)
        out.append((b["no"], b["held"]))
        b["held"] += size
        b["room"] -= size
        b["last"] = at
    small = [min(c for c in capacities if c >= b["held"]) for b in bins]
    return [(no, off, small[no]) for no, off in out]


def test_packing_places_as_the_plain_packer(spark, tmp_path):
    r = random.Random(12)
    docs = [(i, " ".join(["w"] * min(9000, int(math.exp(r.gauss(5.5, 1.4)))))) for i in range(300)] + [(500, ""), (501, None), (None, "a b"), (7, "a b"), (7, "a b")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [x for x in packing.op10_best_fit_packing(spark, str(tmp_path)).collect()]
    assert len({x.bin >> 32 for x in got if x.bin is not None}) == 1 and sum(x.bin is None for x in got) == 2
    placed = sorted((x for x in got if x.bin is not None), key=lambda x: (-x.n_tokens, x.doc_id is None, x.doc_id or 0, x.piece))
    want = plain_packing([x.n_tokens for x in placed])
    # equal rows may stand in either order
    assert Counter((x.n_tokens, x.bin, x.offset, x.capacity) for x in placed) == Counter((x.n_tokens, *w) for x, w in zip(placed, want))
    assert len({w[2] for w in want}) >= 3


def test_lm_scores_are_the_plain_forward_sum(spark, tables, monkeypatch):
    """Scores as returned, from the model that the query learnt: the forward sum by plain loops, and each word's share of its class."""
    folder, rows, _ = tables
    seen = {}
    real_frequent, real_taught = lm_scoring.frequent_of, lm_scoring.taught
    monkeypatch.setattr(lm_scoring, "frequent_of", lambda *a: seen.setdefault("frequent", real_frequent(*a, 40)))
    monkeypatch.setattr(lm_scoring, "taught", lambda *a: seen.setdefault("model", real_taught(*a)))
    got = lm_scoring.op4_lm_scoring(spark, folder).collect()
    model, frequent = seen["model"], seen["frequent"].tolist()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2

    def tokens(t):
        hashes, ending = lm_scoring.lowered(words_of(pa.array([t], pa.string())))
        return [(h, frequent.index(h) if h in frequent else lm_scoring.FREQUENT + e) for h, e in zip(hashes.tolist(), ending.tolist())]

    each = [(i, held(i), tokens(t)) for i, t, *_ in rows]
    count, of_class = Counter(h for _, out, x in each if not out for h, _ in x), Counter(k for _, out, x in each if not out for _, k in x)
    different = Counter(k for _, k in {p for _, out, x in each if not out for p in x})
    want = Counter()
    for i, out, x in each:
        now, total = None, 0.0
        for k in [k for _, k in x] + [lm_scoring.END]:
            now = model.start * model.emit[k] if now is None else [sum(now[a] * model.turn[a, b] for a in range(len(now))) * model.emit[k, b] for b in range(len(now))]
            total += math.log10(sum(now))
            now = [v / sum(now) for v in now]
        total += sum(math.log10((count[h] + 1) / (of_class[k] + different[k] + 1)) for h, k in x)
        want[(i, out, len(x) + 1, round(total, 3))] += 1
    assert len(words(rows[0][1] or "")) >= 0 and Counter((r.doc_id, r.held_out, r.n_tokens, round(r.score, 3)) for r in got) == want
