"""Whitening, vector codes and line dedup: against plain numpy and Python, as returned and in their parts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, vector_codes, vectors, whitening

from .helpers import corpus, empty, frame

VECTORS = "vec_id long, embedding array<float>, label int, x string, deviation string, code string, _label long"


def embeddings(seed=3, n=300, d=32):
    """Vectors with copies, and rows that are dropped; null ids and labels, an id that stands twice, one hot vector."""
    r = np.random.default_rng(seed)
    v = (r.standard_normal((n, d)) * np.linspace(0.1, 1.5, d)).astype(np.float32)
    v[n // 3 : 2 * n // 3] = v[5]
    rows = [(i, v[i].tolist(), int(i % 5)) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] * d, 1), (n + 2, [float("nan")] + v[0, 1:].tolist(), 1), (n + 3, v[0, 1:].tolist() + [float("-inf")], 2)]
    rows += [(None, v[9].tolist(), None), (7, v[9].tolist(), None), rows[3], rows[3], (n + 4, [-0.0] * d, None), (n + 5, (v[8] / 300).tolist(), 3)]
    random.Random(seed).shuffle(rows)
    return [(*x, "clash", "clash", "clash", 9) for x in rows]


def kept(rows):
    good = [x for x in rows if x[1] is not None and all(c is not None and np.isfinite(c) for c in x[1])]
    d = max(len(x[1]) for x in good)
    return good, np.array([np.floor(256 * np.array(list(x[1]) + [0.0] * (d - len(x[1])), np.float32).astype(float)) for x in good]).astype(np.int64)


@pytest.mark.parametrize("ragged", [False, True])
def test_whitening_as_returned(spark, tmp_path, ragged):
    rows = embeddings() + ([(900, [0.5, -0.25], 1, "", "", "", 1), (901, [], 1, "", "", "", 1), (902, [0.5, -0.25, 0.0], 1, "", "", "", 1)] if ragged else [])
    spark.createDataFrame(rows, VECTORS).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op11_embedding_whitening(spark, str(tmp_path)).collect()
    good, x = kept(rows)
    fit = np.unique(x, axis=0)
    n, centred = len(fit), fit - fit.mean(0)
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1], components[:, ::-1]
    want = (x - fit.mean(0)) @ components[:, :4] / np.sqrt(values[:4])
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, fit.sum(0))) for row in x]
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n}
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-10
    for r in got:
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
    for c in range(4):
        mine = defaultdict(list)
        for r in got:
            if r.component == c + 1:
                mine[(r.vec_id, r.deviation)].append(r.whitened)
        theirs = defaultdict(list)
        for (i, *_), dev, w in zip(good, exact, want[:, c]):
            theirs[(i, dev)].append(w)
        assert {k: len(v) for k, v in mine.items()} == {k: len(v) for k, v in theirs.items()}
        a = np.concatenate([sorted(mine[k]) for k in sorted(mine, key=str)])
        b = np.concatenate([sorted(theirs[k]) for k in sorted(theirs, key=str)])
        sign = np.sign(a @ b) or 1
        b = b if sign > 0 else np.concatenate([sorted(-np.array(theirs[k])) for k in sorted(theirs, key=str)])
        assert np.abs(a - b).max() < 1e-8


def test_block_lanczos_restarts_and_breaks_down():
    """A large matrix with small bases, one of low rank, one with an eigenvalue that stands six times; products only."""
    r = np.random.default_rng(8)
    q = np.linalg.qr(r.standard_normal((300, 300)))[0]
    for values in (np.sort(r.random(300))[::-1] ** 3 * 50, np.r_[9.0, 8, 7, np.zeros(297)], np.r_[np.full(6, 5.0), np.linspace(4, 0, 294)], np.zeros(300)):
        a = (q * values) @ q.T
        for most in (128, 24):
            calls = []
            got, v = whitening.block_lanczos(lambda b: calls.append(b.shape[1]) or a @ b, 300, 4, most=most)
            assert np.allclose(got, values[:4], atol=1e-9) and np.allclose(v.T @ v, np.eye(4), atol=1e-12)
            assert np.linalg.norm(a @ v - v * got) <= 1e-9 * max(1, values[0])
            assert all(n <= whitening.BLOCK for n in calls)
    got, v = whitening.block_lanczos(lambda b: np.diag([3.0, 1.0]) @ b, 2, 4)
    assert np.allclose(got, [3, 1]) and v.shape == (2, 2)


def test_deviations_are_exact_beyond_a_long():
    x = np.array([[1 << 40, -(1 << 39)], [3, -4], [(1 << 63) - 1, 0], [1500, -2]], np.int64)
    for n, sums in ((3, [5, -7]), (10**6, [10**9, 4]), (1 << 50, [1 << 70, -(1 << 65)])):
        assert whitening.deviations(x, n, sums) == [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]


def test_whitening_of_few_vectors(spark):
    """No rows, no usable row, one vector many times, two vectors, vectors of no entries, huge entries; columns that clash."""
    for rows, per_row in (([], 0), ([(1, None)], 0), ([(1, [0.1, 0.7])] * 9, 0), ([(1, [])], 0), ([(1, [0.1, 0.2]), (2, [0.3, -0.2]), (2, [0.3, -0.2])], 1), ([(1, [1e30, 1.0]), (2, [-1e30, 0.5]), (3, [0.0, 0.0])], None)):
        df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], "vec_id long, v array<double>, Whitened string, deviation string")
        model = whitening.learn(df, "v")
        out = whitening.whiten(df, model, "v")
        assert out.columns == ["vec_id", "v", "deviation", "whitened"]
        got = out.collect()
        if per_row is not None:
            assert all(len(r.whitened) == per_row for r in got)
        assert len(got) == sum(v is not None for _, v in rows) * (model is not None)
        if rows and rows[0][1] and rows[0][1][0] == 1e30:
            assert got[0].deviation is None  # no long holds it


def brute_codes(rows, parts=16, entries=64, rounds=2):
    good, x = kept(rows)
    w = -(-x.shape[1] // parts)
    x = np.hstack([x, np.zeros((len(x), w * parts - x.shape[1]), np.int64)]).reshape(len(x), parts, w)
    ids = sorted({r[0] for r in good if r[0] is not None})[:entries]
    books = np.array([min(x[i].ravel().tolist() for i, r in enumerate(good) if r[0] == k) for k in ids]).reshape(len(ids), parts, w).transpose(1, 0, 2)
    for last in range(rounds + 1):
        away = ((x.transpose(1, 0, 2)[:, :, None] - books[:, None]) ** 2).sum(3)
        code = away.argmin(2)
        if last < rounds:
            for p in range(parts):
                for e in range(len(ids)):
                    mine = x[:, p][code[p] == e]
                    if len(mine):
                        books[p, e] = [int(s) // len(mine) for s in mine.sum(0)]
    return good, code.T, away.min(2).sum(0), books


def test_codes_as_returned(spark, tmp_path):
    """The query against brute force: contested ties, copies, few ids, labels with nulls."""
    for n, (rows, heavy) in enumerate([(embeddings(), 1000), (embeddings(5, 40), 1), (embeddings(6, 90, 21) + [(2000, [0.5], 0, "", "", "", 1)], 1000)]):
        spark.createDataFrame(rows, VECTORS).repartition(3).write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        before, vector_codes.HEAVY = vector_codes.HEAVY, heavy
        try:
            got = vector_codes.op12_vector_code_compression(spark, f"{tmp_path}/{n}").collect()
        finally:
            vector_codes.HEAVY = before
        good, code, error, books = brute_codes(rows)
        by_label = Counter()
        for r, e in zip(good, error):
            by_label[r[2]] += int(e)
        digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
        want = Counter((r[0], bytes(c.tolist()).hex(), int(e), by_label[r[2]], digest) for r, c, e in zip(good, code.astype(int), error))
        assert Counter(map(tuple, got)) == want


def test_filtering_assigns_as_brute_force():
    """Small integers make ties everywhere; equal entries; one point; points that are all the same; wide parts in small steps."""
    r = np.random.default_rng(1)
    cases = [(r.integers(-3, 4, (700, 3)), r.integers(-3, 4, (20, 3))), (np.full((50, 2), 7), r.integers(0, 9, (5, 2))), (r.integers(-999, 999, (1, 4)), r.integers(-999, 999, (64, 4)))]
    cases += [(r.integers(-(2**26), 2**26, (900, 4)), r.integers(-(2**26), 2**26, (64, 4))), (r.integers(-90, 90, (400, 40)), np.repeat(r.integers(-90, 90, (8, 40)), 2, 0))]
    for points, book in cases:
        for leaf in (1, 16):
            tree = vector_codes.Tree.of_bytes(vector_codes.build(points, leaf).packed())
            code, sums, count = vector_codes.assign(tree, book)
            want = ((points[:, None] - book) ** 2).sum(2).argmin(1)
            assert (tree.points == points[tree.order]).all() and (code == want[tree.order]).all()
            assert (count == np.bincount(want, minlength=len(book))).all()
            assert all((sums[e] == points[want == e].sum(0)).all() for e in range(len(book)))


def test_subtrees_are_assigned_whole(monkeypatch):
    """Clusters around the entries: few points are compared with any entry one by one."""
    r = np.random.default_rng(2)
    book = r.integers(-4000, 4000, (64, 4))
    points = np.repeat(book, 200, 0) + r.integers(-40, 40, (12800, 4))
    seen = []
    real = vector_codes._compare
    monkeypatch.setattr(vector_codes, "_compare", lambda tree, book, leaf, *a: seen.append(int((tree.end[leaf] - tree.start[leaf]).sum())) or real(tree, book, leaf, *a))
    code, _, _ = vector_codes.assign(tree := vector_codes.build(points), book)
    assert (code == ((tree.points[:, None] - book) ** 2).sum(2).argmin(1)).all()
    assert sum(seen) < len(points) / 4


def test_codes_of_no_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], "c"), (None, None, "c")], "vec_id long, embedding array<double>, code string")
    for rows, n in ((df, 1), (df.limit(0), 0)):
        coded, books = vector_codes.compress(rows)
        assert coded.columns == ["vec_id", "code", "error"] and [tuple(r) for r in coded.collect()] == [(None, None, None)] * n and books.size == 0
    assert spark.createDataFrame([(1, [1e300, -1e300])], "i int, v array<double>").select(vectors.whole("v", 3, 1 << 27)).first()[0] == [1 << 27, -(1 << 27), 0]


def brute_lines(rows):
    key = lambda line: line.encode().strip(b" \t\n\v\f\r").lower().decode()
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (i is not None and len(holders[key(x)]) >= 3 and i < max(holders[key(x)]))]
        out[(i, len(lines), len(lines) - len(stay), "\n".join(stay))] += 1
    return out


def lines_of(seed=4):
    r = random.Random(seed)
    shared = [f"Shared line number {i} of them all" for i in range(12)] + ["é" * 19, "é" * 20, "a" * 19 + " ", "x" * 90_000, "A LINE IN CAPITALS, ÀÉÎ"]
    rows = []
    for i in range(160):
        mine = [r.choice(["", "  ", "\t", "\x0b"]) + r.choice([str.lower, str.upper, str])(r.choice(shared)) + r.choice(["", " ", "\r"]) for _ in range(r.randint(0, 5))]
        mine += [f"only here, in document {i}, is this line {j}" for j in range(r.randint(0, 3))] + ["the line that most documents hold"] * r.choice([0, 1, 2])
        r.shuffle(mine)
        rows.append((i, "\n".join(mine)))
    return [(*x, "en", "s", 1, *["clash"] * 6, 7) for x in rows] + corpus(seed, 60)


@pytest.mark.parametrize("batches,fan,heavy", [(1, 2, 1000), (4, 2, 1), (5, 3, 1000)])
def test_lines_as_returned(spark, tmp_path, monkeypatch, batches, fan, heavy):
    """Any number of batches and levels, frequent lines given to each task or shuffled: the same rows; and the query's digest of them."""
    rows = lines_of()
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    docs = frame(spark, rows).withColumnRenamed("spans", "N_Lines")
    out = line_dedup.dedup_lines(docs, batches, fan)
    assert out.columns == [c for c in docs.columns if c != "N_Lines"] + ["n_lines", "n_dropped", "kept_text"]
    want = brute_lines(rows)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out.collect()) == want
    assert sum(k[2] for k in want) > 300
    if batches == 1:
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        got = line_dedup.op13_line_dedup(spark, str(tmp_path)).collect()
        assert Counter(map(tuple, got)) == Counter({(i, n, d, hashlib.sha256(t.encode()).hexdigest()): c for (i, n, d, t), c in want.items()})


def test_runs_are_merged_level_by_level(spark):
    """What is known to be frequent is not added again; levels stay under FAN runs; a merge of runs moves and sorts nothing."""
    runs = line_dedup.LineRuns(spark, buckets=3)
    line = "a line long enough to count, number "
    for b in range(7, 0, -1):
        docs = [(10 * b + j, line + "0\n" + line + str(10 * b + j)) for j in range(4)]
        runs.add(spark.createDataFrame(docs, "doc_id long, text string"))
        assert all(len(x) < runs.fan for x in runs.levels)
        assert sum(spark.table(n).count() for n in runs.runs()) == 1 + 4 * (8 - b)
    assert [len(x) for x in runs.levels] == [1, 1, 1]
    with line_dedup._sorted_scans(spark):
        a, b, _ = runs.runs()
        plan = runs.merged([a, b])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    (row,) = runs.frequent().collect()
    assert row["last"] == 73
    names = runs.runs()
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_lines_of_no_documents(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    got = line_dedup.dedup_lines(spark.createDataFrame([(None, None), (1, None), (1, ""), (2, "\n")], "doc_id int, text string")).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got) == Counter([(None, 1, 0, ""), (1, 1, 0, ""), (1, 1, 0, ""), (2, 2, 0, "\n")])
