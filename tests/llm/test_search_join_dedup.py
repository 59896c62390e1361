import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import ngram_join, substring_dedup, topk_search
from ledgerloom.llm.components import components
from ledgerloom.llm.words import split_words, words_of

from .helpers import corpus, empty, frame, words


def test_words_are_those_of_bytes_split():
    import pyarrow as pa

    texts = [r[1] for r in corpus(5)]
    w = words_of(pa.array(texts))
    got = [w.buf[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert got == [x for t in texts for x in words(t)]
    assert w.counts().tolist() == [len(words(t)) for t in texts]
    h = dict(zip(got, w.hashes().tolist()))
    assert len(set(h.values())) == len(h)
    assert all(h[x] == y for x, y in zip(got, w.hashes().tolist()))
    assert split_words(np.zeros(0, np.uint8), np.zeros(1, np.int64)).n_docs == 0


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_topk_is_brute_force(spark, n):
    r = random.Random(n)
    base = [r.getrandbits(64) for _ in range(max(1, n // 3))]
    rows = [(i, r.choice(base) ^ (1 << r.randrange(64) if r.random() < 0.5 else 0)) for i in range(n)]
    rows += [(1000 + i, base[0]) for i in range(15)] if n == 300 else []
    signed = [(i, c - (1 << 64) if c >> 63 else c) for i, c in rows]
    df = spark.createDataFrame([*signed, (None, 3), (77777, None)], "id long, code long")
    got = {}
    for x in topk_search.search(df, df.where("id % 7 = 0"), 4).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.distance, x.neighbor_id))
    want = {}
    for q, c in rows:
        if q % 7 == 0:
            best = sorted(((c ^ d).bit_count(), i) for i, d in rows if i != q)[:4]
            if best:
                want[q] = [(k + 1, *b) for k, b in enumerate(best)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_sign_code(spark):
    v = [1.0, -1.0, 0.0, 2.0] + [-1.0] * 59 + [5.0]
    df = spark.createDataFrame([(v,), ([],), (None,)], "v array<float>").select(topk_search.sign_code("v").alias("c"))
    assert [r.c for r in df.collect()] == [9 - (1 << 63), 0, None]


def brute_classes(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both * 9 >= 4 * (len(sets[a]) + len(sets[b])):
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), 1 << 60))
    return Counter((r[0], None if r[0] is None else least[find(i)], links[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_are_brute_force(spark, block):
    rows = corpus(block)
    got = Counter((x.doc_id, x.class_id, x.n_links) for x in ngram_join.near_duplicates(frame(spark, rows), block=block).collect())
    assert got == brute_classes([r[:2] for r in rows])


def test_a_component_of_many_blocks_is_verified_by_bucket(spark):
    """Near copies of one text, more than blocks can hold for each band: every pair counts once, whatever buckets it shares."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.choice([1, 2, 8, 20])):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [rows[3], rows[4], rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((x.doc_id, x.class_id, x.n_links) for x in ngram_join.near_duplicates(docs, block=2).collect())
    assert got == brute_classes(rows)


def test_a_long_chain_is_verified_by_bucket(spark, monkeypatch):
    """Texts that slide along a longer one: one component of many blocks, whose buckets are small. Sets travel by bucket, and links are all there."""
    homes = []
    real = ngram_join._homes
    monkeypatch.setattr(ngram_join, "_homes", lambda *a: homes.append(real(*a)) or homes[-1])
    w = [f"w{i}" for i in range(1600)]
    rows = [(i, " ".join(w[i * 10 : i * 10 + 200])) for i in range(130)] + [(200, "another text"), (7, " ".join(w[70:270]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((x.doc_id, x.class_id, x.n_links) for x in ngram_join.near_duplicates(docs, block=2).collect())
    assert got == brute_classes(rows)
    assert homes[0].selectExpr("explode(homes) AS h").where("h.band >= 0").count() > 130


def test_near_duplicates_of_nothing(spark):
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


def test_banding_reaches_its_recall():
    rows, bands = ngram_join.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_linked_is_exact():
    r = random.Random(3)
    sets = [np.array(sorted(r.sample(range(60), r.randint(1, 50))), np.uint64) for _ in range(40)]
    got = ngram_join.linked(sets, step=7)
    for a in range(40):
        for b in range(40):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert got[a, b] == (a != b and len(x & y) * 5 >= 4 * len(x | y))
    wide = [s * np.uint64(0x9E3779B97F4A7C15) for s in sets]
    wide = [np.sort(s) for s in wide]
    for most in (1, 50, 10**6):
        assert (ngram_join.linked(wide, step=7, most=most) == got).all()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_components_with_a_hub(spark):
    """Two hubs of thousands of edges, joined by one; one of them isn't the least node of its own."""
    edges = [(5, 10_000 + i) for i in range(3000)] + [(90_000, 20_000 + i) for i in range(3000)] + [(12_999, 22_999), (7, 8)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {x: 7 if x in (7, 8) else 5 for e in edges for x in e}


def brute_kept(rows, k=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - k + 1):
            s = tuple(w[j : j + k])
            if i is not None:
                first[s] = min(i, first.get(s, 1 << 60))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                gone |= set(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("bucket", [6 << 20, 2000])
def test_substring_dedup_is_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket)
    rows = corpus(bucket % 97)
    out = substring_dedup.dedup_substrings(frame(spark, rows))
    got = Counter((x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept_text.encode()).hexdigest()) for x in out.collect())
    assert got == brute_kept([r[:2] for r in rows])
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


@pytest.mark.parametrize("part", [1, 300, 4000])
def test_hot_buckets_go_on_in_parts(spark, part, monkeypatch):
    """One frequent trigram with changing words round it, copies of a passage in every other text, and parts of a few windows."""
    monkeypatch.setattr(substring_dedup, "LEVELS", 3)
    r = random.Random(part)
    w = [f"w{i}" for i in range(30)]
    passage = [r.choice(w) for _ in range(40)]
    rows = []
    for i in range(60):
        text = [x for _ in range(6) for x in ("always the same", *(r.choice(w) for _ in range(r.randint(1, 3))))]
        rows.append((i, " ".join([*text, *(passage[r.randint(0, 9) :] if i % 2 else []), *(r.choice(w) for _ in range(20))])))
    rows += [(None, rows[3][1]), rows[7], (70, None), (71, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = substring_dedup.dedup_substrings(docs, part_bytes=part)
    assert Counter((x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept_text.encode()).hexdigest()) for x in out.collect()) == brute_kept(rows)


def test_windows_under_one_hash_are_told_apart(spark, monkeypatch):
    """With a hash that says nothing, the bytes decide."""
    import pyarrow as pa

    real = substring_dedup.windows
    monkeypatch.setattr(substring_dedup, "windows", lambda h, k: real(h, k) if k != 13 else np.zeros(max(0, len(h) - k + 1), np.uint64))
    rows = sorted({r[:2] for r in corpus(4, n=62) if r[0] is not None and r[0] < 60 and r[1]})
    table = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t, "key": i} for i, t in rows])
    sent = sorted((x for b in substring_dedup._spread(iter([table]), 3, 13, 3) for x in b.to_pylist()), key=lambda x: x["bucket"])
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())] + [(c, pa.binary()) for c in ("texts", "doc", "key", "pos", "spans")])
    spans = {}
    for b in substring_dedup._count(iter([pa.RecordBatch.from_pylist(sent, schema)]), 13, 3, 0, 3, 1 << 30):
        for x in b.to_pylist():
            spans.setdefault(x["doc_id"], set()).update(range(x["a"], x["b"]))
    want = {i: n for i, _, n, _ in brute_kept(rows)}
    assert {i: len(spans.get(i, ())) for i, _ in rows} == want
