"""Results that must not hang on how often a row stands in a table, how short its text is, or how large its group is."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa

from ledgerloom.llm import language_id, ngram_join, quality_classifier, quality_rules
from ledgerloom.llm.words import words_of


def chained(r, n=70, size=60):
    """Texts each a little different from an earlier one: one component of links near the threshold."""
    words = [f"w{i}" for i in range(4000)]
    texts = [[r.choice(words) for _ in range(size)]]
    for _ in range(n - 1):
        t = list(r.choice(texts[-8:]))
        for _ in range(r.randint(1, 2)):
            t[r.randrange(size)] = r.choice(words)
        texts.append(t)
    return [" ".join(t) for t in texts]


def test_links_follow_one_rule_at_every_size(spark):
    """At a recall of a half some pairs above the threshold share no band: they are no links, in small components or large ones."""
    texts = chained(random.Random(6))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    recall = 0.5
    got = {b: sorted((x.doc_id, x.class_id, x.n_links) for x in ngram_join.near_duplicates(docs, recall=recall, block=b).collect()) for b in (256, 8, 1)}
    assert got[256] == got[8] == got[1]
    rows, bands = ngram_join.banding(0.8, recall)
    gram, first = ngram_join.grams(words_of(pa.array(texts)), 5)
    sets = [set(gram[a:b].tolist()) for a, b in zip(first, first[1:])]
    h = ngram_join._band_hashes(gram, first[:-1], rows, bands)
    above = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    linked = [(a, b) for a, b in above if (h[:, a] == h[:, b]).any()]
    n = Counter(x for p in linked for x in p)
    assert 0 < len(linked) < len(above) and {i: n[i] for i in range(len(sets))} == {i: k for i, _, k in got[256]}


def test_recall_of_links_on_given_documents(spark):
    """All pairs of the near copies of the given documents, by an index of grams: the share of links that banding meets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    gram, first = ngram_join.grams(words_of(pa.array([t for _, t in rows])), 5)
    sets = [frozenset(gram[a:b].tolist()) for a, b in zip(first, first[1:])]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    common = Counter((a, b) for ids in where.values() for b in ids for a in ids if a < b)
    want = Counter(rows[x][0] for (a, b), c in common.items() if Fraction(c, len(sets[a]) + len(sets[b]) - c) >= ngram_join.THRESHOLD for x in (a, b))
    got = {x.doc_id: x.n_links for x in ngram_join.near_duplicates(docs).collect() if x.n_links}
    assert sum(want.values()) > 100 and sum(got.values()) >= 0.999 * sum(want.values()) and all(n <= want[i] for i, n in got.items())


def test_a_language_of_short_texts_is_learnt(spark):
    """Twelve languages of long texts, and one of five bytes a text that shares their letters."""
    r = random.Random(9)
    own = {f"l{k:02}": r.sample("abcdefghijklmnopqrst", 7) for k in range(12)}
    rows = [(" ".join("".join(r.choice(c) for _ in range(r.randint(2, 6))) for _ in range(60)), k) for k, c in own.items() for _ in range(40)]
    rows += [("".join(r.choice("xyzab") for _ in range(5)), "short") for _ in range(40)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    net = language_id.train(*language_id.sample_of(docs))
    right = Counter(x.lang for x in language_id.identify(docs, net).collect() if x.lang == x.lang_pred)
    assert right["short"] >= 36 and all(right[k] >= 36 for k in own)


def test_a_language_of_copies_is_learnt(spark):
    """100,000 copies of one text and five others of a language, beside a hundred texts of each of three more."""
    r = random.Random(2)
    rows = [(" ".join("".join(r.choice(c) for _ in range(4)) for _ in range(30)), k) for k, c in (("a", "abcdef"), ("b", "ghijkl"), ("c", "mnopqr")) for _ in range(100)]
    few = [" ".join("".join(r.choice("stuvwx") for _ in range(4)) for _ in range(30)) for _ in range(6)]
    many = spark.range(100_000).selectExpr(f"'{few[0]}' AS text", "'d' AS lang")
    docs = spark.createDataFrame([*rows, *((t, "d") for t in few[1:])], "text string, lang string").unionByName(many)
    texts, langs = language_id.sample_of(docs)
    assert {t for t, k in zip(texts, langs) if k == "d"} == set(few) and langs.count("d") == 6 and langs.count("a") == 100
    out = language_id.identify(docs.distinct(), language_id.train(texts, langs)).collect()
    assert all(x.lang == x.lang_pred for x in out if x.lang == "d")


def test_padding_teaches_nothing():
    """Gradients of sequences of several sizes together are the mean of each one's own."""
    net = language_id.fresh(["a", "b", "c"], 5)
    r = np.random.default_rng(3)
    x, y, sizes = r.integers(0, 256, (6, 9)), r.integers(0, 3, 6), np.array([1, 9, 4, 2, 9, 7])
    loss, grads = language_id.gradients(net, x, y, sizes)
    alone = [language_id.gradients(net, x[i : i + 1, :n], y[i : i + 1]) for i, n in enumerate(sizes)]
    assert np.isclose(loss, np.mean([a for a, _ in alone]), rtol=1e-5)
    for k, g in enumerate(grads):
        assert np.allclose(g, np.mean([a[k] for _, a in alone], 0), atol=1e-6)


def test_a_repeated_labelled_document_is_one_row(spark):
    """A labelled document that stands 2,000 times does not fill the classifier's sample."""
    texts = [(i, f"word{i} and some more of it, number {i} " * (3 + i % 9)) for i in range(40)]
    docs = spark.createDataFrame(texts + [texts[3]] * 2000 + [(3, "another text of it")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1)] * 50, "doc_id long, quality int")
    x, y = quality_classifier.labelled(quality_classifier.text_counts(docs), labels, 60)
    assert len(x) == 41 and y.sum() == 21


def test_copies_are_one_trial_of_the_rules(spark, tmp_path):
    """A thousand copies of labelled texts, under one id and under many, certify nothing that the texts alone don't."""
    r = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        bad = i % 3 == 0
        rows.append((i, " ".join(f"w{r.randrange(9000)}" + ("#" if bad and r.random() < 0.5 else "") for _ in range(60)), "en"))
        labels.append((i, int(not bad), 0))
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    copies = one.unionByName(one.where("doc_id = 4").crossJoin(spark.range(1000)).select("doc_id", "text", "lang"))
    copies = copies.unionByName(one.where("doc_id < 90").crossJoin(spark.range(1, 20).withColumnRenamed("id", "n")).selectExpr("doc_id + 1000 * n AS doc_id", "text", "lang"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    more = marks.unionByName(marks.where("doc_id < 90").crossJoin(spark.range(1, 20).withColumnRenamed("id", "n")).selectExpr("doc_id + 1000 * n AS doc_id", "quality", "toxic"))
    plain = quality_rules.cutoffs(quality_rules.rule_counts(one), marks).collect()
    assert quality_rules.cutoffs(quality_rules.rule_counts(copies), more).collect() == plain and len(plain) == 1
    # the SQL goes by id: over the copies under many ids
    copies.distinct().write.parquet(f"{tmp_path}/documents.parquet")
    more.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {(w[0], w[-1]) for w in con.execute(quality_rules.ORACLE).fetchall()}
    got = quality_rules.op2_quality_rules(spark, str(tmp_path)).collect()
    assert {(x.doc_id, x.kept) for x in got} == want and 0 < sum(not k for _, k in want) < len(want)
