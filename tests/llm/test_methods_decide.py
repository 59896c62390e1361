"""What each operator's method decides beyond its base: secrets that no pattern has, cutoffs, sequence lengths, languages."""

import random
from collections import Counter
from fractions import Fraction
from itertools import product
from math import comb

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import language_id, packing, quality_rules, secret_scans, sentencepiece_codec
from ledgerloom.llm.words import words_of

from .helpers import corpus, empty, frame

BASE62 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN = (
    "https://www.example.org/wiki/Linear_chain?page=2 john.smith1984@mail.example.com 2024-05-06T07:08:09Z ISO-8859-1 A320neo COVID-19 x86_64-linux-gnu "
    "/usr/local/lib/python3.11/site-packages Donaudampfschifffahrtsgesellschaft getElementById 127.0.0.1:8080 +1-202-555-0147 1,234,567 key=value utf-8 3.14159265358979"
).split()


@pytest.fixture(scope="module")
def field(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return secret_scans.learn(secret_scans.sample_of(docs))


def sentences(seed, n, size=50):
    r = random.Random(seed)
    words = ["".join(r.choice(["th", "en", "la", "on", "der", "ing", "que", "a", "es"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    return [[r.choice(words) for _ in range(size)] for _ in range(n)]


def test_field_finds_what_the_patterns_miss(field):
    r = random.Random(3)
    key = lambda n, letters=BASE62: "".join(r.choice(letters) for _ in range(n))
    forms = {
        "other name": lambda: "pwd=" + key(20), "prefixed": lambda: "ghp_" + key(36), "dashes": lambda: f"xoxb-{key(12, '0123456789')}-{key(24)}", "short prefix": lambda: "sk-" + key(40),
        "dotted": lambda: f"eyJ{key(30)}.eyJ{key(60)}.{key(43, BASE62 + '-_')}", "capitals": lambda: key(32, "0123456789ABCDEF"), "quoted": lambda: f'"{key(40, BASE62 + "+/")}"', "live": lambda: "sk_live_" + key(24),
    }
    for name, form in forms.items():
        hits, rows = 0, sentences(len(name), 60)
        for words in rows:
            secret = form()
            while secret_scans.pattern_spans(text := " ".join([*words[:25], secret, *words[25:]])):
                secret = form()
            middle = text.index(secret) + len(secret) // 2
            hits += any(a <= middle < b for a, b, _ in secret_scans.chunk_spans(pa.array([text]), field)[0])
        assert hits >= 54, name


def test_field_leaves_plain_words_alone(field, spark):
    for words in sentences(5, len(PLAIN)):
        text = " ".join([*words[:20], PLAIN.pop(), *words[20:]])
        assert secret_scans.chunk_spans(pa.array([text]), field) == [[]], text
    out = secret_scans.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), field)
    assert out.where("spans like '%crf%' and n_assign + n_access + n_hex = 0").count() <= 1


def test_spans_are_a_brute_force_decoding(spark, field):
    """The spans of the query's column from the path of greatest score, found for each text by plain dynamic programming."""
    r = random.Random(8)
    texts = []
    for words in sentences(9, 40, 30):
        words.insert(12, r.choice(["ghp_" + "".join(r.choice(BASE62) for _ in range(36)), "password=abcdefabcdef12", "name = 'Xk29fj20slPQ02aaB'", "é", "0123456789abcdef0"]))
        texts.append(" ".join(words))
    texts += ["", " ", "x" * 40, texts[3]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = {x.doc_id: x.spans for x in secret_scans.scan(docs, field).collect()}
    assert got[99] == ""
    added = 0
    for d, text in enumerate(texts):
        words = words_of(pa.array([text]))
        score = [[float(sum(field.weights[i, k] for i in row)) for k in range(3)] for row in secret_scans.features(words)]
        best = {(): 0.0}
        table: list[dict[int, tuple[float, list[int]]]] = []
        for t, e in enumerate(score):
            row = {}
            for k in range(3):
                if t == 0:
                    row[k] = (e[k] - 1e4 * (k == 2), [k])
                else:
                    s, p = max(((table[-1][j][0] + field.steps[j, k], table[-1][j][1]) for j in range(3)), key=lambda x: x[0])
                    row[k] = (s + e[k], [*p, k])
            table.append(row)
        path = max(table[-1].values(), key=lambda x: x[0])[1] if table else []
        spans = secret_scans.pattern_spans(text)
        raw = text.encode()
        for i, k in enumerate(path):
            if k == 1:
                j = i
                while j + 1 < len(path) and path[j + 1] == 2:
                    j += 1
                a, b = len(raw[: words.start[i]].decode()), len(raw[: words.end[j]].decode())
                inner = text[a:b]
                a += len(inner) - len(inner.lstrip("\"'`([{<,;"))
                b -= len(inner) - len(inner.rstrip("\"'`)]}>,;.!?"))
                if a < b and all(b <= x or a >= y for x, y, _ in spans):
                    spans.append((a, b, 3))
                    added += 1
        assert got[d] == ",".join(f"{secret_scans.KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans)) and best
    assert added >= 5


def test_cutoffs_are_brute_force(spark):
    """Strata with certified cutoffs, one that has too few labels, one with good documents full of symbols; every step by plain counting."""
    r = random.Random(6)
    rows, labels = [], []
    for lang, n, good_symbols in (("aa", 900, 0), ("bb", 700, 0.004), ("cc", 60, 0), ("dd", 500, 0.5)):
        for _ in range(n):
            i, bad = len(rows), r.random() < 0.2
            share = r.choice([0.1, 0.2, 0.35]) if bad or r.random() < good_symbols else 0
            words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(80)]
            rows.append((i, " ".join(w if r.random() > share else "#####$" for w in words) + ("\nx y z" * r.choice([0, 2, 9]) if bad else ""), lang))
            labels.append((i, 0 if bad else 1, 0))
    rows += [(len(rows), None, "aa"), (len(rows) + 1, "", None), (None, "w " * 60, "aa"), rows[5], (10**6, "x" * 70_000, "bb")]
    labels += [(3, None, 0), (None, 1, 0), (7, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality_rules.apply_rules(docs, known).collect()
    import hashlib

    worst = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            worst[i] = min(q, worst.get(i, 1))
    counts, texts = {}, {}
    for i, t, _ in rows:
        texts.setdefault(i, set()).add(hashlib.md5((t or "").encode()).hexdigest())
    every = []
    for x in out:
        base = x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words
        assert x.base_failed == base
        every.append((x, base, x.lang or ""))
        if not base and x.doc_id in worst:
            # a text counts once a stratum, under its worst label
            assert x.key in texts[x.doc_id]
            _, q, _ = counts.setdefault(x.lang or "", {}).get(x.key, (0, 1, 0))
            counts[x.lang or ""][x.key] = (x.key < quality_rules.PART, min(q, worst[x.doc_id]), [(getattr(x, a), getattr(x, b)) for a, b in quality_rules.RULES.values()])
    counts = {k: list(v.values()) for k, v in counts.items()}
    level, chosen = Fraction(1, 20) / len(counts), {}
    for lang, held in counts.items():
        good, bad = (sum(p and q == k for p, q, _ in held) for k in (1, 0))
        n = sum(not p and q == 1 for p, q, _ in held)
        best = (0, None)
        for share in quality_rules.STEPS:
            cuts = []
            for j in range(3):
                hit = lambda c, k, j=j: sum(p and q == k and v[j][0] * 1000 > v[j][1] * c for p, q, v in held)
                ok = [c for c in quality_rules.CUTOFFS if hit(c, 1) * 10_000 <= share * good]
                c = min(ok, default=None)
                cuts.append(c if c is not None and hit(c, 0) * good > hit(c, 1) * bad else None)
            out_of = lambda v, cuts=cuts: any(c is not None and a * 1000 > b * c for (a, b), c in zip(v, cuts))
            g = sum(not p and q == 1 and out_of(v) for p, q, v in held)
            p = Fraction(1, 25)
            if g > p * n or sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(g + 1)) > level:
                break
            gain = sum(p and q == 0 and out_of(v) for p, q, v in held) * good - sum(p and q == 1 and out_of(v) for p, q, v in held) * bad
            if gain > best[0]:
                best = (gain, cuts)
        chosen[lang] = best[1]
    assert chosen["aa"] and chosen["bb"] and chosen["cc"] is None
    assert len(out) == len(rows)
    for x, base, lang in every:
        cuts = chosen.get(lang)
        over = bool(cuts) and any(c is not None and getattr(x, a) * 1000 > getattr(x, b) * c for c, (a, b) in zip(cuts, quality_rules.RULES.values()))
        assert x.kept == (not base and not over)
    assert sum(not x.kept and not base for x, base, _ in every) > 200


def total(capacities):
    return sum(packing.cost(int(c)) for c in capacities)


def test_joint_choice_beats_the_largest_length():
    r = np.random.default_rng(1)
    mixed = {"short": (r.integers(20, 400, 8000), 0.85), "log-normal": (np.clip(np.exp(r.normal(5.5, 1, 20_000)), 1, 4096).astype(int), 0.9), "two sizes": (np.where(r.random(4000) < 0.5, 600, 1400), 0.92), "long": (r.integers(1, 4096, 8000), 1.001)}
    for name, (sizes, most) in mixed.items():
        sizes = np.sort(sizes)[::-1]
        bins, _, caps = packing.best_fit(sizes)
        held = np.bincount(packing.best_fit(sizes, (4096,))[0], sizes).astype(int)
        largest = np.array(packing.CAPACITIES)[np.searchsorted(packing.CAPACITIES, held)]  # shrunk in the end too
        assert total(caps) <= most * total(largest), name
        if name != "long":
            assert set(caps.tolist()) - {4096}


def brute_cost(sizes, capacities):
    """Least cost of any partition of the sizes into sequences."""
    best = [float("inf")]

    def go(i, bins, spent):
        if spent >= best[0]:
            return
        if i == len(sizes):
            best[0] = spent
            return
        for b in range(len(bins)):
            if bins[b] + sizes[i] <= capacities[-1]:
                old = bins[b]
                bins[b] += sizes[i]
                go(i + 1, bins, sum(packing.cost(min(c for c in capacities if c >= x)) for x in bins))
                bins[b] = old
        bins.append(sizes[i])
        go(i + 1, bins, sum(packing.cost(min(c for c in capacities if c >= x)) for x in bins))
        bins.pop()

    go(0, [], 0.0)
    return best[0]


def test_packing_is_near_the_best_of_all():
    r, shares = random.Random(2), []
    for _ in range(60):
        sizes = sorted((min(4096, int(np.exp(r.gauss(6.3, 1)))) for _ in range(r.randint(1, 7))), reverse=True)
        caps = packing.best_fit(np.array(sizes))[2]
        shares.append(total(caps) / brute_cost(sizes, packing.CAPACITIES))
    assert min(shares) >= 1 - 1e-9 and np.mean(shares) < 1.08 and max(shares) < 1.6


def test_copies_spread_over_groups(spark):
    """A row repeated a thousand times makes no group of its own, and long documents count by their pieces."""
    docs = spark.createDataFrame([(1, "w " * 300)] * 1000 + [(2, "v " * 100_000), (3, ""), (3, None)], "doc_id long, text string")
    out = packing.pack(docs, group_rows=100).collect()
    assert sum(x.n_tokens for x in out) == 300_000 + 100_000 and len(out) == 1000 + 25 + 2
    assert max(Counter(x.bin >> 32 for x in out if x.bin is not None).values()) < 200


def test_window_is_measured():
    """Boundaries held between the last committed one and the one at work, and time on a text whose paths never meet."""
    pieces = sentencepiece_codec.load(sentencepiece_codec.default_model())
    coder, widest, early = sentencepiece_codec.Coder(pieces), 0, 0
    text = "▁" + "thingonthatering" * 300
    for c in text:
        early += len(coder.feed(c))
        widest = max(widest, coder.window)
    assert widest <= pieces.longest and early > 0.95 * len(sentencepiece_codec.viterbi(text, pieces)) and early + len(coder.finish()) == len(sentencepiece_codec.viterbi(text, pieces))
    assert len(sentencepiece_codec.viterbi("abc" * 20_000, pieces)) > 10_000
    # three pieces of equal score that chain for ever: no two paths meet before the end
    never = sentencepiece_codec.Pieces({"abc": -1.0, "bca": -1.0, "cab": -1.0, "a": -1.0, "b": -1.0, "c": -1.0}, {k: i for i, k in enumerate(["abc", "bca", "cab", "a", "b", "c"])}, [], 9, [b""] * 6)
    ids = sentencepiece_codec.viterbi("abc" * 20_000, never)
    assert ids == [0] * 20_000


def test_a_hundred_and_twenty_languages(spark):
    """Every language is learnt, those of long texts only among them."""
    r = random.Random(4)
    pairs = ["".join(x) for x in product("abcdefghijklmnopqrst", repeat=2)]
    rows, i = [], 0
    for k in range(120):
        own = r.sample(pairs, 6)
        for _ in range(9):
            size = 4000 if k % 10 == 0 else 60
            rows.append((i := i + 1, " ".join("".join(r.choice(own) for _ in range(r.randint(1, 3))) for _ in range(size)), f"l{k:03}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    texts, langs = language_id.sample_of(docs, 600, 6, 300)
    assert len(set(langs)) == 120 and max(Counter(langs).values()) == 6 and all(0 < len(t) <= 300 for t in texts)
    net = language_id.train(texts, langs, steps=300)
    assert net.languages == sorted({x for *_, x in rows})
    out = language_id.identify(docs, net).collect()
    right = Counter(x.lang for x in out if x.lang == x.lang_pred)
    assert sum(right.values()) > 0.8 * len(out) and len(right) > 110


def plain_logs(net, data):
    """Position log probabilities of one window by plain loops."""
    size, states = net.turn[0].shape[0], []
    for side in (0, 1):
        h, row = np.zeros(size), {}
        for t in range(len(data)) if side == 0 else range(len(data) - 1, -1, -1):
            a, u = net.table[side][data[t]] + net.shift[side], h @ net.turn[side]
            r, z = (np.clip(0.2 * (a[s] + u[s]) + 0.5, 0, 1) for s in (slice(0, size), slice(size, 2 * size)))
            new = np.clip(a[2 * size :] + r * u[2 * size :], -1, 1)
            row[t] = h = new + z * (h - new)
        states.append(row)
    out = []
    for t in range(len(data)):
        x = np.concatenate([states[0][t], states[1][t]]) @ net.out + net.bias
        out.append(x - x.max() - np.log(np.exp(x - x.max()).sum()))
    return np.array(out)


def test_query_scores_are_the_plain_network(spark):
    """identify() against the network run by plain loops over windows with their context; long, empty, null and repeated texts."""
    net = language_id.fresh(["a", "b", "c"], 5, seed=7)
    texts = ["one two three", "é" * 700, "字" * 300 + " x", "a", "", None, "word " * 400, "a", "12 34"]
    out = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), net).collect()
    for x in out:
        raw = (x.text or "").encode()
        cuts = [0]
        while cuts[-1] < len(raw):
            at = min(len(raw), language_id.WINDOW * len(cuts))
            while at < len(raw) and raw[at] & 0xC0 == 0x80:
                at += 1
            cuts.append(at)
        sums = np.zeros(3)
        for a, b in zip(cuts, cuts[1:]):
            lo, hi = max(0, a - language_id.CONTEXT), min(len(raw), b + language_id.CONTEXT)
            while lo < len(raw) and raw[lo] & 0xC0 == 0x80:
                lo += 1
            while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                hi += 1
            sums += plain_logs(net, raw[lo:hi])[a - lo : b - lo].sum(0)
        if not any(c.isalpha() for c in x.text or ""):
            assert (x.lang_pred, x.score) == ("und", 0)
            continue
        p = np.exp(sums / len(raw) - (sums / len(raw)).max())
        assert x.lang_pred == net.languages[int(sums.argmax())] and x.score == pytest.approx((p / p.sum()).max(), abs=1e-4)
    assert language_id.identify(empty(spark), net).count() == 0
    assert [c for c in language_id.identify(frame(spark, corpus(2)), net).columns if c not in ("lang_pred", "score")] == [c for c in frame(spark, corpus(2)).columns if c != "score"]
