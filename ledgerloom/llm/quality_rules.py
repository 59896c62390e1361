"""Quality rules whose cutoffs are certified on labelled documents.

Each rule rejects a document whose share of something (symbols among characters, repeated lines, repeated words) exceeds a
cutoff. Documents that fail the base rule (fewer than 50 words, or more than half of them repeated) are out beforehand and
take no part in what follows.

Labelled texts are counted once a stratum, whatever their copies: copies are not independent trials. They are parted by a hash of
the text, so that copies lie in one part. On one part (`choice`) a path of rule sets is laid out for
each stratum (language): at step i every rule has the strictest cutoff that rejects at most STEPS[i] of the good
documents there, or none if that cutoff rejects no larger share of the bad than of the good ones. The other part (`holdout`) certifies: step by step the
good documents that the whole rule set rejects, by whichever rule, are counted, and the step stands if at a true rate of
`most` so few would be rejected with probability `level` at most (exact binomial tail). `level` is `risk` over the number
of strata (Bonferroni); along the path the tests go in a fixed order that the holdout had no part in, and stop at the first
failure, which needs no further correction. So with probability 1 - risk, in no stratum more than `most` of the good
documents are rejected by all rules together. Of the certified steps the one that best parts bad from good documents of the
`choice` part is used, the more lenient on a tie; where none is certified (too few labels) or none rejects more bad than
good, the stratum has no cutoff and its documents are kept.

Defined results: null and empty texts have zero counts and fail the base rule. A null lang is the stratum ''. Of several labels of
one text the worst counts; null labels are none. Repeated rows are each returned. Extra columns don't come through. An empty table has no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import with_counts
from .shared import by_chunk, materialise, read

MOST, RISK = 0.04, 0.05
#: In thousandths, the most lenient first.
CUTOFFS = (900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10)
#: Good documents in ten thousand that each rule may reject on the choice part, step by step.
STEPS = (0, 10, 20, 30, 50, 70, 100, 150, 200)
#: name: count, of count.
RULES = {"symbols": ("n_symbols", "word_chars"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
#: Rows that are broadcast at most; more strata are joined by a shuffle.
FEW = 10_000
#: First hexadecimal digit of md5 of the text below which it belongs to the choice part: a third.
PART = "5"
BASE_FAILED = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
_FEATURES = "doc_id long, lang string, key string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def rule_counts(docs: DataFrame) -> DataFrame:
    keep = [x.split()[0] for x in _FEATURES.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), "text")
    return by_chunk(rows, lambda b: with_counts(b, ["doc_id", "lang", "key"]).select(keep), _FEATURES)


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X <= x) of n trials at rate p, summed from x down until terms no longer count."""
    if x >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p)
    total, term = 0.0, math.exp(log)
    for i in range(x, -1, -1):
        total += term
        if term < total * 1e-18:
            break
        term *= i * (1 - p) / ((n - i + 1) * p)
    return min(1.0, total)


def certified(good: int, hits: list[int], most: float, level: float) -> int:
    """How many steps of the path hold: good documents of the holdout that each step rejects, the most lenient first."""
    for i, g in enumerate(hits):
        # above the rate that is allowed the bound cannot hold
        if g > most * good or binomial_tail(g, good, most) > level:
            return i
    return len(hits)


def paths(choice: DataFrame) -> DataFrame:
    """Of labelled rows (stratum, quality, counts): stratum, good, bad, step, and a cutoff or null for each rule."""
    hit = lambda a, b, c, q: F.count_if((F.col(a) * 1000 > F.col(b) * c) & (F.col("quality") == q))
    hits = [F.array(*[hit(a, b, c, q) for c in CUTOFFS]).alias(f"hit_{name}_{q}") for name, (a, b) in RULES.items() for q in (0, 1)]
    table = choice.groupBy("stratum").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), *hits)
    steps = F.posexplode(F.array(*[F.lit(s) for s in STEPS]))
    table = table.select("*", steps.alias("step", "share"))
    # hits grow along the cutoffs, so those that are allowed come first; element 0 of none is null
    at = lambda k: F.size(F.filter(f"hit_{k}_1", lambda h: h * 10_000 <= F.col("share") * F.col("good"))) - 1
    table = table.withColumns({f"at_{k}": at(k) for k in RULES})
    gain = lambda k: F.get(f"hit_{k}_0", F.col(f"at_{k}")) * F.col("good") - F.get(f"hit_{k}_1", F.col(f"at_{k}")) * F.col("bad")
    cut = [F.when(gain(k) > 0, F.get(F.array(*[F.lit(c) for c in CUTOFFS]), F.col(f"at_{k}"))).cast("long").alias(f"cut_{k}") for k in RULES]
    return table.select("stratum", "good", "bad", "step", *cut)


def rejected() -> Column:
    """Whether any rule with a cutoff rejects a row."""
    each = [F.coalesce(F.col(a) * 1000 > F.col(b) * F.col(f"cut_{k}"), F.lit(False)) for k, (a, b) in RULES.items()]
    return reduce(lambda a, b: a | b, each)


def cutoffs(counts: DataFrame, labels: DataFrame, most: float = MOST, risk: float = RISK) -> DataFrame:
    """stratum, step, and each rule's cutoff in thousandths: strata with a certified step that rejects more bad than good."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = counts.where(f"NOT {BASE_FAILED}").join(labels, "doc_id").withColumn("stratum", F.coalesce("lang", F.lit("")))
    same = [x.split()[0] for x in _FEATURES.split(", ")[3:]]  # equal texts have equal counts
    known = known.groupBy("stratum", "key").agg(F.min("quality").alias("quality"), *[F.first(c).alias(c) for c in same])
    known = materialise(known.withColumn("choice", F.col("key") < PART))
    path = materialise(paths(known.where("choice")))
    n_strata = known.select("stratum").distinct().count()
    # every labelled row meets the steps of its stratum; sums on the map side
    met = known.join(path, "stratum").withColumn("hit", rejected())
    of = lambda part, q: F.count_if(F.col("hit") & (F.col("choice") == part) & (F.col("quality") == q))
    n = met.groupBy("stratum", "step").agg(
        F.count_if(~F.col("choice") & (F.col("quality") == 1)).alias("n"), of(False, 1).alias("held"), (of(True, 0) * F.first("good") - of(True, 1) * F.first("bad")).alias("gain")
    )
    level = risk / max(1, n_strata)

    def stand(frames):
        for f in frames:
            yield pd.DataFrame({"stratum": f["stratum"], "steps": [certified(int(n), list(h), most, level) for n, h in zip(f["n"], f["hits"])]})

    hits = n.groupBy("stratum").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("step", "held"))), lambda x: x["held"]).alias("hits"))
    good = n.join(hits.mapInPandas(stand, "stratum string, steps int"), "stratum").where("step < steps AND gain > 0")
    best = good.groupBy("stratum").agg(F.min_by("step", F.struct(-F.col("gain"), F.col("step"))).alias("step"))
    return path.join(best, ["stratum", "step"]).select("stratum", "step", *[f"cut_{k}" for k in RULES])


def apply_rules(docs: DataFrame, labels: DataFrame, most: float = MOST, risk: float = RISK) -> DataFrame:
    """doc_id, lang, the counts, base_failed, the step and cutoffs of the document's stratum, and kept."""
    counts = materialise(rule_counts(docs))
    cut = materialise(cutoffs(counts, labels, most, risk))
    if cut.count() <= FEW:
        cut = F.broadcast(cut)
    rows = counts.withColumn("stratum", F.coalesce("lang", F.lit(""))).join(cut, "stratum", "left")
    return rows.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & ~rejected())


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_CUTS = ", ".join(f"(SELECT CASE WHEN arg_min(h, c) * s.good > arg_min(g, c) * s.bad THEN min(c) END FROM allowed a WHERE a.stratum = s.stratum AND a.step = s.step AND rule = '{k}') AS cut_{k}" for k in RULES)
_EACH = "\nUNION ALL ".join(f"SELECT stratum, quality, '{k}' AS rule, {a} AS a, {b} AS b FROM choice" for k, (a, b) in RULES.items())
_HIT = "(" + " OR ".join(f"coalesce({a} * 1000 > {b} * cut_{k}, false)" for k, (a, b) in RULES.items()) + ")"
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, md5(coalesce(text, '')) AS key, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)),
often AS (SELECT doc_id, i FROM win JOIN (SELECT doc_id, s FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, s)),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM often, (SELECT unnest(range(3)) AS j) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS d FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT t.doc_id, stratum, key, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(lines.n - lines.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id LEFT JOIN lines ON lines.doc_id = t.doc_id),
known AS (SELECT stratum, key < '{PART}' AS part, min(quality) AS quality, {", ".join(f"first({c}) AS {c}" for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"))} FROM f
  JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND NOT {BASE_FAILED} GROUP BY stratum, key),
choice AS (SELECT * FROM known WHERE part),
size AS (SELECT stratum, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM choice GROUP BY stratum),
each AS ({_EACH}),
tried AS (SELECT stratum, rule, c, count(*) FILTER (quality = 1 AND a * 1000 > b * c) AS g, count(*) FILTER (quality = 0 AND a * 1000 > b * c) AS h FROM each, (SELECT unnest({list(CUTOFFS)}) AS c) GROUP BY ALL),
steps AS (SELECT unnest({list(STEPS)}) AS share, unnest(range({len(STEPS)})) AS step),
allowed AS (SELECT tried.stratum, rule, step, c, g, h FROM tried JOIN size USING (stratum), steps WHERE g * 10000 <= share * good),
path AS (SELECT s.stratum, s.step, good, bad, {_CUTS} FROM (SELECT * FROM size, steps) s),
held AS (SELECT stratum, step, count(*) FILTER (NOT part AND quality = 1) AS n, count(*) FILTER (NOT part AND quality = 1 AND {_HIT}) AS g,
  count(*) FILTER (part AND quality = 0 AND {_HIT}) * first(good) - count(*) FILTER (part AND quality = 1 AND {_HIT}) * first(bad) AS gain
  FROM known JOIN path USING (stratum) GROUP BY stratum, step),
bound AS (SELECT *, CASE WHEN g >= n THEN 1.0 WHEN g > {MOST} * n THEN 1.0 ELSE (SELECT sum(exp(
  lgamma(CAST(n + 1 AS DOUBLE)) - lgamma(CAST(x + 1 AS DOUBLE)) - lgamma(CAST(n - x + 1 AS DOUBLE)) + x * ln({MOST}) + (n - x) * ln(1 - {MOST}))) FROM (SELECT unnest(range(g + 1)) AS x)) END AS tail FROM held),
passed AS (SELECT *, bool_and(tail <= {RISK} / (SELECT count(DISTINCT stratum) FROM known)) OVER (PARTITION BY stratum ORDER BY step) AS ok FROM bound),
cut AS (SELECT * FROM path JOIN (SELECT stratum, step FROM passed WHERE ok AND gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, step) = 1) USING (stratum, step))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_FAILED} AS base_failed, NOT {BASE_FAILED} AND NOT {_HIT} AS kept FROM f LEFT JOIN cut USING (stratum)
"""
