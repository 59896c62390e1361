"""N-gram Jaccard self-join of documents by MinHash banding, verified on full n-gram sets.

1. Each text becomes a set of n-gram hashes and rows x bands minimum hashes; the numbers of rows and bands are the cheapest
   that find a pair at the threshold with the target probability. Equal sets become one node (its documents are links of
   each other), so thousands of copies are one row from here on.
2. Nodes meet on band hashes: a shuffle of (band, hash, node) with map-side minima; each node is tied to the least node of
   each of its buckets. The components of those ties hold every pair that shares a band.
3. Components are verified on the full sets, in cells of two blocks of nodes: all pairs of a cell at once, as the product of
   incidence matrices. A link is a pair at the threshold that shares a band, whatever the component's size. A component is verified whole; where it has so many blocks that a set would travel more often than it
   has bands, each of its buckets is, a pair in the first of the buckets that it shares. So a set travels a bounded number of
   times, but for buckets that are large themselves. Out of a cell come each node's number of links and its least linked node, never the pairs.
4. Classes are the components of verified links.

Defined results: a text with fewer than n words has one gram, all its words; a null or empty text has none, no link and a
class of its own. A null doc_id is returned with a null class and no link. Rows that repeat a doc_id count as further
documents. Very long texts are taken whole; pairs at the very threshold are links. Extra columns don't come through. An empty table has no
rows. Sets are told apart by 64-bit hashes of their hashed grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, joined
from .shared import by_chunk, materialise, read, release, small_batches
from .words import MUL, Words, inside, mixed, windows, words_of

N, THRESHOLD, RECALL = 5, Fraction(4, 5), 0.9999
#: Nodes of a block; a cell has two at most.
BLOCK = 256


def banding(threshold: float = float(THRESHOLD), recall: float = RECALL, most: int = 256) -> tuple[int, int]:
    """rows, bands: of those that reach the recall at the threshold with `most` hashes at most, the ones that let
    through the fewest pairs of half the threshold; fewer hashes on a tie."""
    found = []
    for rows in range(1, most + 1):
        miss = 1 - threshold**rows
        if miss >= 1:
            break
        bands = 1 if miss <= 0 else max(1, math.ceil(math.log(1 - recall) / math.log(miss)))
        if rows * bands <= most:
            found.append((round(1 - (1 - (threshold / 2) ** rows) ** bands, 3), rows * bands, rows, bands))
    return min(found)[2:]


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct gram hashes of each text, and their first index for each text (and the end)."""
    hashes, counts, first = words.hashes(), words.counts(), words.first()
    at = np.flatnonzero(inside(words.doc, n))
    gram, doc = windows(hashes, n)[at], words.doc[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    whole = np.zeros(len(short), np.uint64)
    for j in range(n - 1):
        have = counts[short] > j
        whole[have] = whole[have] * MUL + hashes[first[short[have]] + j]
    gram, doc = np.concatenate([gram, mixed(whole ^ counts[short].astype(np.uint64))]), np.concatenate([doc, short])
    by = np.lexsort((gram, doc))
    gram, doc = gram[by], doc[by]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    gram, doc = gram[new], doc[new]
    return gram, np.searchsorted(doc, np.arange(words.n_docs + 1))


def set_ids(gram: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(gram))])
    return mixed(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64) * MUL).astype(np.int64)


def _band_hashes(gram: np.ndarray, first: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A row for each band, of the sets that begin at `first` (none is empty)."""
    seeds = mixed(np.arange(1, 2 * rows * bands + 1, dtype=np.uint64))
    out = np.zeros((bands, len(first)), np.uint64)
    for i in range(bands if len(first) else 0):
        for j in range(i * rows, (i + 1) * rows):
            out[i] = mixed(out[i] ^ np.minimum.reduceat(gram * (seeds[2 * j] | np.uint64(1)) + seeds[2 * j + 1], first))
    return out


def _signatures(batch: pa.RecordBatch, n: int, rows: int, bands: int) -> pa.RecordBatch:
    gram, first = grams(words_of(batch.column("text")), n)
    size = np.diff(first)
    lists = np.zeros(len(size) + 1, np.int32)
    lists[1:] = np.cumsum(np.where(size > 0, bands, 0))
    values = pa.array(_band_hashes(gram, first[:-1][size > 0], rows, bands).T.ravel().astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("key"), pa.array(set_ids(gram, first)), pa.array(size), pa.ListArray.from_arrays(pa.array(lists), values)], ["doc_id", "key", "node", "n_grams", "bands"]
    )


def _sets(batch: pa.RecordBatch, n: int) -> pa.RecordBatch:
    gram, first = grams(words_of(batch.column("text")), n)
    ids = set_ids(gram, first)
    keep = np.flatnonzero(ids == batch.column("node").to_numpy())
    sets = [gram[first[i] : first[i + 1]].tobytes() for i in keep]
    rest = [batch.column(c).take(pa.array(keep)) for c in ("copies", "bands", "homes")]
    return pa.RecordBatch.from_arrays([pa.array(ids[keep]), *rest, pa.array(sets, pa.binary())], ["node", "copies", "bands", "homes", "grams"])


def linked(sets: list[np.ndarray], threshold: Fraction = THRESHOLD, step: int = 4096, most: int = 1 << 21) -> np.ndarray:
    """Which pairs of sorted sets reach the Jaccard threshold, as a square matrix; exact in whole numbers. Hashes go range by range, about
    `most` of them at a time, so that sets of very long texts need no more memory."""
    size = np.array([len(s) for s in sets])
    common = np.zeros((len(sets), len(sets)), np.float64)
    parts = max(1, -(-int(size.sum()) // most))
    edges = np.array([i * 2**64 // parts for i in range(1, parts)], np.uint64)
    cuts = [[0, *np.searchsorted(s, edges), len(s)] for s in sets]
    for i in range(parts):
        _add_common(common, [s[c[i] : c[i + 1]] for s, c in zip(sets, cuts)], step)
    p, q = threshold.numerator, threshold.denominator
    out = common * (p + q) >= p * (size[:, None] + size[None, :])
    np.fill_diagonal(out, False)
    return out


def _add_common(common: np.ndarray, sets: list[np.ndarray], step: int) -> None:
    """Adds the number of common hashes of each pair."""
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    by = np.argsort(every, kind="stable")
    every, owner = every[by], owner[by]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    gram = np.cumsum(new) - 1
    shared = np.bincount(gram) > 1
    keep = shared[gram]
    owner, gram = owner[keep], (np.cumsum(shared) - 1)[gram[keep]]
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(gram, [lo, lo + step])
        hold = np.zeros((len(sets), step), np.float32)
        hold[owner[a:b], gram[a:b] - lo] = 1
        common += hold @ hold.T


def _cell(rows: list[dict], threshold: Fraction) -> pa.RecordBatch:
    """rows: the nodes of two blocks, or of one block. Pairs across the two count, or those of the one; of a bucket those that share
    no earlier one."""
    rows = list({r["node"]: r for r in rows}.values())
    block = np.array([r["block"] for r in rows])
    node, copies = (np.array([r[c] for r in rows], np.int64) for c in ("node", "copies"))
    link = linked([np.frombuffer(r["grams"], np.uint64) for r in rows], threshold)
    if rows[0]["i"] != rows[0]["j"]:
        link &= block[:, None] != block[None, :]
    if rows[0]["band"] < 0 and link.any():  # in a bucket all share a band
        near = np.zeros_like(link)
        for h in np.array([r["bands"] for r in rows], np.int64).T:
            near |= h[:, None] == h[None, :]
        link &= near
    own = [{h["band"]: h["g"] for h in r["homes"] if h["band"] < rows[0]["band"]} for r in rows]
    for band in range(rows[0]["band"]):
        g = np.array([x.get(band, 0) for x in own])
        link &= ~((g[:, None] == g[None, :]) & (np.array([band in x for x in own])[:, None]))
    hit = np.flatnonzero(link.any(1))
    links = link[hit] @ copies
    # a node's ties inside the cell as a tree: the least node that it reaches step by step
    root = np.arange(len(rows))
    order = np.argsort(node)
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    root = rank.copy()
    while len(hit):
        near = np.where(link[hit], root[None, :], len(rows)).min(1)
        new = root.copy()
        new[hit] = np.minimum(root[hit], near)
        if (new == root).all():
            break
        root = new
    return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links.astype(np.int64)), pa.array(node[order[root[hit]]])], ["node", "links", "least"])


def _cells(batches: Iterator[pa.RecordBatch], threshold: Fraction) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and any(rows[0][c] != r[c] for c in ("g", "band", "i", "j")):
                if len(rows) > 1:
                    yield _cell(rows, threshold)
                rows = []
            rows.append(r)
        release()
    if len(rows) > 1:
        yield _cell(rows, threshold)


def near_duplicates(docs: DataFrame, n: int = N, threshold: Fraction = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (least doc_id of the class), n_links (documents at the threshold or above, copies included): a row for each row of docs."""
    return classed(docs, n, threshold, recall, block).select("doc_id", "class_id", "n_links")


def text_key(text: str = "text"):
    """Tells texts under one doc_id apart."""
    return F.xxhash64(text)


def _homes(groups: DataFrame, in_bucket: DataFrame, bands: int, block: int) -> DataFrame:
    """node, homes: where each node of a component is verified: array of g (the component's root, or a bucket's hash), band (-1 for
    a whole component) and blocks. A component of more blocks than there are bands is verified by bucket if its sets then travel less."""
    total = groups.count()
    sized = groups.groupBy("root").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    large = materialise(sized.where(F.col("blocks") > bands))
    home = lambda g, band: F.struct(F.col(g).alias("g"), F.expr(band).cast("int").alias("band"), F.col("blocks"))
    if large.isEmpty():
        return joined(groups, sized, "root", "m", total).select("node", F.array(home("root", "-1")).alias("homes"))
    own = materialise(joined(groups, large, "root", "m", total).select("node", "root"))
    part = materialise(in_bucket.join(own, "node").select("node", "root", "band", "hash", F.xxhash64("band", "hash").alias("k")))
    # a bucket lies in one component
    buckets = part.groupBy("k").agg(F.count("*").alias("n"), F.min("root").alias("root")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    travels = buckets.groupBy("root").agg(F.sum(F.col("n") * F.col("blocks")).alias("by_bucket"))
    split = materialise(large.join(travels, "root").where(F.col("by_bucket") < F.col("m") * F.col("blocks")).select("root"))
    whole = joined(groups, sized.join(split, "root", "left_anti"), "root", "m", total).select("node", F.array(home("root", "-1")).alias("homes"))
    chosen = buckets.join(split, "root", "left_semi").drop("root")
    met = joined(part.drop("root"), chosen, "k", "n", part.count())
    return whole.unionByName(met.groupBy("node").agg(F.array_sort(F.collect_list(home("hash", "band"))).alias("homes")))


def classed(docs: DataFrame, n: int = N, threshold: Fraction = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """near_duplicates with each row's text_key as key."""
    rows, bands = banding(float(threshold), recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = texts.withColumn("key", text_key())
    signs = materialise(by_chunk(keyed, lambda b: _signatures(b, n, rows, bands), "doc_id long, key long, node long, n_grams long, bands array<long>"))
    known = signs.where("doc_id is not null and n_grams > 0")
    nodes = materialise(known.groupBy("node").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    # candidates: least node of each bucket
    in_bucket = known.select("node", F.posexplode("bands").alias("band", "hash")).distinct()
    buckets = in_bucket.groupBy("band", "hash").agg(F.min("node").alias("least"), F.max("node").alias("_top")).where("least <> _top").drop("_top")
    ties = in_bucket.join(buckets, ["band", "hash"]).select(F.col("node").alias("a"), F.col("least").alias("b"))
    groups = materialise(components(ties))
    chosen = materialise(_homes(groups, in_bucket, bands, block).join(nodes, "node"))
    # full sets of the candidates, once for each block of their component, or of each of their buckets
    mine = texts.join(chosen.select(F.col("doc").alias("doc_id"), "node", "copies", "bands", "homes").hint("shuffle_hash"), "doc_id")
    sets = by_chunk(mine, lambda b: _sets(b, n), "node long, copies long, bands array<long>, homes array<struct<g: long, band: int, blocks: int>>, grams binary").dropDuplicates(["node"])
    placed = sets.select("node", "copies", "bands", "grams", "homes", F.explode("homes").alias("h")).select("node", "copies", "bands", "grams", "homes", "h.*")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cells = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_o"))
    cells = cells.select("g", "band", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "node", "copies", "bands", "homes", "grams")
    small_batches(docs.sparkSession)
    met = cells.repartition("g", "band", "i", "j").sortWithinPartitions("g", "band", "i", "j")
    verified = materialise(met.mapInArrow(lambda it: _cells(it, threshold), "node long, links long, least long"))
    classes = materialise(components(verified.select(F.col("node").alias("a"), F.col("least").alias("b"))))
    named = classes.join(nodes.select("node", "doc"), "node").groupBy("root").agg(F.min("doc").alias("class_id"), F.count("*").alias("m"))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    of_class = joined(classes, named, "root", "m", classes.count()).select("node", "class_id")
    found = nodes.drop("bands").join(of_class, "node", "left").join(links, "node", "left")
    found = found.select("node", "copies", F.coalesce("class_id", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # thousands of copies are one node: joined as a heavy key
    out = joined(known.select("doc_id", "key", "node"), materialise(found), "node", "copies", known.count()).select("doc_id", "key", "class_id", "n_links")
    alone = signs.where("doc_id is null or n_grams = 0").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
gram AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM t WHERE len(ws) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE c * 9 >= 4 * (p.n + q.n)),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT t.doc_id, least(t.doc_id, coalesce((SELECT min(y) FROM reach WHERE x = t.doc_id), t.doc_id)) AS class_id, CAST((SELECT count(*) FROM link WHERE x = t.doc_id) AS BIGINT) AS n_links FROM t
"""
