"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces of documents (a text longer than the largest sequence is cut at its multiples) are placed longest first, each into
the open sequence that it leaves least room in. Where none has room, a sequence is opened. A sequence of c tokens costs
c + overhead + c * c / attention (the last is what attention adds to a step: at `attention` tokens it costs as much as all
the rest), so a long sequence must be well filled to be worth it. Of the permitted lengths that hold the piece, the one of
least cost for each token that it will get is opened: what it will get is found by filling its room from the histogram of
the pieces still to come, largest first, as far as these outlast the room that open sequences have already. In the end
each sequence shrinks to the least permitted length that holds its contents.

Scale: pieces are dealt by hash into groups of about GROUP_ROWS, each packed by one task that sees lengths only; a group
is large enough that its last, half-filled sequences don't matter, and no task grows with the corpus. Repeated rows are
numbered, so that they spread over the groups too.

Defined results: an empty or null text is a row with no sequence (bin and offset null, 0 tokens). Rows with a null or
repeated doc_id are packed like any other. Ties of length go by doc_id, then piece. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, materialise, read

#: Permitted lengths in tokens; what a sequence costs besides its length; the length at which attention doubles the cost.
CAPACITIES, OVERHEAD, ATTENTION = (512, 1024, 2048, 4096), 32, 12_288
GROUP_ROWS = 100_000
_OUT = "doc_id long, piece int, start long, n_tokens long, bin long, capacity int, offset int"


def cost(capacity: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return capacity + overhead + capacity * capacity / attention


class Supply:
    """How many pieces of each size are still to be placed."""

    def __init__(self, sizes: np.ndarray):
        self.count = np.bincount(sizes).tolist() if len(sizes) else [0]
        self.mask = sum(1 << s for s, n in enumerate(self.count) if n)
        self.left = int(sizes.sum())

    def take(self, size: int) -> None:
        self.count[size] -= 1
        self.left -= size
        if not self.count[size]:
            self.mask &= ~(1 << size)

    def fill(self, room: int) -> int:
        """Tokens that fit into a room, the largest pieces first."""
        first = room
        below = self.mask & ((1 << (room + 1)) - 1)
        while below:
            size = below.bit_length() - 1
            room -= size * min(self.count[size], room // size)
            below &= (1 << min(size, room + 1)) - 1
        return first - room


def best_fit(sizes: np.ndarray, capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sizes in descending order: the sequence and offset of each, and the length of each sequence."""
    top, caps = max(capacities), sorted(capacities)
    costs = {c: cost(c, overhead, attention) for c in caps}
    room: list[list[int]] = [[] for _ in range(top + 1)]
    mask = 0  # bit r: some open sequence has room for r more
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled: list[int] = []
    supply, open_room = Supply(sizes), 0
    for i, size in enumerate(sizes.tolist()):
        supply.take(size)
        fit = mask >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            open_room -= r
            if not room[r]:
                mask &= ~(1 << r)
        else:
            free = max(0, supply.left - open_room)
            r = min((c for c in caps if c >= size), key=lambda c: (costs[c] / (size + min(free, supply.fill(c - size))), c))
            b = len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        if r - size:
            room[r - size].append(b)
            mask |= 1 << (r - size)
            open_room += r - size
    small = np.array(caps)[np.searchsorted(caps, filled)] if filled else np.zeros(0, np.int64)
    return bins, offsets, small


def pack(
    docs: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: float = OVERHEAD, attention: float = ATTENTION, length: Column | None = None, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """A row for each piece: doc_id, piece, start (first token of the piece in its document), n_tokens, bin, capacity, offset."""
    top = max(capacities)
    length = F.regexp_count("text", F.lit(WORD)) if length is None else length
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"), F.xxhash64("doc_id", "text").alias("h"))
    # repeated rows as one with a count: sums on the map side, and a number of its own for each copy afterwards
    rows = materialise(sizes.groupBy("doc_id", "n", "h").agg(F.count("*").alias("copies")))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / top)).cast("int")
    total = rows.agg(F.sum(n_pieces * F.col("copies"))).first()[0] or 0
    n_groups = max(1, -(-total // group_rows))
    each = rows.select("doc_id", "n", "h", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    each = each.select("doc_id", "n", "h", "copy", F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece"))
    start = F.col("piece").cast("long") * top
    pieces = each.select("doc_id", F.pmod(F.xxhash64("h", "copy", "piece"), F.lit(n_groups)).alias("_g"), "piece", start.alias("start"), F.least(F.lit(top), F.col("n") - start).alias("n_tokens"))

    def group(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sizes = f["n_tokens"].to_numpy()
        some = int((sizes > 0).sum())
        bins, offsets, caps = best_fit(sizes[:some], capacities, overhead, attention)
        none = [None] * (len(f) - some)
        f["bin"] = pd.array([*(bins + (int(f["_g"].iloc[0]) << 32)).tolist(), *none], "Int64")
        f["capacity"] = pd.array([*caps[bins].tolist(), *none], "Int32")
        f["offset"] = pd.array([*offsets.tolist(), *none], "Int32")
        return f[["doc_id", "piece", "start", "n_tokens", "bin", "capacity", "offset"]]

    return pieces.groupBy("_g").applyInPandas(group, _OUT)


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
