"""Language identification by a bidirectional gated recurrent network over bytes.

The network runs over the whole text in windows of WINDOW bytes, blanks and all, each with CONTEXT bytes of the text on
either side, in which its states settle: memory is bounded however long a text is, and no position is labelled without what
surrounds it. Bounds fall between code points. Every byte position gets language probabilities from the states of both
directions; a document's probabilities pool those of all its positions (their geometric mean, normalised). Gates and states are of
the piecewise linear kind. The network is trained in numpy by backpropagation through time on stretches of a bounded sample
of documents of every language.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text where no document teaches a
language. Null and repeated doc_ids are rows like any other, very long texts are run whole. Extra columns stay, but those
named lang_pred or score (in any case of letters) are replaced. Ties go to the first language in order. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import by_chunk, held_out, materialise, others, read, schema_with
from .words import texts_of, words_of

#: The sample: FIT_DOCS texts shared out among all languages, but LEAST_DOCS at least of each, if it has them; of a longer text
#: a stretch of FIT_CHARS.
FIT_DOCS, LEAST_DOCS, FIT_CHARS = 1000, 20, 2_000
WINDOW, CONTEXT, HIDDEN = 512, 32, 16
#: Languages whose counts are broadcast at most.
FEW = 10_000
#: Bytes of states and probabilities that run together.
_BLOCK = 24 << 20
#: Lengths of training stretches.
_LENGTHS = np.array([1, 2, 4, 8, 16, 32, 64])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass
class Network:
    """Two directions of: table (byte x 3 gates), turn (state x 3 gates), shift; then out and bias. Gates: reset, update, new."""

    languages: list[str]
    table: list[np.ndarray]
    turn: list[np.ndarray]
    shift: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.table, *self.turn, *self.shift, self.out, self.bias]


def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
    r = np.random.default_rng(seed)
    new = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    tables = [(r.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32) for _ in range(2)]
    return Network(languages, tables, [new(hidden, 3 * hidden) for _ in range(2)], [np.zeros(3 * hidden, np.float32) for _ in range(2)], new(2 * hidden, len(languages)), np.zeros(len(languages), np.float32))


def _gates(x: np.ndarray) -> np.ndarray:
    """The piecewise linear sigmoid, in place."""
    x *= 0.2
    x += 0.5
    return np.clip(x, 0, 1, out=x)


def _step(net: Network, side: int, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next states, and what the gradients need: gates, new, and the states' share of new."""
    size = h.shape[1]
    a = net.table[side][byte] + net.shift[side]
    u = h @ net.turn[side]
    gates = _gates(a[:, : 2 * size] + u[:, : 2 * size])
    r, z = gates[:, :size], gates[:, size:]
    un = u[:, 2 * size :]
    new = r * un
    new += a[:, 2 * size :]
    np.clip(new, -1, 1, out=new)
    out = h - new
    out *= z
    out += new
    return out, r, z, new, un


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(-1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(-1, keepdims=True))
    return logits


def gradients(net: Network, x: np.ndarray, y: np.ndarray, sizes: np.ndarray | None = None) -> tuple[float, list[np.ndarray]]:
    """Mean over sequences (rows) of the mean loss of their positions, and its gradients, in the order of net.arrays(). A sequence's
    positions from its size on are padding: states are zero there, and nothing is learnt from them."""
    n, length = x.shape
    size = net.turn[0].shape[0]
    sizes = np.full(n, length) if sizes is None else sizes
    real = (np.arange(length)[:, None] < sizes).astype(np.float32)
    both, tapes = np.empty((length, n, 2 * size), np.float32), []
    for side in (0, 1):
        h, tape = np.zeros((n, size), np.float32), []
        for t in range(length) if side == 0 else range(length - 1, -1, -1):
            out, *kept = _step(net, side, x[:, t], h)
            tape.append((t, h, *kept))
            out *= real[t][:, None]
            both[t, :, side * size : (side + 1) * size] = h = out
        tapes.append(tape)
    logs = _log_softmax(both @ net.out + net.bias)
    p = np.exp(logs)
    share = real / (sizes * np.float32(n))
    loss = -float((logs[:, np.arange(n), y] * share).sum())
    p[:, np.arange(n), y] -= 1
    p *= share[:, :, None]
    d_out, d_bias = both.reshape(-1, 2 * size).T @ p.reshape(-1, p.shape[2]), p.sum((0, 1))
    back = p @ net.out.T
    grads: list[list[np.ndarray]] = [[], [], []]
    for side in (0, 1):
        d_turn, d_shift = np.zeros_like(net.turn[side]), np.zeros_like(net.shift[side])
        dh, by_byte, of = np.zeros((n, size), np.float32), [], []
        for t, h, r, z, new, un in reversed(tapes[side]):
            dh = (dh + back[t][:, side * size : (side + 1) * size]) * real[t][:, None]
            d_new = dh * (1 - z) * ((new > -1) & (new < 1))
            d_z = dh * (h - new) * (0.2 * ((z > 0) & (z < 1)))
            d_r = d_new * un * (0.2 * ((r > 0) & (r < 1)))
            d_u = np.concatenate([d_r, d_z, d_new * r], 1)
            d_turn += h.T @ d_u
            by_byte.append(np.concatenate([d_r, d_z, d_new], 1))
            d_shift += by_byte[-1].sum(0)
            of.append(x[:, t])
            dh = dh * z + d_u @ net.turn[side].T
        rows, at = np.concatenate(by_byte), np.concatenate(of)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        d_table = np.zeros_like(net.table[side])
        d_table[at[order][first]] = np.add.reduceat(rows[order], first)
        for where, g in zip(grads, (d_table, d_turn, d_shift)):
            where.append(g)
    return loss, [*grads[0], *grads[1], *grads[2], d_out, d_bias]


def train(texts: list[str], langs: list[str], steps: int = 220, batch: int = 256, seed: int = 2) -> Network | None:
    languages = sorted(set(langs))
    if not languages:
        return None
    net = fresh(languages)
    buf, offsets = texts_of(pa.array(texts, pa.string()))
    size = np.diff(offsets)
    at = np.array([languages.index(x) for x in langs])
    full = np.flatnonzero(size)
    if not len(full):
        return net
    by_language = [full[at[full] == k] for k in range(len(languages))]
    some = [k for k, rows in enumerate(by_language) if len(rows)]
    r = np.random.default_rng(seed)
    first, second = ([np.zeros_like(a) for a in net.arrays()] for _ in range(2))
    for step in range(1, steps + 1):
        # every language has the same share; stretches have the step's length, now and then a short one, or that of their whole text
        y = np.array(some)[r.integers(0, len(some), batch)]
        doc = np.array([by_language[k][int(u * len(by_language[k]))] for k, u in zip(y, r.random(batch))])
        length = int(_LENGTHS[-1]) if step % 4 else int(r.choice(_LENGTHS[3:]))
        least = np.minimum(size[doc], length)
        start = offsets[doc] + (r.random(len(doc)) * (size[doc] - least + 1)).astype(np.int64)
        spot = start[:, None] + np.arange(least.max())
        _, grads = gradients(net, buf[np.minimum(spot, len(buf) - 1)], y, least)
        rate = 0.02 * (1 - 0.9 * step / steps)
        for a, g, m, v in zip(net.arrays(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _snapped(buf: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Bounds moved on to where a code point begins, or the text ends."""
    at = at.copy()
    for _ in range(3):
        inner = at < stop
        inner[inner] = (buf[at[inner]] & 0xC0) == 0x80
        at += inner
    return at


def windows_of(buf: np.ndarray, offsets: np.ndarray, window: int = WINDOW, context: int = CONTEXT) -> tuple[np.ndarray, ...]:
    """Of each window: text, first byte to run, first and last byte (exclusive) to label, last byte to run (exclusive)."""
    parts = -(-np.diff(offsets) // window)
    doc = np.repeat(np.arange(len(parts)), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, stop = offsets[doc], offsets[doc + 1]
    a = _snapped(buf, begin + nth * window, stop)
    b = _snapped(buf, np.minimum(begin + (nth + 1) * window, stop), stop)
    return doc, _snapped(buf, np.maximum(begin, a - context), stop), a, b, _snapped(buf, np.minimum(stop, b + context), stop)


class Runner:
    """A network ready to run: a table and a matrix for each gate, so that each gate of all windows is one stretch of memory;
    the gates' slope and shifts are in them already."""

    def __init__(self, net: Network):
        self.net, self.hidden = net, net.turn[0].shape[0]
        self.sides = []
        for table, turn, shift in zip(net.table, net.turn, net.shift):
            parts = [(x + s, w) for x, w, s in zip(*(np.split(v, 3, -1) for v in (table, turn, shift)))]
            slope = [(0.2 * x + 0.5, 0.2 * w) for x, w in parts[:2]] + parts[2:]
            self.sides.append([(np.ascontiguousarray(x), np.ascontiguousarray(w)) for x, w in slope])
        self.up, self.down = (np.ascontiguousarray(x.T) for x in (net.out[: self.hidden], net.out[self.hidden :]))
        self.bias = net.bias[:, None].copy()

    def step(self, side: int, byte: np.ndarray, h: np.ndarray) -> np.ndarray:
        (table_r, turn_r), (table_z, turn_z), (table, turn) = self.sides[side]
        new = h @ turn
        r = h @ turn_r
        r += table_r.take(byte, 0, mode="clip")
        new *= np.clip(r, 0, 1, out=r)
        new += table.take(byte, 0, mode="clip")
        np.clip(new, -1, 1, out=new)
        z = h @ turn_z
        z += table_z.take(byte, 0, mode="clip")
        np.clip(z, 0, 1, out=z)
        np.subtract(h, new, out=r)
        r *= z
        r += new
        return r

    def run(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray, each: Callable[[int, int, np.ndarray], None]) -> None:
        """The network over windows, the longest first. each(t, n, logs): log probabilities (language x window) at byte t of the
        first n windows."""
        size = stop - start
        alive = np.searchsorted(-size, -np.arange(size.max(initial=0)), "left")
        states, h = [], np.zeros((len(start), self.hidden), np.float32)
        for t, n in enumerate(alive):
            h = self.step(0, buf[start[:n] + t], h[:n])
            states.append(h)
        h = np.zeros((0, self.hidden), np.float32)
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            if n > len(h):  # windows that end here
                h = np.concatenate([h, np.zeros((n - len(h), self.hidden), np.float32)])
            h = self.step(1, buf[start[:n] + t], h)
            logits = self.up @ states.pop().T
            logits += self.down @ h.T
            logits += self.bias
            logits -= logits.max(0)
            logits -= np.log(np.exp(logits).sum(0))
            each(t, n, logits)


def _blocks(net: Network, buf: np.ndarray, offsets: np.ndarray):
    """Windows in blocks of bounded memory, the longest first in each."""
    found = windows_of(buf, offsets)
    order = np.argsort(found[1] - found[4], kind="stable")
    rows = max(64, _BLOCK // (4 * (WINDOW + 2 * CONTEXT) * net.turn[0].shape[0] + 16 * len(net.languages)))
    for lo in range(0, len(order), rows):
        yield tuple(x[order[lo : lo + rows]] for x in found)


def pooled(column: pa.Array, net: Network | Runner) -> np.ndarray:
    """Sum of the position log probabilities of each text (text x language)."""
    runner = net if isinstance(net, Runner) else Runner(net)
    net = runner.net
    buf, offsets = texts_of(column)
    logs = np.zeros((len(offsets) - 1, len(net.languages)))
    for doc, start, a, b, stop in _blocks(net, buf, offsets):
        sums, lo, hi = np.zeros((len(net.languages), len(doc)), np.float32), a - start, b - start
        inner = lo.max(), hi.min()

        def add(t: int, n: int, found: np.ndarray) -> None:
            if not inner[0] <= t < inner[1]:
                found *= (lo[:n] <= t) & (t < hi[:n])
            sums[:, :n] += found

        runner.run(buf, start, stop, add)
        for k in range(logs.shape[1]):
            logs[:, k] += np.bincount(doc, sums[k], len(logs))
    return logs


def has_letter(column: pa.Array) -> np.ndarray:
    words = words_of(column)
    sums = np.concatenate([[0], np.cumsum(_LETTER[words.buf], dtype=np.int64)])
    out = sums[words.offsets[1:]] > sums[words.offsets[:-1]]
    for d in np.flatnonzero(~out):
        out[d] = any(c.isalpha() for c in column[int(d)].as_py() or "")
    return out


def positions(text: str, net: Network) -> list[tuple[int, int, str]]:
    """Stretches of bytes of the text with the likeliest language of each position."""
    buf, offsets = texts_of(pa.array([text], pa.string()))
    best = np.zeros(len(buf), np.int64)
    for _, start, a, b, stop in _blocks(net, buf, offsets):

        def label(t: int, n: int, found: np.ndarray) -> None:
            own = np.flatnonzero((a[:n] <= start[:n] + t) & (start[:n] + t < b[:n]))
            best[start[own] + t] = found[:, own].argmax(0)

        Runner(net).run(buf, start, stop, label)
    cut = np.flatnonzero(np.diff(best, prepend=-1))
    return [(int(i), int(j), net.languages[best[i]]) for i, j in zip(cut, np.append(cut[1:], len(best)))]


def sample_of(docs: DataFrame, fit_docs: int = FIT_DOCS, least: int = LEAST_DOCS, fit_chars: int = FIT_CHARS) -> tuple[list[str], list[str]]:
    """Texts and languages that teach: of every language the texts of the smallest hashes, copies once, long ones by a stretch.
    max(fit_docs, least x languages) rows at most reach the driver."""
    known = docs.where("lang is not null and text <> ''").select("lang", "text", F.xxhash64("text", F.lit(9)).alias("h"))
    # distinct texts, not rows: thousands of copies of one text leave its language's other texts their share
    counts = materialise(known.groupBy("lang").agg(F.approx_count_distinct("h").alias("count"), F.min("h").alias("least")))
    n_languages = counts.count()
    each = max(least, fit_docs // max(1, n_languages))
    if n_languages <= FEW:  # else by a shuffle
        counts = F.broadcast(counts)
    share = F.pmod("h", F.lit(1 << 30)) / F.lit(1 << 30) * F.col("count") <= 2 * each
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - fit_chars + 1)).cast("int")
    rows = known.join(counts, "lang").where(share | (F.col("h") == F.col("least"))).select("lang", "h", F.col("text").substr(at + 1, F.lit(fit_chars)).alias("text")).dropDuplicates(["lang", "h"])
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    found = rows.withColumn("n", nth).where(F.col("n") <= each).select("lang", "text").collect()
    found.sort(key=lambda r: (r.lang, r.text))
    return [r.text for r in found], [r.lang for r in found]


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with lang_pred and score; one pass, no shuffle."""
    rows = others(docs, "lang_pred", "score")
    runner = None if net is None else Runner(net)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        pred, score = np.full(len(column), "und", object), np.zeros(len(column))
        if net is not None:
            logs = pooled(column, runner)
            mean = logs / np.maximum(np.diff(texts_of(column)[1]), 1)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            some = has_letter(column)
            pred[some] = np.array(net.languages, object)[logs.argmax(1)[some]]
            score[some] = p.max(1)[some].round(6)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return by_chunk(rows, each, schema_with(rows, "lang_pred string, score double"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    net = train(*sample_of(docs.where(~held_out("doc_id", 4, 2))))
    out = identify(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
