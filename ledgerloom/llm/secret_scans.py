"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags words as begin, inside or outside.

The field is trained in numpy on a bounded sample of documents whose words the patterns have marked. Those labels alone
would teach it the patterns again, so part of the time it learns without what the patterns go by: in copies of the marked
texts each secret is disguised (other letters, a made-up prefix, another name and sign before it or none), and in copies of
the features the neighbouring words and signs are hidden. It is left with shape (length, kinds of characters, how often they change,
vowels), neighbouring words and features of the whole text. Words that look like a secret but bear no mark may be one that the patterns miss,
so their surroundings teach nothing; plain words made to look odd (addresses, dates, numbers, names in code) teach what is
outside. Its decoding is exact Viterbi: a
word whose score for "outside" beats the others by more than any change of its neighbours could make up is outside in the
best path, so it cuts the chain; only the stretches between such words are run through step by step. The spans found are added
to the patterns' own; one that overlaps a pattern's span is not added.

Patterns, leftmost and apart for each kind: `assign` (a name such as password, a sign, then 12 or more characters),
`access` (AKIA and capitals or digits, 18 or more), `hex` (16 or more). Offsets are code points, the end exclusive.

Defined results: a null or empty text has no span; without any marked document among all rows the field finds nothing. Very long
texts are scanned whole. Rows with null or repeated doc_id are scanned like any other; extra columns stay, but those named like a result (in any
case of letters) are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from random import Random
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_chunk, in_share, others, read, schema_with
from .words import Words, range_hashes, words_of

#: The sample: so many different texts with and without a marked word, of at most so many characters each, the smallest
#: hashes first, among all rows.
FIT_DOCS, FIT_CHARS = 600, 20_000
#: Disguised copies of a marked text.
COPIES = 4
#: Words of a training stretch; how many of each text: with a marked word, with an odd one, others. Stretches of a block.
WIDTH, MOST, _STRETCHES = 24, (6, 3, 1), 4096
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Whether a text has a span, for Spark's regular expressions.
_HINT = r"""AKIA[A-Z0-9]{14}|[0-9a-f]{16}|(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}"""
_WORD_END = r"[^\x20\x09-\x0D]*"
O, B, I = 0, 1, 2
_NEVER = -1e4

Span = tuple[int, int, int]


def pattern_spans(text: str) -> list[Span]:
    """start, end, kind of every span of the fixed patterns."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), m.end(), 2) for m in HEX.finditer(text) if m.end() - m.start() >= 16])


def _runs(flag: np.ndarray, offsets: np.ndarray, least: int) -> np.ndarray:
    """Starts of runs of at least so many set flags; a text's bounds end a run."""
    edge = np.zeros(len(flag) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(flag & (edge[:-1] | ~np.concatenate([[False], flag])[:-1]))
    end = np.flatnonzero(flag & (edge[1:] | ~np.append(flag, False)[1:])) + 1
    return start[end - start >= least]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_HEX, _LOWER, _UPPER, _DIGIT = _table(b"0123456789abcdef"), _table(bytes(range(97, 123))), _table(bytes(range(65, 91))), _table(b"0123456789")
_SIGN, _QUOTE = _table(b"=:"), _table(b"\"'`")
_SYMBOL = _table(bytes(range(33, 127))) & ~_LOWER & ~_UPPER & ~_DIGIT & ~_table(b".,;:!?'\"()=")
_SCAN = _table(b"=:")
_VOWEL, _JOIN, _PATH, _DOT = _table(b"aeiouyAEIOUY"), _table(b"_-"), _table(b"/+\\"), _table(b".@")
#: Kind of each byte: runs of one kind are what a word's turns lie between.
_KIND = np.where(_LOWER, 1, np.where(_UPPER, 2, np.where(_DIGIT, 3, np.where(np.arange(256) > 127, 1, 4)))).astype(np.int8)
NEIGHBOURS = 1 << 10
_SIZES = np.array([2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 40, 64, 128])
#: Bounds of each feature's block in the weights.
_BLOCKS = np.cumsum([0, 16, 64, 1024, 8, 2, 8, 8, NEIGHBOURS, NEIGHBOURS, NEIGHBOURS, 64, 256, 512, 256, 128])
#: Features that speak of signs and neighbours: the number of each, and what it is when hidden.
_SIGNS, _NEAR = 5, (7, 8, 9)


def features(words: Words) -> np.ndarray:
    """An index of each of the field's features, for each word."""
    buf, start, end = words.buf, words.start, words.end

    def total(flag: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(flag, out=sums[1:])
        return sums[end] - sums[start]

    count = lambda table: total(table[buf])
    lower, upper, digit, symbol, sign, quote, hexes = (count(t) for t in (_LOWER, _UPPER, _DIGIT, _SYMBOL, _SIGN, _QUOTE, _HEX))
    vowel, join, path, dot = (count(t) for t in (_VOWEL, _JOIN, _PATH, _DOT))
    kind = _KIND[buf]
    turn = np.zeros(len(buf), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turns = total(turn) - turn[np.minimum(start, max(0, len(buf) - 1))]  # not the one at the word's own start
    size = end - start
    letters = lower + upper
    wide = size - letters - digit - symbol - sign - quote > np.maximum(2, size // 4)
    bucket = np.searchsorted(_SIZES, size)
    kinds = (lower > 0) | (upper > 1) << 1 | (digit > 0) << 2 | (symbol > 0) << 3 | (sign > 0) << 4 | wide << 5
    kinds = kinds.astype(np.int64)
    share = (digit * 7) // np.maximum(size, 1)
    pure = (hexes == size - sign - quote) & (digit > 0) & (lower > 0)
    fold = buf.copy()
    fold[_UPPER[buf]] |= 32
    name = (range_hashes(fold, start, end) % np.uint64(NEIGHBOURS - 1)).astype(np.int64)
    odd = (digit > 0) & (letters > 0)
    n_words = np.maximum(words.counts(), 1)
    of_doc = lambda flag: np.bincount(words.doc, flag, words.n_docs)
    page = np.minimum(3, of_doc(odd) * 200 // n_words) + 4 * np.minimum(3, of_doc(sign > 0) * 100 // n_words)
    page = (page.astype(np.int64) + 16 * np.searchsorted([50, 500, 5000], n_words))[words.doc]
    first = np.ones(len(start), bool)
    first[1:] = words.doc[1:] != words.doc[:-1]
    last = np.append(first[1:], True)[: len(start)]
    none = NEIGHBOURS - 1
    before = np.where(first, none, np.roll(name, 1))
    after = np.where(last, none, np.roll(name, -1))
    second = np.where(first | np.roll(first, 1), none, np.roll(name, 2))
    signs = np.minimum(sign, 1) + 2 * (np.where(first, 0, np.roll(np.minimum(sign, 1), 1))) + 4 * np.where(last, 0, np.roll(np.minimum(sign, 1), -1))
    quotes = np.minimum(quote, 1) + 2 * np.where(first, 0, np.roll(pure, 1)) + 4 * np.where(last, 0, np.roll(odd, -1))
    often = np.minimum(7, turns * 12 // np.maximum(size, 1))
    spoken = np.where(letters > 0, 1 + vowel * 6 // np.maximum(letters, 1), 0)
    joints = np.minimum(join, 3) * 16 + np.minimum(path, 3) * 4 + np.minimum(dot, 3)
    parts = (
        bucket, kinds, kinds * 16 + bucket, share, pure, signs, quotes, before, after, second, page,
        np.minimum(turns, 15) * 16 + bucket, often * 64 + kinds, np.minimum(joints, 63) * 4 + np.minimum(often // 2, 3), spoken * 16 + bucket,
    )
    return np.column_stack([p.astype(np.int64) + b for p, b in zip(parts, _BLOCKS)]) if len(start) else np.zeros((0, len(parts)), np.int64)


def hidden(at: np.ndarray) -> np.ndarray:
    """Features without the signs and neighbours."""
    out = at.copy()
    out[:, _SIGNS] = _BLOCKS[_SIGNS]
    for j in _NEAR:
        out[:, j] = _BLOCKS[j] + NEIGHBOURS - 1
    return out


@dataclass
class Field:
    weights: np.ndarray  # feature x tag
    steps: np.ndarray  # tag x next tag

    def scores(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 3), np.float32)
        for j in range(at.shape[1]):
            out += self.weights[at[:, j]]
        return out


def best_path(e: np.ndarray, steps: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """Viterbi tags of one sequence of scores; a sequence does not begin inside."""
    best = e[0] + (first if first is not None else np.array([0, 0, _NEVER]))
    back = np.zeros((len(e), 3), np.int8)
    for t in range(1, len(e)):
        x = best[:, None] + steps
        back[t] = x.argmax(0)
        best = x.max(0) + e[t]
    tags = np.zeros(len(e), np.int8)
    tags[-1] = best.argmax()
    for t in range(len(e) - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags


def decode(e: np.ndarray, doc: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Viterbi tags of the words of several texts at once.

    Take any path that tags word t as begin or inside. Tag it outside instead, and where the next word was inside, let it
    begin there. If every such change raises the score, no best path tags t so: t is outside, and the chain falls apart.
    """
    n = len(e)
    tags = np.zeros(n, np.int8)
    if not n:
        return tags
    s = steps
    last = np.append(doc[1:] != doc[:-1], True)
    shift = np.append(e[1:, B] - e[1:, I], 0.0)
    sure = np.ones(n, bool)
    for x in (B, I):
        came = [O, B, I] if x == B else [B, I]
        gap = e[:, O] - e[:, x] + min(0.0, *(s[a, O] - s[a, x] for a in came))
        plain = min(s[O, b] - s[x, b] for b in (O, B))
        moved = s[O, B] - s[x, I] + min(0.0, *(s[B, c] - s[I, c] for c in (O, B, I))) + shift
        sure &= gap + np.minimum(np.minimum(plain, 0.0), np.where(last, 0.0, moved)) > 1e-4
    doubt = ~sure
    edge = np.flatnonzero(doubt & np.concatenate([[True], ~doubt[:-1] | (doc[1:] != doc[:-1])]))
    stop = np.flatnonzero(doubt & np.append(~doubt[1:] | (doc[1:] != doc[:-1]), True)) + 1
    head = np.concatenate([[True], doc[1:] != doc[:-1]])
    for a, b in zip(edge, stop):
        own, first = e[a:b].astype(np.float64), None if head[a] else s[O].copy()
        if not last[b - 1]:
            own[-1] += s[:, O]
        tags[a:b] = best_path(own, s, first)
    return tags


def stretches(at: np.ndarray, tags: np.ndarray, seq: np.ndarray, doubt: np.ndarray, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, tags and real words of training stretches of WIDTH words: of each text at most so many with a marked word, with an
    odd one, and others as MOST says; none with a word in doubt."""
    new = np.concatenate([[True], seq[1:] != seq[:-1]])
    pos = np.arange(len(seq)) - np.maximum.accumulate(np.where(new, np.arange(len(seq)), 0))
    head = np.flatnonzero(pos % WIDTH == 0)
    size = np.diff(np.append(head, len(seq)))
    any_ = lambda flag: np.logical_or.reduceat(flag, head)
    kind = np.where(any_(tags > 0), 0, np.where(any_(at[:, 3] > _BLOCKS[3]), 1, 2))
    group = seq[head] * 3 + kind
    order = np.lexsort((r.random(len(head)), group))
    order = order[~any_(doubt)[order]]
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    pick = np.sort(order[nth < np.array(MOST)[kind[order]]])
    where = np.minimum(head[pick][:, None] + np.arange(WIDTH), len(seq) - 1)
    real = np.arange(WIDTH) < size[pick][:, None]
    y = np.where(real, tags[where], O).astype(np.int8)
    y[:, 0] = np.where(y[:, 0] == I, B, y[:, 0])
    return at[where].astype(np.int32), y, real


def fit(x: np.ndarray, y: np.ndarray, real: np.ndarray, rounds: int = 45) -> Field:
    """Maximum likelihood by Adagrad over stretches, in blocks of bounded memory."""
    field = Field(np.zeros((_BLOCKS[-1], 3), np.float32), np.array([[0, 0, _NEVER], [0, 0, 0], [0, 0, 0]], np.float64))
    if not (y > 0).any():
        field.weights[: _BLOCKS[1], O] = 50
        return field
    allowed = field.steps > _NEVER / 2
    pairs = np.zeros((3, 3))
    both = real[:, 1:]
    np.add.at(pairs, (y[:, :-1][both], y[:, 1:][both]), 1)
    sums = [np.full((_BLOCKS[-1], 3), 1e-2), np.full((3, 3), 1e-2)]
    for _ in range(rounds):
        grad, two = -1e-3 * field.weights, np.zeros((3, 3))
        for lo in range(0, len(x), _STRETCHES):
            rows = slice(lo, lo + _STRETCHES)
            off, turns = _left(field, x[rows], y[rows], real[rows])
            two += turns
            for k in range(3):
                w = np.ascontiguousarray(off[:, :, k]).ravel()
                for j in range(x.shape[2]):
                    grad[:, k] += np.bincount(x[rows, :, j].ravel(), w, _BLOCKS[-1])
        turn = (pairs - two) * allowed - 1e-3 * field.steps * allowed
        sums[0] += grad**2
        sums[1] += turn**2
        field.weights += (0.5 * grad / np.sqrt(sums[0])).astype(np.float32)
        field.steps += 0.5 * turn / np.sqrt(sums[1])
    return field


def _left(field: Field, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the tags have beyond what the field expects (stretch x word x tag), and the pairs that it expects, by forward and backward."""
    n, width = y.shape
    e = np.zeros((n, width, 3))
    for j in range(x.shape[2]):
        e += field.weights[x[:, :, j]]
    e -= e.max(2, keepdims=True)
    step = np.exp(field.steps)
    up, down, scale = np.zeros_like(e), np.ones_like(e), np.ones((n, width))
    em = np.where(real[:, :, None], np.exp(e), 1.0)
    for t in range(width):
        now = em[:, t] * (np.array([1.0, 1.0, 0.0]) if not t else up[:, t - 1] @ step)
        if t:
            now = np.where(real[:, t, None], now, up[:, t - 1])
        scale[:, t] = now.sum(1)
        up[:, t] = now / scale[:, t, None]
    for t in range(width - 2, -1, -1):
        back = (em[:, t + 1] * down[:, t + 1]) @ step.T / scale[:, t + 1, None]
        down[:, t] = np.where(real[:, t + 1, None], back, down[:, t + 1])
    seen = up * down
    seen /= seen.sum(2, keepdims=True)
    np.put_along_axis(e := -seen, y[:, :, None].astype(np.int64), 1.0 + np.take_along_axis(e, y[:, :, None].astype(np.int64), 2), 2)
    both = real[:, 1:, None]
    two = np.einsum("nta,ntb->ab", up[:, :-1], np.where(both, em[:, 1:] * down[:, 1:] / scale[:, 1:, None], 0)) * step
    return e * real[:, :, None], two


def _whole_words(text: str, before: bool, after: bool) -> str:
    """A stretch without the words that its bounds cut, unless they hold all that it has or all its spans."""
    a = re.match(_WORD_END, text).end() if before else 0
    b = len(text) - re.match(_WORD_END, text[::-1]).end() if after else len(text)
    return text[a:b] if a < b and bool(pattern_spans(text[a:b])) == bool(pattern_spans(text)) else text


def sample_of(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_chars: int = FIT_CHARS) -> list[str]:
    """At most 2 * fit_docs different texts, of at most fit_chars characters; of a longer one a stretch, round its first mark if it has any."""
    texts = docs.where("text is not null").select("text", F.xxhash64("text", F.lit(7)).alias("h"))
    marked = F.col("text").rlike(_HINT)
    with_mark, without = texts.agg(*[F.approx_count_distinct(F.when(w, F.col("h"))) for w in (marked, ~marked)]).first()
    size = F.length("text")
    first = F.greatest(F.lit(0), F.least(size - fit_chars, F.length(F.split("text", _HINT, 2)[0]) - fit_chars // 2))
    any_ = F.when(size > fit_chars, F.pmod("h", size - fit_chars + 1)).otherwise(0).cast("int")
    picked = []
    for which, total, lo in ((marked, with_mark, first), (~marked, without, any_)):
        # the hash first: only few texts are looked at again
        part = texts.where(in_share(total, 2 * fit_docs, F.lit(3), "h")).where(which).withColumn("lo", lo)
        part = part.select("h", F.col("text").substr(F.col("lo") + 1, F.lit(fit_chars)).alias("text"), (F.col("lo") > 0).alias("before"), (F.col("lo") + fit_chars < size).alias("after"))
        picked += part.dropDuplicates(["h"]).orderBy("h").limit(fit_docs).collect()
    return [_whole_words(r.text, r.before, r.after) for r in sorted(picked, key=lambda r: r.h)]


def _bounds(words: Words, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word's bounds in its own text. points: code points before each byte of the chunk."""
    zero = points[words.offsets[words.doc]]
    return points[words.start] - zero, points[words.end] - zero


def _points(buf: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])


_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789" + ascii_letters, "0123456789" + ascii_letters, "0123456789-_" + ascii_letters)
_LETTERS = re.compile(r"[^\W\d_]{3,12}")


def _made_up(r: Random) -> str:
    """A random string of the kind that keys are."""
    letters = r.choice(_ALPHABETS)
    part = lambda n: "".join(r.choice(letters) for _ in range(n - 1)) + r.choice("0123456789")
    body = ".".join(part(r.randint(16, 90)) for _ in range(3)) if r.random() < 0.12 else part(r.choice((12, 14, 16, 16, 18, 20, 20, 24, 32, 36, 40, 48)))
    for _ in range(r.choice((0, 0, 1, 2))):
        body = "".join(r.choice(ascii_letters) for _ in range(r.randint(2, 5))) + r.choice("_-") + body
    return body


def disguised(text: str, spans: list[Span], r: Random) -> tuple[str, list[Span]]:
    """The text with a made-up secret in place of each marked one, and where these are."""
    names = _LETTERS.findall(text[:2000]) or ["name"]
    out, found, at, size = [], [], 0, 0

    def add(x: str) -> None:
        nonlocal size
        out.append(x)
        size += len(x)

    for a, b, _ in spans:
        if a < at:
            at = max(at, b)
            continue
        add(text[at:a])
        key, form = _made_up(r), r.random()
        quote = r.choice(("", "", '"', "'"))
        if form > 0.92:  # in an address
            head = f"{r.choice(names).lower()}://{r.choice(names).lower()}:"
            found.append((size, size + len(head) + len(key), 3))
            add(f"{head}{key}@{r.choice(names).lower()}.{r.choice(names).lower()}")
            at = b
            continue
        if form > 0.4:
            add(r.choice(names) + (r.choice(("=", ": ", " = ", ":", " := ")) if form < 0.78 else " "))
        begin = size + len(quote)
        add(quote + key + quote + r.choice(("", "", "", ",", ".", ";")))
        found.append((begin, begin + len(key), 3))
        at = b
    add(text[at:])
    return "".join(out), found


def littered(text: str, r: Random, n: int = 8) -> str:
    """Some plain words of the text with odd ones among them that are no secrets."""
    words = _LETTERS.findall(text[:2000])[:80]
    if not words:
        return ""
    w = lambda: r.choice(words)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    forms = (
        lambda: f"https://{r.choice(('www.', ''))}{w().lower()}{r.choice(('', '-' + w().lower()))}.{r.choice(('com', 'org', 'de', 'net'))}/{w()}{r.choice(('/', '_', '-'))}{w()}{r.choice(('', '?id=' + d(4), '.html', '/' + d(5)))}",
        lambda: f"http://{w().lower()}.{w().lower()}.{r.choice(('com', 'fr', 'es'))}{r.choice(('', '/', '/' + w().lower()))}",
        lambda: f"{w().lower()}{r.choice(('.', '_', ''))}{w().lower()}{r.choice(('', d(2), d(4)))}@{w().lower()}.{r.choice(('com', 'org', 'example'))}",
        lambda: f"{r.choice(('19', '20'))}{d(2)}-0{d(1)}-1{d(1)}{r.choice(('', 'T1' + d(1) + ':2' + d(1) + ':3' + d(1) + 'Z'))}",
        lambda: ".".join(d(r.randint(1, 3)) for _ in range(4)) + r.choice(("", ":" + d(4))),
        lambda: r.choice(("+", "(", "")) + d(2) + r.choice((")", "-", "")) + d(3) + r.choice(("-", ".", "")) + d(r.randint(3, 6)),
        lambda: r.choice(("$", "€", "")) + d(r.randint(1, 3)) + "," + d(3) + r.choice(("", "." + d(2), "," + d(3))),
        lambda: "".join(x.title() for x in (w(), w(), w())) + r.choice(("", d(1))),
        lambda: "_".join(x.lower() for x in (w(), w(), w())) + r.choice(("", d(2), "_" + d(1))),
        lambda: "-".join((w(), w(), w())) + r.choice(("", "-" + d(2))),
        lambda: f"/{w().lower()}/{w().lower()}{r.choice(('', d(1), d(1) + '.' + d(2)))}/{w().lower()}.{r.choice(('py', 'txt', 'so.' + d(1), 'c'))}",
        lambda: f"{r.choice(('v', ''))}{d(1)}.{d(2)}.{d(1)}{r.choice(('', '-' + w().lower()[:4] + d(1)))}",
        lambda: w().upper() + "-" + d(r.randint(1, 4)),
        lambda: w() + w().lower() + w().lower() + w().lower(),
        lambda: (w() + w() + r.choice(("", w()))).upper() + r.choice(("", "!!", "!", ".")),
        lambda: d(r.randint(5, 15)),
        lambda: f"{w().lower()}={w().lower()}{r.choice(('', d(2)))}",
        lambda: f"{w()}:{w()}{r.choice(('', '/' + w()))}",
    )
    for _ in range(n):
        words.insert(r.randrange(len(words) + 1), r.choice(forms)())
    return " ".join(words)


def learn(texts: list[str], seed: int = 0) -> Field:
    """The field of a sample of texts: the marked ones as they are and disguised, and plain words with odd ones among them."""
    r, parts = Random(seed), []
    for lo in range(0, len(texts), 40):  # so that the features of few texts are held at once
        rows: list[tuple[str, list[Span], bool]] = []  # text, its spans, whether a word may be in doubt
        for text in texts[lo : lo + 40]:
            spans = pattern_spans(text)
            rows.append((text, spans, True))
            rows += [(*disguised(text, spans, r), True) for _ in range(COPIES)] if spans else [(littered(text, r), [], False)]
        words = words_of(pa.array([t for t, _, _ in rows], pa.string()))
        if not len(words.start):
            continue
        tags = np.zeros(len(words.start), np.int8)
        a, b = _bounds(words, _points(words.buf))
        first = words.first()
        for d, (_, spans, _) in enumerate(rows):
            s = slice(first[d], first[d + 1])
            for start, end, _ in spans:
                hit = np.flatnonzero((b[s] > start) & (a[s] < end)) + first[d]
                tags[hit] = np.where(tags[hit] == 0, I, tags[hit])
                tags[hit[0]] = B
        at = features(words)
        # a mark on mere digits (a card's, say) says nothing of keys; unmarked, a long word of letters and digits may be one
        kinds, bucket, turns = at[:, 1] - _BLOCKS[1], at[:, 0], (at[:, 11] - _BLOCKS[11]) // 16
        letters, digits = (kinds & 3) > 0, (kinds & 4) > 0
        doubt = np.array([x for _, _, x in rows])[words.doc] & (((tags > 0) & ~letters & digits) | ((tags == 0) & letters & digits & (bucket >= 6) & (turns > 2)))
        parts.append(stretches(at, tags, words.doc, doubt, np.random.default_rng(lo)))
    if not parts:
        return fit(np.zeros((0, WIDTH, len(_BLOCKS) - 1), np.int32), np.zeros((0, WIDTH), np.int8), np.zeros((0, WIDTH), bool))
    x, y, real = (np.concatenate(p) for p in zip(*parts))
    twice = lambda v: np.concatenate([v, v])
    return fit(np.concatenate([x, hidden(x.reshape(-1, x.shape[2])).reshape(x.shape)]), twice(y), twice(real))


def chunk_spans(column: pa.Array, field: Field) -> list[list[Span]]:
    """Each text's spans in order, the field's among them."""
    words = words_of(column)
    n = words.n_docs
    found: list[list[Span]] = [[] for _ in range(n)]
    # where a pattern can be at all
    buf = words.buf
    hit = np.zeros(n, bool)
    where = [np.flatnonzero(_SCAN[buf]), _runs(_HEX[buf], words.offsets, 16)]
    if (raw := buf.tobytes()).find(b"AKIA") >= 0:
        # starts may overlap: one across the bounds of two texts hides none that begins in the second
        where.append(np.array([m.start() for m in re.finditer(b"(?=AKIA)", raw)]))
    for at in where:
        hit[np.searchsorted(words.offsets, at, "right") - 1] = True
    for d in np.flatnonzero(hit):
        found[d] = pattern_spans(column[int(d)].as_py() or "")
    tags = decode(field.scores(features(words)), words.doc, field.steps)
    begins = np.flatnonzero(tags == B)
    if len(begins):
        points = _points(buf)
        a, b = _bounds(words, points)
        ends = begins.copy()
        inside = np.append(tags[1:] == I, False) & np.append(words.doc[1:] == words.doc[:-1], False)
        while (go := inside[ends]).any():
            ends[go] += 1
        for s, e in zip(begins, ends):
            d = int(words.doc[s])
            lo, hi = int(a[s]), int(b[e])
            text = column[d].as_py()
            lo += len(text[lo:hi]) - len(text[lo:hi].lstrip("\"'`([{<,;"))
            hi -= len(text[lo:hi]) - len(text[lo:hi].rstrip("\"'`)]}>,;.!?"))
            if lo < hi and all(hi <= x or lo >= y for x, y, _ in found[d]):
                found[d].append((lo, hi, 3))
    return [sorted(x) for x in found]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans and clean_text (each span, or spans that overlap, as [SECRET])."""
    new = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "clean_text")
    rows = others(docs, *new)
    schema = schema_with(rows, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, clean_text string")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        found = chunk_spans(column, field)
        counts = [[sum(k == i for _, _, k in x) for x in found] for i in range(3)]
        digest = [hashlib.sha256(_joined([s for s in x if s[2] < 3]).encode()).hexdigest() for x in found]
        at = np.flatnonzero([bool(x) for x in found])
        texts = column
        if len(at):
            mask = np.zeros(len(found), bool)
            mask[at] = True
            texts = pc.replace_with_mask(column, pa.array(mask), pa.array([redacted(column[int(d)].as_py(), found[d]) for d in at], column.type))
        arrays = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digest), pa.array([_joined(x) for x in found]), texts]
        return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *new])

    return by_chunk(rows, each, schema)


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op7_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, learn(sample_of(docs))).drop("text", "clean_text")
