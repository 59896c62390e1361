"""Short segments go without the coder's window and are remembered from one task of a worker to the next."""

import random

import pyarrow as pa

from ledgerloom.llm import sentencepiece_codec as codec


def made(seed, byte_pieces):
    r = random.Random(seed)
    pieces = {"".join(r.choice("abc▁") for _ in range(r.randrange(1, 6))): float(-r.randrange(1, 9)) for _ in range(40)}
    return codec.Pieces(pieces, {p: i + 300 for i, p in enumerate(pieces)}, list(range(256)) if byte_pieces else [], 299, [b""] * 400)


def by_coder(text, pieces):
    coder = codec.Coder(pieces)
    out = []
    for c in text:
        out += coder.feed(c)
    return out + coder.finish()


def test_the_short_way_gives_the_coders_ids(monkeypatch):
    """Whole scores make many ties."""
    texts = [random.Random(i).choices("abc▁xé", k=i % 40) for i in range(400)]
    want = [(p, t, by_coder(t, p)) for p in (made(1, True), made(2, False)) for t in map("".join, texts)]
    monkeypatch.setattr(codec, "Coder", None)
    assert all(codec.viterbi(t, p) == ids for p, t, ids in want)


def test_a_worker_keeps_its_memory_for_the_same_pieces_only():
    a, again, b = made(1, True), made(1, True), made(2, True)
    assert a.name() == again.name() != b.name()
    first, memory = codec.kept(a, a.name())
    codec.encode_column(pa.array(["ab ca", None, "ab"]), first, memory)
    assert memory and codec.kept(again, again.name())[1] is memory
    assert not codec.kept(b, b.name())[1] and not codec.kept(a, a.name())[1]
