"""Small corpora with everything that is awkward, and brute-force counterparts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, key string, n_words string, ids string, node string, _other long"


def corpus(seed: int = 1, n: int = 120, vocabulary: int = 300):
    """Texts with copies, near copies, shared passages, repeats, blanks of every kind, nulls and repeated rows."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) + r.choice(["", "", ",", "."]) for _ in range(vocabulary)]
    passage = [r.choice(words) for _ in range(30)]
    texts: list[str | None] = []
    for i in range(n):
        k = r.random()
        if k < 0.15 and texts:
            texts.append(r.choice(texts))
        elif k < 0.35 and any(t and len(t.split()) > 60 for t in texts):
            w = r.choice([t for t in texts if t and len(t.split()) > 60]).split(" ")
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
        else:
            w = [r.choice(words) for _ in range(r.choice([0, 1, 3, 4, 5, 12, 13, 14, 80, 150]))]
            if r.random() < 0.4:
                w[len(w) // 2 : len(w) // 2] = passage[r.randint(0, 10) :]
            texts.append("".join(x + r.choice([" ", " ", " ", "\n", "  ", "\t", "\r\n", "\x0b"]) for x in w))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (None, texts[20]), (None, None), (n + 3, "w " * 30_000), (n + 4, "x" * 50_000)]
    rows += [rows[40], rows[60], (61, "another text of a doc_id that is there already " * 4)]
    r.shuffle(rows)
    return [(i, t, r.choice(["en", "de", None]), "s", None, "clash", "clash", "clash", "clash", "clash", "clash", 7) for i, t in rows]


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
