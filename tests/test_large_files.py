"""Delimited files over many tasks: the same rows as one task gives, wherever ranges are cut."""

import random

import pytest

from ledgerloom.operators import proof
from ledgerloom.sources import files


def reference_rows(text, delimiter):
    """A plain state machine, letter by letter."""
    rows, row, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"':
            quoted = True
        elif c == delimiter:
            row, cell = [*row, cell], ""
        elif c in "\r\n":
            rows.append([*row, cell])
            row, cell = [], ""
        else:
            cell += c
        i += 1
    rows.append([*row, cell])
    return [r for r in rows if any(x.strip() for x in r)]


def awkward(r, n, delimiter, wide=""):
    cell = lambda: r.choice(["", " ", "a", f"v{r.randrange(999)}", '"x"', f'"a{delimiter}b"', '"line\nbreak"', '"two\r\n\nbreaks"', '"said ""so"""', 'mid"dle, of"it', '""', f"é{wide}", '"' + "long\n" * r.randrange(40) + '"'])
    lines = [delimiter.join(cell() for _ in range(r.randint(1, 4))) + r.choice(["\n", "\n", "\r\n", "\n\n", "\r"]) for _ in range(n)]
    return f'"head{delimiter}er"{delimiter}b{delimiter}c{delimiter}d\n' + "".join(lines)


@pytest.mark.parametrize("seed", range(4))
def test_matrix_is_the_plain_machine(seed):
    r = random.Random(seed)
    for delimiter in ";,\t|":
        text = awkward(r, 60, delimiter, "ß€")
        assert files.matrix(text) == files.matrix(text, delimiter) == reference_rows(text, delimiter)
    assert files.matrix("") == files.matrix(" \n\r\n;;\n") == [] and files.matrix('a;"b') == [["a", "b"]]


@pytest.mark.parametrize("few", [100_000, 0])
def test_ranges_give_the_rows_of_one_task(spark, tmp_path, few):
    """Ranges of some hundred bytes: rows, quoted breaks and letters of several bytes run over them; files of several encodings."""
    r = random.Random(5)
    texts = {"a.csv": awkward(r, 400, ";", "€"), "b.csv": awkward(r, 300, ","), "open.csv": "x;y\n1;2\n" + 'z;"never closed\n' * 31 + "end", "one.csv": 'a;b\n"' + "w\n" * 4000 + '";2\nlast;"row"', "blank.csv": "\n \n" * 200 + "k;l;m\n1;2;3\n", "tiny.csv": "a,b", "none.csv": "\n\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "latin.csv").write_bytes("".join(f"açúcar {i};R$ {i},00\n" for i in range(400)).encode("cp1252"))
    (tmp_path / "mark.csv").write_bytes(b"\xef\xbb\xbf" + texts["b.csv"].encode())
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "700b")
    try:
        found = files.large_tables(spark, str(tmp_path), few).collect()
        assert len({r.block for r in files._lines(spark, str(tmp_path / "a.csv")).select("block").distinct().collect()}) > 10
    finally:
        spark.conf.set(key, before)
    got = {}
    for x in sorted(found, key=lambda x: (x.path, x.row_no)):
        got.setdefault(x.path.rsplit("/", 1)[1], []).append((x.row_no, x.cells))
    whole = {x.path.rsplit("/", 1)[1]: files.decode_bytes(bytes(x.content)) for x in files.load(spark, str(tmp_path)).collect()}
    for name, text in whole.items():
        assert got.get(name, []) == list(enumerate(files.matrix(text))), name


def chain(rows):
    down = sum(a["before_cents"] != b["after_cents"] for a, b in zip(rows, rows[1:]))
    up = sum(a["after_cents"] != b["before_cents"] for a, b in zip(rows, rows[1:]))
    ok = sum(x["before_cents"] + x["value_cents"] - (x["fee_cents"] or 0) == x["after_cents"] for x in rows)
    return len(rows), ok, len(rows) - ok, down, up


@pytest.mark.parametrize("segment", [1, 7, 100_000])
def test_chain_of_segments_is_the_chain_of_the_file(spark, segment):
    """Any cut of a file into segments, on any number of partitions; segments without a read row; both directions."""
    r = random.Random(segment)
    rows = []
    for f in range(6):
        balance, n = 0, r.choice([0, 1, 2, 40, 90])
        mine = []
        for i in range(n):
            value, fee = r.randrange(-50, 50), r.choice([None, 0, 3])
            after = balance + value - (fee or 0) + (r.random() < 0.1)
            mine.append({"file_id": f, "row_no": i, "value_cents": value, "fee_cents": fee, "before_cents": balance, "after_cents": after, "good": r.random() < 0.7 or f == 1})
            balance = after + (r.random() < 0.1)
        rows += mine if f % 2 else [x | {"row_no": n - 1 - x["row_no"]} for x in mine]
    df = spark.createDataFrame(rows, "file_id int, row_no long, value_cents long, fee_cents long, before_cents long, after_cents long, good boolean")
    for parts in (1, 5):
        for only in (None, "good"):
            got = proof.balance_chain(df.repartition(parts), segment=segment, read=None if only is None else df.good).collect()
            for x in got:
                mine = sorted((y for y in rows if y["file_id"] == x.file_id and (only is None or y["good"])), key=lambda y: y["row_no"])
                assert (x.n_rows, x.rows_ok, x.rows_bad, x.breaks_newest_first, x.breaks_oldest_first) == chain(mine)
                assert x.links_broken == min(chain(mine)[3:]) and x.links_ok == max(0, len(mine) - 1) - x.links_broken
            assert {x.file_id for x in got} == {y["file_id"] for y in rows}
