"""Statement files as rows of (path, content): kind by bytes, text, delimiter, and tables of cells in file order.

A file is one row; what is done inside one file is a small helper, what is done across files is Spark's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.steps import stored

DELIMITERS = (",", ";", "\t", "|")


#: Bytes of a file beyond which it goes by large_tables.
LARGE = 64 << 20
_NOT_DELIMITED = (".pdf", ".xlsx", ".xlsm", ".xls", ".ofx", ".png", ".jpg", ".jpeg")


def load(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path, content of each file; with `most`, not of delimited files of more bytes."""
    found = spark.read.format("binaryFile").load(path)
    if most is not None:
        found = found.where((F.col("length") <= most) | _other_name(F.col("path")))
    return found.select("path", "content")


def _other_name(path: Column) -> Column:
    """Files of other kinds than delimited text, by their names: a content of many megabytes isn't looked at for this."""
    return F.lower(path).rlike("(" + "|".join(x.replace(".", r"\.") for x in _NOT_DELIMITED) + ")$")


def large_paths(spark: SparkSession, path: str, most: int = LARGE) -> list[str]:
    """Paths of delimited files of more than `most` bytes; no content is read."""
    found = spark.read.format("binaryFile").load(path).where(F.col("length") > most)
    return [r[0] for r in found.where(~_other_name(F.col("path"))).select("path").collect()]


def kind(content: Column, path: Column) -> Column:
    """pdf, image, xls-legacy, spreadsheet, ofx or text, by the first bytes; a name's ending only tells what a plain ZIP is."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    ascii_ = lambda n: F.upper(F.decode(F.substring(content, 1, n), "ISO-8859-1"))
    inner = F.contains(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), F.lit("xl/"))
    named = F.lower(path).rlike(r"\.(xlsx|xlsm|xls)$")
    return (
        F.when(head(4) == "25504446", "pdf")
        .when((head(3) == "FFD8FF") | (head(4) == "89504E47"), "image")
        .when(head(4) == "D0CF11E0", "xls-legacy")
        .when(head(4) == "504B0304", F.when(inner | named, "spreadsheet").otherwise("text"))
        .when(F.contains(ascii_(2048), F.lit("OFXHEADER")) | F.contains(ascii_(2048), F.lit("<OFX>")), "ofx")
        .otherwise("text")
    )


def decode_bytes(content: bytes) -> str:
    """By byte order mark, else strict UTF-8, else Windows-1252 (bytes that it lacks are kept as controls)."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in content)


def with_text(files: DataFrame) -> DataFrame:
    """files with text. UTF-8 without a mark stays in the JVM's own decoder; the rest goes through an Arrow function."""

    @F.pandas_udf("string")
    def other(content: pd.Series) -> pd.Series:
        return content.map(lambda c: decode_bytes(bytes(c or b"")))

    plain = F.is_valid_utf8(F.col("content")) & ~F.hex(F.substring("content", 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")
    easy = files.where(plain).withColumn("text", F.decode("content", "UTF-8"))
    return easy.unionByName(files.where(~plain).withColumn("text", other("content")))


def sniff_delimiter(text: str) -> str:
    """The candidate that the first line with something in it has most of, outside quotes; a comma if none."""
    quoted, counts, black = False, dict.fromkeys(DELIMITERS, 0), False
    for c in text:
        if c == '"':
            quoted = not quoted
            black = True
        elif not quoted and c in "\r\n":
            if black:
                break
            counts = dict.fromkeys(DELIMITERS, 0)
        else:
            black |= not c.isspace()
            if not quoted and c in counts:
                counts[c] += 1
    best = max(DELIMITERS, key=lambda d: (counts[d], -DELIMITERS.index(d)))
    return best if counts[best] else ","


_QUOTED = re.compile(r'"((?:[^"]|"")*)"?')


def _cell(raw: bytes, encoding: str) -> str:
    """A field's text: quotes open and close anywhere in it, a doubled one inside them stands for itself."""
    text = raw.decode(encoding, "replace") if encoding == "utf-8" else decode_bytes(raw)
    return _QUOTED.sub(lambda m: m[1].replace('""', '"'), text) if '"' in text else text


def _edges(text: bytes, delimiter: bytes | None, quoted: bool = False) -> tuple[np.ndarray, np.ndarray, bool]:
    """Positions of delimiters and line breaks outside quotes, which of them are breaks, and whether the text ends inside quotes.
    Quotes turn the state wherever they stand, so the state is the parity of the quotes before."""
    buf = np.frombuffer(text, np.uint8)
    found = (buf == 10) | (buf == 13)
    if delimiter is not None:
        found |= buf == delimiter[0]
    at = np.flatnonzero(found)
    quotes = np.flatnonzero(buf == 34)
    outside = (np.searchsorted(quotes, at) + quoted) % 2 == 0
    at = at[outside]
    return at, (buf[at] == 10) | (buf[at] == 13), bool((len(quotes) + quoted) % 2)


def records(text: bytes, delimiter: bytes, encoding: str = "utf-8", last: bool = True) -> tuple[list[list[str]], int]:
    """Rows of cells of a text that begins outside quotes, blank rows dropped, and where the row that is still open begins. The end of the
    text ends the last row, if this is the last of it."""
    at, breaks, _ = _edges(text, delimiter)
    rows, row, begin, start = [], [], 0, 0
    for i, is_break in zip(at.tolist(), breaks.tolist()):
        row.append(_cell(text[begin:i], encoding))
        begin = i + 1
        if is_break:
            if any(c.strip() for c in row):
                rows.append(row)
            row, start = [], begin
    if last and start < len(text):
        row.append(_cell(text[begin:], encoding))
        if any(c.strip() for c in row):
            rows.append(row)
    return rows, start


def matrix(text: str, delimiter: str | None = None) -> list[list[str]]:
    """Rows of cells: fields in quotes, of any length, may hold delimiters, breaks and doubled quotes; blank rows are dropped."""
    return records(text.encode("utf-8", "surrogatepass"), (delimiter or sniff_delimiter(text)).encode())[0]


def tables(texts: DataFrame) -> DataFrame:
    """path, row_no (0 is the header), cells: the rows of each delimited file, in file order, one file in memory at a time. Files
    that are large for one task go by large_tables."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, text in zip(f["path"], f["text"]):
                rows = matrix(text or "")
                for lo in range(0, len(rows), 10_000):
                    part = rows[lo : lo + 10_000]
                    yield pd.DataFrame({"path": path, "row_no": range(lo, lo + len(part)), "cells": part})

    return texts.select("path", "text").mapInPandas(run, "path string, row_no int, cells array<string>")


# --- large files: many tasks a file ---

_MARK, _END = b"\xef\xbb\xbf", 1 << 62
#: Ranges whose states are broadcast; the lines of more ranges meet them by a shuffle.
FEW_RANGES = 100_000
_RANGES = "path string, block long, odd boolean, valid boolean, breaks_out boolean, breaks_in boolean, delimiter_out string, delimiter_in string, n_bytes long, size long"
_PIECES = "path string, block long, home long, idx long, cells array<string>, piece binary, delimiter string, encoding string"


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of files as Spark deals them out: block is the first byte of a task's range of the file, id their order in it."""
    text = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"), F.col("_metadata.file_size").alias("size"))
    return text.withColumn("id", F.monotonically_increasing_id())


def _by_range(batches: Iterator[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[tuple[tuple, bool, bytes]]:
    """Key, whether it is new, and the text of stretches of lines of one range after the other; each line has its break."""
    before = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("path", "block", *more))))
        lines = batch.column("line").to_pylist()
        lo = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i][:2] != keys[lo][:2]:
                yield keys[lo], keys[lo][:2] != before, b"\n".join(lines[lo:i]) + b"\n"
                before, lo = keys[lo][:2], i


def _is_utf8(text: bytes) -> bool:
    try:
        text.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range, for both states that it may begin in: whether rows end in it, and the delimiter of its first row with
    something in it; whether its quotes turn the state, and whether it is UTF-8."""
    found: dict | None = None
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _RANGES.split(", "))])

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{k: v for k, v in found.items() if k != "heads"} | {f"delimiter_{s}": _first_delimiter(h) for s, h in found["heads"].items()}], schema)

    for (path, block, size), new, text in _by_range(batches, ("size",)):
        n_bytes = len(text)
        if new:
            text = text.removeprefix(_MARK) if block == 0 else text
            if found:
                yield row()
            found = {"path": path, "block": block, "odd": False, "valid": True, "breaks_out": False, "breaks_in": False, "heads": {"out": b"", "in": None}, "n_bytes": 0, "size": size}
        found["n_bytes"] += n_bytes
        found["valid"] = found["valid"] and _is_utf8(text)
        for state, begins in (("out", False), ("in", True)):
            at, _, _ = _edges(text, None, begins != found["odd"])
            found[f"breaks_{state}"] |= bool(len(at))
            head = found["heads"][state]
            if head is None and len(at):  # what comes before belongs to a row that began earlier
                head, rest = b"", text[int(at[0]) + 1 :]
            else:
                rest = text
            if head is not None and _first_delimiter(head) is None:
                found["heads"][state] = head + rest
        found["odd"] ^= text.count(b'"') % 2 == 1
    if found:
        yield row()


def _first_delimiter(head: bytes | None) -> str | None:
    """The delimiter, if a row with something in it has ended."""
    if head is None or not head.replace(b'"', b"x").strip():
        return None
    at, _, _ = _edges(head, None)
    begin = 0
    for i in at.tolist():
        if head[begin:i].strip():
            return sniff_delimiter(head[begin:i].decode("latin-1"))
        begin = i + 1
    return None


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each range: idx is their order in it. What belongs to a row that begins or ends in another range goes on as a piece to its home, the
    range where it ends (or the file's end)."""
    key: tuple = ()
    held, idx, inside = b"", 0, False

    def row(n: int | None, cells: list[str] | None, piece: bytes | None, home: int) -> dict:
        return {"path": key[0], "block": key[1], "home": home, "idx": n, "cells": cells, "piece": piece, "delimiter": key[3], "encoding": key[4]}

    def rest() -> list[dict]:
        return [row(None, None, held, key[5])] if held else []

    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("home", pa.int64()), ("idx", pa.int64()), ("cells", pa.list_(pa.string())), ("piece", pa.binary()), ("delimiter", pa.string()), ("encoding", pa.string())])
    for found, new, text in _by_range(batches, ("inside", "delimiter", "encoding", "home")):
        out = []
        if new:
            out += rest()
            key, held, idx, inside = found, b"", 0, found[2]
            text = text.removeprefix(_MARK) if key[1] == 0 else text
        text, held = held + text, b""
        if inside:  # up to the first break: the end of an earlier row
            at, _, _ = _edges(text, None, True)
            if len(at):
                out.append(row(None, None, text[: int(at[0]) + 1], key[1]))
                text, inside = text[int(at[0]) + 1 :], False
            else:
                held = text
        if not inside:
            rows, open_ = records(text, key[3].encode(), key[4], last=False)
            out += [row(idx + i, cells, None, key[1]) for i, cells in enumerate(rows)]
            idx, held = idx + len(rows), text[open_:]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if last := rest():
        yield pa.RecordBatch.from_pylist(last, schema)


def _joined_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            text = b"".join(p["piece"] for p in r["pieces"])
            rows, _ = records(text[:-1] if r["unended"] else text, r["delimiter"].encode(), r["encoding"])
            out += [{"path": r["path"], "block": r["home"], "idx": -1, "cells": c} for c in rows[:1]]
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("block", pa.int64()), ("idx", pa.int64()), ("cells", pa.list_(pa.string()))]))


def large_tables(spark: SparkSession, path: str | list[str], few_ranges: int = FEW_RANGES) -> DataFrame:
    """path, row_no (0 is the header), cells of delimited files of any size: a file is the work of as many tasks as it has ranges.

    A break or delimiter counts where an even number of quotes comes before it, so a range can't tell by itself what its first byte
    means. A first pass scans each range for both states; the parities of the ranges before tell which of them holds. A second pass cuts all ranges
    into rows at once. A row that runs over ranges is put together from its pieces in the range where it ends. Row numbers are sums of the ranges'
    numbers of rows. Texts are UTF-8 if the whole file is, else Windows-1252; files of two bytes a letter go by tables(). An open quote at
    the end of a file closes there. The tables between the passes lie in the shared folder."""
    lines = _lines(spark, path)
    ranges = stored(lines.mapInArrow(_scan, _RANGES))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("path").orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    state = ranges.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    state = state.withColumn("ends", F.when(F.when(F.col("inside"), F.col("breaks_in")).otherwise(F.col("breaks_out")), F.col("block")))
    # rows still open at a range's end: where the next break is, or the end of the file
    state = state.withColumn("home", F.coalesce(F.last("ends", ignorenulls=True).over(after), F.lit(_END)))
    files_ = state.groupBy("path").agg(
        F.min_by(F.when(F.col("inside"), F.col("delimiter_in")).otherwise(F.col("delimiter_out")), F.when(F.when(F.col("inside"), F.col("delimiter_in")).otherwise(F.col("delimiter_out")).isNotNull(), F.col("block"))).alias("delimiter"),
        F.when(F.bool_and("valid"), "utf-8").otherwise("cp1252").alias("encoding"), (F.sum("n_bytes") > F.max("size")).alias("unended"),
    )
    state = stored(state.join(files_, "path").select("path", "block", "inside", F.coalesce("delimiter", F.lit(",")).alias("delimiter"), "encoding", "home", "unended"))
    if state.count() <= few_ranges:
        met = lines.join(F.broadcast(state), ["path", "block"])
    else:
        met = lines.join(state, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "id")
    cut = stored(met.select("path", "block", "line", "inside", "delimiter", "encoding", "home").mapInArrow(_cut, _PIECES))
    # every line came with a break: the last one of a file that has none there is taken back
    last = state.where(F.col("unended")).select("path", F.lit(_END).alias("home"), F.lit(True).alias("unended")).distinct()
    pieces = cut.where("piece is not null").groupBy("path", "home").agg(F.array_sort(F.collect_list(F.struct("block", "piece"))).alias("pieces"), F.first("delimiter").alias("delimiter"), F.first("encoding").alias("encoding"))
    pieces = pieces.join(last, ["path", "home"], "left")
    rows = cut.where("piece is null").select("path", "block", "idx", "cells").unionByName(stored(pieces.mapInArrow(_joined_pieces, "path string, block long, idx long, cells array<string>")))
    n = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.count_if(F.col("idx") < 0).alias("joined"))
    first = F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("joined")
    placed = rows.join(n.select("path", "block", first.alias("first")), ["path", "block"])
    return placed.select("path", (F.col("first") + F.col("idx")).alias("row_no"), "cells")
