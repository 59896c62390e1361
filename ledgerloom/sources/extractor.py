"""Reading a statement by an external extractor (a model, a service): a port that is off unless one is given.

The text is dealt into blocks of lines; each block goes to the extractor once, in a Python worker, with retries; an answer
that was cut off is asked for again in halves, twice at most. A block that fails is a row with its error; if all blocks of
a file fail, the file has failed. Answers are JSON, repaired and validated here.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import proof

BLOCK_LINES, TRIES, PAUSE, HALVES = 150, 3, 0.4, 2
#: text -> answer. Raises Transient for what is worth another try.
Extractor = Callable[[str], str]
_OUT = "path string, block int, line int, date string, description string, direction string, amount_cents bigint, balance_cents bigint, error string"


class Transient(Exception):
    """Worth trying again."""


def blocks(texts: DataFrame, lines: int = BLOCK_LINES) -> DataFrame:
    """path, block, body: numbered lines of each text, `lines` to a block."""
    rows = texts.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    numbered = F.concat(F.lit("L"), F.col("n") + 1, F.lit("| "), F.col("line"))
    parts = rows.groupBy("path", F.floor(F.col("n") / lines).cast("int").alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", numbered.alias("t")))).alias("_t"))
    return parts.select("path", "block", F.array_join(F.transform("_t", lambda x: x["t"]), "\n").alias("body"))


def witness_blocks(parts: DataFrame, n: int = 3) -> DataFrame:
    """The first, middle and last blocks of each file (n even places): a deterministic sample."""
    sized = parts.join(parts.groupBy("path").agg(F.max("block").alias("_m")), "path")
    places = F.array(*[F.floor(F.lit(i / max(1, n - 1)) * F.col("_m") + 0.5) for i in range(n)])
    return sized.where(F.array_contains(places, F.col("block").cast("long"))).drop("_m")


def balanced_json(answer: str) -> tuple[str | None, bool]:
    """The first whole JSON object of an answer, without fences; and whether it was cut off."""
    text = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", answer)
    start = text.find("{")
    if start < 0:
        return None, False
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1], False
    return None, True


# The fields of the answers that are asked for, by what they answer; all but transactions, which parse_answer reads.
ANSWERS = {
    "recognition": "instituicao string, numero string, rotuloEntrada string, rotuloSaida string, excluir array<string>, observacoes string",
    "profile": "linhaCabecalho int, primeiraLinha int, colunas array<struct<letra: string, papel: string, cabecalho: string>>, categorias array<string>",
    "list_columns": "colunas array<struct<letra: string, orientacao: string, dicas: array<struct<opcao: string, dica: string>>>>",
    "formula_columns": "colunas array<struct<letra: string, repetir: boolean, motivo: string>>",
    "categories": "itens array<struct<indice: int, categoria: string>>",
    "identities": "itens array<struct<indice: int, mesmaPessoa: boolean>>",
}


def answers(rows: DataFrame, kind: str, answer: str = "answer") -> DataFrame:
    """rows with parsed (a struct of the kind's fields, null if there is no object in the answer) and status: ok, empty, cut (the answer ends
    within its object) or bad (an object without any of the fields). Fields of another type are null; nothing raises."""

    @F.pandas_udf("body string, cut boolean")
    def body(said: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([balanced_json(x or "") for x in said], columns=["body", "cut"])

    found = rows.withColumn("_b", body(F.col(answer))).withColumn("parsed", F.from_json("_b.body", ANSWERS[kind], {"mode": "PERMISSIVE"}))
    fields = [x.name for x in found.schema["parsed"].dataType.fields]
    some = F.coalesce(*[F.when(F.col(f"parsed.{f}").isNotNull(), True) for f in fields], F.lit(False))
    status = F.when(F.col("_b.cut"), "cut").when(F.col("_b.body").isNull(), "empty").when(some, "ok").otherwise("bad")
    return found.withColumn("status", status).withColumn("parsed", F.when(F.col("status") == "ok", F.col("parsed"))).drop("_b")


def indexed(rows: DataFrame, by: list[str], kind: str, asked: int) -> DataFrame:
    """by, index, said: the answers of a batch to its `asked` questions; an index that wasn't asked for, or a second answer to one, doesn't count."""
    value = {"categories": "categoria", "identities": "mesmaPessoa"}[kind]
    each = answers(rows, kind).where("status = 'ok'").select(*by, F.posexplode("parsed.itens").alias("_n", "x")).where(F.col("x.indice").between(0, asked - 1))
    return each.groupBy(*by, F.col("x.indice").alias("index")).agg(F.min_by(F.col(f"x.{value}"), "_n").alias("said"))


def _number(v) -> float | None:
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v)
    s = re.sub(r"[^\d,.\-]", "", str(v or ""))
    s = s.replace(".", "").replace(",", ".") if "," in s else s
    try:
        return float(s)
    except ValueError:
        return None


def parse_answer(answer: str) -> tuple[list[dict], bool]:
    """Valid transactions of an answer {"lancamentos": [...]}; and whether the answer was cut off."""
    body, cut = balanced_json(answer)
    if body is None:
        return [], cut
    try:
        items = json.loads(body).get("lancamentos") or []
    except ValueError:
        return [], False
    out = []
    for x in items if isinstance(items, list) else []:
        value = _number(x.get("valor")) if isinstance(x, dict) else None
        if value is None or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(x.get("data", ""))):
            continue
        balance, line = _number(x.get("saldoApos")), re.sub(r"\D", "", str(x.get("linha") or ""))
        direction = "credit" if str(x.get("direcao", "")).lower().startswith(("entr", "cred")) else "debit"
        out.append({"line": int(line) if line else None, "date": x["data"], "description": str(x.get("descricao") or ""), "direction": direction, "amount_cents": round(abs(value) * 100), "balance_cents": None if balance is None else round(balance * 100)})
    return out, False


def _ask(extract: Extractor, body: str, pause: float, halves: int = HALVES) -> list[dict]:
    for turn in range(TRIES):
        try:
            rows, cut = parse_answer(extract(body))
            break
        except Transient:
            if turn == TRIES - 1:
                raise
            time.sleep(pause * 2**turn)
    lines = body.split("\n")
    if cut and halves and len(lines) > 1:
        middle = len(lines) // 2
        return [r for part in (lines[:middle], lines[middle:]) for r in _ask(extract, "\n".join(part), pause, halves - 1)]
    if cut:
        raise ValueError("the answer is cut off")
    return rows


def extract(parts: DataFrame, extractor: Extractor | None, workers: int = 5, pause: float = PAUSE) -> DataFrame:
    """A row a transaction, in the order of blocks and answers; a failed block is a row with its error. At most `workers` at a time."""
    if extractor is None:
        return parts.sparkSession.createDataFrame([], _OUT)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _OUT.split(", ")]
        for f in frames:
            for path, block, body in zip(f["path"], f["block"], f["body"]):
                try:
                    rows = [{"path": path, "block": block, "error": None, **r} for r in _ask(extractor, body, pause)]
                except Exception as e:
                    rows = [{"path": path, "block": block, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return parts.repartition(workers, "path", "block").mapInPandas(run, _OUT)


def settled(found: DataFrame) -> DataFrame:
    """Without repeats of a source line and without phantom rows (same key, balance unmoved)."""
    good = found.where("error is null").withColumn("_at", F.struct("block", F.coalesce("line", F.lit(0)), "description", "amount_cents"))
    key = ["date", "direction", "amount_cents"]
    once = proof.first_of_line(good, ["path"], "line", key, "_at")
    return proof.phantom_rows(once, "path", "_at", key, "balance_cents").where("not is_phantom").drop("is_phantom", "_at")
