"""The rules document: JSON files of rule sets, read without ever failing, chosen by a workbook's fingerprint, and written back.

A document holds sets; a set holds fingerprints of the workbooks that it is known to fit, rules, and dismissed suggestions. What
can't be understood is left out, and a warning says so.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import rules as rule_operators

# The version of the document and the words of its directions and origins; its field names are those in read().
VERSION = 1
DIRECTIONS = {"entrada": "in", "saida": "out"}
ORIGINS = ("manual", "aprendida", "minerada")


@dataclass
class Rulebook:
    """sets: path, set_id, set_name, fingerprints, dismissed, updated, set_pos. rules: path, set_id, the columns of a rule, origin.
    last: path, last_id. warnings: path, warning."""

    sets: DataFrame
    rules: DataFrame
    last: DataFrame
    warnings: DataFrame


def load(spark: SparkSession, path: str) -> Rulebook:
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return read(files)


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("")), "^([A-Z]*)", 1)


def _at(v: str, field: str) -> Column:
    return F.try_variant_get(F.col(v), f"$.{field}", "variant")


def _text(v: str, field: str) -> Column:
    """A field that is a text, else the empty text."""
    return F.when(_kind(_at(v, field)) == "STRING", F.try_variant_get(F.col(v), f"$.{field}", "string")).otherwise("")


def _number(v: str, field: str) -> Column:
    return F.when(_kind(_at(v, field)).isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(F.col(v), f"$.{field}", "double"))


def _list(v: str, field: str) -> Column:
    return F.coalesce(F.when(_kind(_at(v, field)) == "ARRAY", F.try_variant_get(F.col(v), f"$.{field}", "array<variant>")), F.array().cast("array<variant>"))


def _texts(v: str, field: str) -> Column:
    """The texts of a list, whatever else is in it."""
    return F.transform(F.filter(_list(v, field), lambda x: _kind(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


def _warned(rows: DataFrame, warning: Column) -> DataFrame:
    return rows.select("path", warning.alias("warning")).where("warning is not null")


def read(files: DataFrame) -> Rulebook:
    """files: path, text. A document that isn't JSON, or isn't an object, has no sets and one warning; an empty one has none."""
    docs = files.select("path", "text", F.try_parse_json("text").alias("v")).withColumn("good", F.coalesce(_kind(F.col("v")) == "OBJECT", F.lit(False)))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    warnings = _warned(docs, F.when(~F.col("good") & ~blank, "the rules document can't be read and is left out"))
    newer = F.when(_number("v", "versao") > VERSION, F.concat(F.lit("the rules document is of a newer version: "), _number("v", "versao").cast("long").cast("string")))
    docs = docs.where("good")
    warnings = warnings.unionByName(_warned(docs, newer))

    sets = docs.select("path", F.posexplode(_list("v", "carteiras")).alias("set_pos", "c")).withColumn("set_id", F.when(_kind(F.col("c")) == "OBJECT", _text("c", "id")))
    nth = F.concat(F.lit("set "), (F.col("set_pos") + 1).cast("string"))
    again = F.row_number().over(W.partitionBy("path", "set_id").orderBy("set_pos")) > 1
    sets = sets.withColumn("_why", F.when(F.col("set_id").isNull(), F.concat(nth, F.lit(" left out: not an object"))).when(F.col("set_id") == "", F.concat(nth, F.lit(" left out: no identifier"))).when(again, F.concat(F.lit("set left out: identifier repeated: "), "set_id")))
    warnings = warnings.unionByName(_warned(sets, F.col("_why")))
    sets = sets.where("_why is null")

    found = sets.select("path", "set_id", F.posexplode(_list("c", "regras")).alias("pos", "r"))
    shaped = F.coalesce(_kind(F.col("r")) == "OBJECT", F.lit(False))
    warnings = warnings.unionByName(_warned(found, F.when(~shaped, F.concat(F.lit("rule "), (F.col("pos") + 1).cast("string"), F.lit(" left out: not an object")))))
    said = _text("r", "direcao")
    direction = F.coalesce(*[F.when(said == k, v) for k, v in DIRECTIONS.items()], F.lit("out"))
    active = F.coalesce(~((_kind(_at("r", "ativo")) == "BOOLEAN") & ~F.try_variant_get(F.col("r"), "$.ativo", "boolean")), F.lit(True))
    origin = _text("r", "origem")
    found = found.where(shaped).select(
        "path", "set_id", _text("r", "id").alias("rule_id"), active.alias("active"), F.coalesce(F.nullif(_text("r", "rotulo"), F.lit("")), _text("r", "id")).alias("label"),
        direction.alias("direction"), F.nullif(_text("r", "quando.nome"), F.lit("")).alias("name"), _texts("r", "quando.contem").alias("terms"),
        _number("r", "quando.valorCents.min").cast("long").alias("min_cents"), _number("r", "quando.valorCents.max").cast("long").alias("max_cents"), _texts("r", "excecoes").alias("exceptions"),
        _text("r", "categoriaChave").alias("category_key"), F.nullif(_text("r", "contaId"), F.lit("")).alias("account_id"), _texts("r", "aliasesSim").alias("aliases_yes"), _texts("r", "aliasesNao").alias("aliases_no"),
        _number("r", "prioridade").cast("int").alias("priority"), "pos", F.when(origin.isin(*ORIGINS), origin).otherwise(ORIGINS[0]).alias("origin"), said.alias("_said"),
    )
    label = F.coalesce(F.nullif("label", F.lit("")), F.lit("without a name"))
    odd = F.when((F.col("_said") != "") & ~F.col("_said").isin(*DIRECTIONS), F.concat(F.lit("rule "), label, F.lit(": direction unknown: "), "_said"))
    warnings = warnings.unionByName(_warned(found, odd))
    found = rule_operators.problems(found)
    wrong = F.when(F.size("problems") > 0, F.concat(F.lit("rule "), label, F.lit(" left out: "), F.array_join("problems", "; ")))
    warnings = warnings.unionByName(_warned(found, wrong))
    good = found.where(F.size("problems") == 0).withColumn("_n", F.row_number().over(W.partitionBy("path", "set_id", "rule_id").orderBy("pos")))
    warnings = warnings.unionByName(_warned(good, F.when(F.col("_n") > 1, F.concat(F.lit("rule left out: identifier repeated: "), "rule_id"))))

    sets = sets.select(
        "path", "set_id", F.coalesce(F.nullif(_text("c", "nome"), F.lit("")), "set_id").alias("set_name"), _texts("c", "impressoes").alias("fingerprints"),
        _texts("c", "dispensadas").alias("dismissed"), _text("c", "atualizadoEm").alias("updated"), "set_pos",
    )
    last = docs.select("path", _text("v", "ultimaCarteiraId").alias("last_id"))
    last = last.join(sets.select("path", F.col("set_id").alias("last_id")), ["path", "last_id"], "left_semi")
    return Rulebook(sets, good.where("_n = 1").drop("problems", "_n", "_said"), last, warnings)


def fingerprints(sheets: DataFrame, columns: DataFrame, categories: DataFrame, by: str = "path") -> DataFrame:
    """by, fingerprint: a hash of what a workbook is made of (sheets: sheet; columns: col, header; categories: option), whatever their
    order, accents and case; what is written in it doesn't count. Rows of the three are many for each workbook, but names only."""
    key = lambda c: text.option_key(F.coalesce(c, F.lit("")))
    parts = (
        ("_s", sheets.select(by, key("sheet").alias("k")).where("k <> ''")),
        ("_c", columns.select(by, F.concat(F.upper("col"), F.lit("="), key("header")).alias("k"))),
        ("_o", categories.select(by, key("option").alias("k")).where("k <> ''")),
    )
    every = None
    for name, rows in parts:
        tagged = rows.withColumn("part", F.lit(name))
        every = tagged if every is None else every.unionByName(tagged)
    of = lambda name: F.coalesce(F.array_join(F.array_sort(F.collect_list(F.when(F.col("part") == name, F.col("k")))), "|"), F.lit(""))
    return every.groupBy(by).agg(F.sha2(F.concat_ws("\n", *[of(n) for n, _ in parts]), 256).alias("fingerprint"))


def chosen(book: Rulebook, asked: DataFrame) -> DataFrame:
    """asked (path of the document, fingerprint) with set_id and reason: the first set that knows the fingerprint, else the set used
    last, which is only a guess, else none (new)."""
    known = book.sets.select("path", "set_id", "set_pos", F.explode("fingerprints").alias("fingerprint"))
    first = known.groupBy("path", "fingerprint").agg(F.min_by("set_id", "set_pos").alias("_known"))
    met = asked.join(first, ["path", "fingerprint"], "left").join(book.last, "path", "left")
    reason = F.when(F.col("_known").isNotNull(), "fingerprint").when(F.col("last_id").isNotNull(), "last").otherwise("new")
    return met.withColumns({"set_id": F.coalesce("_known", "last_id"), "reason": reason}).drop("_known", "last_id")


def documents(book: Rulebook) -> DataFrame:
    """path, text: each rules document as JSON to be read by people; a document's sets and rules are few."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    back = F.coalesce(*[F.when(F.col("direction") == v, k) for k, v in DIRECTIONS.items()])
    amount = F.when(F.col("min_cents").isNotNull() | F.col("max_cents").isNotNull(), F.struct(F.col("min_cents").alias("min"), F.col("max_cents").alias("max")))
    when = F.struct(F.col("name").alias("nome"), some("terms").alias("contem"), amount.alias("valorCents"))
    rule = F.struct(
        F.col("rule_id").alias("id"), F.col("active").alias("ativo"), F.col("label").alias("rotulo"), back.alias("direcao"), when.alias("quando"), some("exceptions").alias("excecoes"), F.col("category_key").alias("categoriaChave"),
        F.col("account_id").alias("contaId"), some("aliases_yes").alias("aliasesSim"), some("aliases_no").alias("aliasesNao"), F.col("priority").alias("prioridade"), F.col("origin").alias("origem"),
    )
    ordered = lambda pos, what: F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), what.alias("x")))), lambda e: e["x"])
    of_set = book.rules.groupBy("path", "set_id").agg(ordered("pos", rule).alias("regras"))
    sets = book.sets.join(of_set, ["path", "set_id"], "left")
    one = F.struct(
        F.col("set_id").alias("id"), F.col("set_name").alias("nome"), F.col("fingerprints").alias("impressoes"), F.coalesce("regras", F.array().cast(of_set.schema["regras"].dataType)).alias("regras"),
        F.col("dismissed").alias("dispensadas"), F.col("updated").alias("atualizadoEm"),
    )
    whole = sets.groupBy("path").agg(ordered("set_pos", one).alias("carteiras")).join(book.last, "path", "left")
    return whole.select("path", F.to_json(F.struct(F.lit(VERSION).alias("versao"), "carteiras", F.col("last_id").alias("ultimaCarteiraId")), {"pretty": "true"}).alias("text"))


def save(document: DataFrame, path: str) -> None:
    """Writes the text of a document's one row to a file: first beside it, then in its place in one step, so that a failure leaves the old one."""
    spark = document.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    beside = f"{path}.{uuid.uuid4().hex}"
    document.select("text").coalesce(1).write.text(beside)
    part = [s.getPath() for s in fs.Path(beside).getFileSystem(conf).listStatus(fs.Path(beside)) if s.getPath().getName().startswith("part-") and s.getLen() > 0]
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").OVERWRITE
    target = fs.Path(path).makeQualified(fs.Path(path).getFileSystem(conf).getUri(), fs.Path("/"))
    fs.FileContext.getFileContext(target.toUri(), conf).rename(part[0], target, how)
    target.getFileSystem(conf).delete(fs.Path(beside), True)


def suggestion_key(direction: Column, name: Column) -> Column:
    """What a dismissed suggestion is remembered by: the direction in the document's word, and the name's key."""
    word = F.coalesce(*[F.when(direction == v, k) for k, v in DIRECTIONS.items()])
    return F.concat_ws("|", word, text.name_key(name))


def dismiss(book: Rulebook, asked: DataFrame) -> Rulebook:
    """asked: path, set_id, key. A key is dismissed once; the order of the earlier ones stays."""
    keys = asked.groupBy("path", "set_id").agg(F.array_sort(F.collect_set("key")).alias("_new"))
    sets = book.sets.join(keys, ["path", "set_id"], "left").withColumn("dismissed", F.array_union("dismissed", F.coalesce("_new", F.array().cast("array<string>")))).drop("_new")
    return Rulebook(sets, book.rules, book.last, book.warnings)
