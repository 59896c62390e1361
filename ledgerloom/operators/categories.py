"""Categories: the default list with its flow classes, those of a sheet, flow of a category, and what a sheet was categorised as before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money, text
from ..functions.steps import apart

# The default categories and the flow class of each, in order.
DEFAULT = (
    ("Recebimento de venda", "RECEITA"),
    ("Aluguel", "DESPESAS FIXAS"),
    ("Vale transporte", "DESPESAS FIXAS"),
    ("Fornecedor", "GASTOS VARIÁVEIS"),
    ("Salário", "DESPESAS FIXAS"),
    ("Material escritório/limpeza", "DESPESAS FIXAS"),
    ("Gás", "GASTOS VARIÁVEIS"),
    ("Combustível", "DESPESAS FIXAS"),
    ("Manutenção", "INVESTIMENTOS"),
    ("Impressão", "DESPESAS FIXAS"),
    ("Não Operacional", "NÃO OPERACIONAL"),
    ("Motoboys", "GASTOS VARIÁVEIS"),
    ("Investimento", "INVESTIMENTOS"),
    ("Prolabore", "DESPESAS FIXAS"),
    ("Retirada socios", "NÃO OPERACIONAL"),
    ("Ajuda de custo - motoboy", "GASTOS VARIÁVEIS"),
    ("Vale Alimentação", "DESPESAS FIXAS"),
    ("Diárias - free lancer", "DESPESAS FIXAS"),
    ("Farmácia", "DESPESAS FIXAS"),
    ("DAS Simples Nacional", "GASTOS VARIÁVEIS"),
    ("Embalagens", "GASTOS VARIÁVEIS"),
    ("Móveis e Utensílios", "INVESTIMENTOS"),
    ("Taxa de cartão", "GASTOS VARIÁVEIS"),
    ("Taxa Ifood", "GASTOS VARIÁVEIS"),
    ("DAS - MEI", "DESPESAS FIXAS"),
    ("Energia Elétrica", "DESPESAS FIXAS"),
    ("Internet e Telefone", "DESPESAS FIXAS"),
    ("Contador", "DESPESAS FIXAS"),
    ("Softwares", "DESPESAS FIXAS"),
    ("Empréstimos", "NÃO OPERACIONAL"),
    ("Aporte de capital", "NÃO OPERACIONAL"),
    ("Água e esgoto", "DESPESAS FIXAS"),
    ("Marketing", "INVESTIMENTOS"),
    ("Troco e devolução", "NÃO OPERACIONAL"),
    ("Comissões", "GASTOS VARIÁVEIS"),
    ("FGTS", "DESPESAS FIXAS"),
    ("INSS", "DESPESAS FIXAS"),
)


def default_categories(spark: SparkSession) -> DataFrame:
    """option, flow_class, pos."""
    return spark.createDataFrame([(*c, i) for i, c in enumerate(DEFAULT)], "option string, flow_class string, pos int")


def sheet_categories(cells: DataFrame, by: list[str], letter: str = "A") -> DataFrame:
    """by, option, pos: the distinct texts of the first column of the sheet of categories, spelt as they are, in order, but a header."""
    name, said = text.comparison_key(F.col("sheet")), text.comparison_key(F.col("value"))
    own = cells.where((name == "CATEGORIAS") & (F.col("col") == letter) & (F.trim("value") != "") & ~said.isin("CATEGORIA", "CATEGORIAS"))
    first = own.groupBy(*by, F.col("value").alias("option")).agg(F.min("row").alias("_row"))
    return first.select(*by, "option", (F.row_number().over(W.partitionBy(*by).orderBy("_row")) - 1).cast("int").alias("pos"))


def with_flow_class(rows: DataFrame, categories: DataFrame, category: str = "category") -> DataFrame:
    """rows with flow_class: of the first category of that spelling, letters of either case; '' where there is none."""
    known = categories.groupBy(F.upper("option").alias("_k")).agg(F.min_by("flow_class", "pos").alias("flow_class"))
    return rows.withColumn("_k", F.upper(category)).join(known, "_k", "left").withColumn("flow_class", F.coalesce("flow_class", F.lit(""))).drop("_k")


def category_history(cells: DataFrame, by: list[str], first_row: int, description: str, category: str, money_in: str, money_out: str) -> DataFrame:
    """by, sheet, pos (row), description, category (spelt as it is) and flow of the rows that were categorised, which rules are mined from.
    Rows without a category, a description or an amount teach nothing."""
    own = cells.where((F.col("row") >= first_row) & F.col("col").isin(description, category, money_in, money_out))
    at = lambda letter: F.max(F.when(F.col("col") == letter, F.struct("kind", "value")))
    rows = own.groupBy(*by, "sheet", "row").agg(at(description).alias("d"), at(category).alias("c"), at(money_in).alias("i"), at(money_out).alias("o"))
    rows = rows.where("trim(coalesce(c.value, '')) <> '' AND trim(coalesce(d.value, '')) <> ''")
    # a step each: one method of both would be beyond what the JVM compiles
    rows = apart(apart(rows, {"_i": _cents("i")}), {"_o": _cents("o")}).where("_i > 0 OR _o > 0")
    return rows.select(*by, "sheet", F.col("row").alias("pos"), F.col("d.value").alias("description"), F.col("c.value").alias("category"), F.when(F.col("_o") > 0, "out").otherwise("in").alias("flow"))


def _cents(cell: str) -> Column:
    typed, number = money.parse_cell(F.col(f"{cell}.value"))["cents"], money.to_cents(F.col(f"{cell}.value").try_cast("decimal(28,10)"))
    return F.coalesce(F.abs(F.when(F.col(f"{cell}.kind") == "text", typed).otherwise(number)), F.lit(0))


def rules_without_category(rules: DataFrame, options: DataFrame) -> DataFrame:
    """Active rules whose category the list of options lacks: they can't decide, and the report says so."""
    known = options.select(text.option_key(F.col("option")).alias("_k")).where("_k <> ''").distinct()
    return rules.where("active").withColumn("_k", text.option_key(F.coalesce("category_key", F.lit("")))).join(known, "_k", "left_anti").drop("_k")
