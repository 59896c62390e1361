"""Categories step by step: rules, a port that tells whether two names are one, rules again, a port that classifies, and the summary.

Both ports are functions of a list of items, given by the caller and off by default. They get batches of a partition's items and answer by
index; an answer to a question that wasn't asked, or a second one, doesn't count. A batch that fails says nothing: it isn't a "no".
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.steps import stored
from ..functions import text
from . import rules as rule_operators

#: items of a batch -> (index, answer) pairs
Port = Callable[[list[dict]], list[tuple[int, object]]]
BATCH = 60


def asked_in_batches(items: DataFrame, port: Port, kind: str, batch: int = BATCH) -> DataFrame:
    """items with answer (of the given type) and failure: the answers of the port to batches of at most `batch` items of a partition.
    Items without an answer have null; those of a batch that failed have what went wrong."""
    names = items.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                answers: dict[int, object] = {}
                failure = None
                try:
                    for index, answer in port([{"index": i, **r} for i, r in enumerate(part.to_dict("records"))]):
                        if 0 <= index < len(part):
                            answers.setdefault(index, answer)
                except Exception as e:  # the rows go on without an answer
                    answers, failure = {}, f"{type(e).__name__}: {e}"
                yield part.assign(answer=[answers.get(i) for i in range(len(part))], failure=failure)[[*names, "answer", "failure"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields) + f", answer {kind}, failure string"
    return items.mapInPandas(run, schema)


def confirm_identities(found: DataFrame, port: Port) -> DataFrame:
    """rule_id, name, applies, pos, failure of the names that rules are in doubt about (found: of rules.matches)."""
    questions = rule_operators.identity_questions(found).select("rule_id", F.explode("candidates").alias("name"))
    labels = found.groupBy("rule_id").agg(F.min("label").alias("label"))
    asked = asked_in_batches(questions.join(labels, "rule_id"), port, "boolean")
    return asked.select("rule_id", "name", F.col("answer").alias("applies"), F.lit(0).alias("pos"), "failure")


def classify(rows: DataFrame, options: DataFrame, port: Port) -> DataFrame:
    """tx_id, option, failure: each distinct direction and description is asked about once, and the answer, if the list has it, goes to all of its rows."""
    keyed = rows.select("tx_id", "flow", "description", "amount_cents", text.comparison_key(F.col("description")).alias("_key"))
    groups = keyed.groupBy("flow", "_key").agg(F.min_by("description", "tx_id").alias("description"), F.min_by("amount_cents", "tx_id").alias("amount_cents"))
    answers = rule_operators.canonical_options(asked_in_batches(groups, port, "string"), options, last=True)
    return keyed.join(answers.select("flow", "_key", "option", "failure"), ["flow", "_key"]).select("tx_id", "option", "failure")


def categorise(tx: DataFrame, rules: DataFrame, options: DataFrame, identity: Port | None = None, classifier: Port | None = None, house: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decisions (tx with option, decided_by: user, house, model or null, rule_id, via_agent, pending, conflicts, against_house), the rules
    with what was learnt of names, and failures (stage, failure).

    Only rows that waited for an answer are decided again. Answers are written, so that no action over the result and no lost executor asks twice.
    """
    first = rule_operators.decide(tx, rules, options, house)
    failures = tx.sparkSession.createDataFrame([], "stage string, failure string")
    decided = first.withColumn("via_agent", F.lit(False))
    if identity is not None:
        found = rule_operators.matches(tx, rules)
        answers = stored(confirm_identities(found, identity))
        failures = failures.unionByName(answers.where("failure is not null").select(F.lit("identity").alias("stage"), "failure").distinct())
        told = answers.where("applies is not null")
        rules = rule_operators.apply_answers(rules, told)
        waited = first.where(F.size("pending") > 0)
        again = rule_operators.decide(waited.select(*tx.columns), rules, options, house)
        yes = told.where("applies").select("rule_id", F.col("name").alias("_name")).withColumn("_yes", F.lit(True))
        doubt = waited.select("tx_id", F.explode("pending").alias("rule_id"))
        again = again.withColumn("_name", text.name_key(F.col("description"))).join(yes, ["rule_id", "_name"], "left").join(doubt.withColumn("_asked", F.lit(True)), ["tx_id", "rule_id"], "left")
        again = again.withColumn("via_agent", F.coalesce((F.col("decided_by") == "user") & F.col("_yes") & F.col("_asked"), F.lit(False)))
        decided = decided.where(F.size("pending") == 0).unionByName(again.select(*decided.columns))
    if classifier is not None:
        found = stored(classify(decided.where("option is null"), options, classifier))
        failures = failures.unionByName(found.where("failure is not null").select(F.lit("classifier").alias("stage"), "failure").distinct())
        told = found.where("option is not null").select("tx_id", F.col("option").alias("_told"))
        decided = decided.join(told, "tx_id", "left").withColumns({"decided_by": F.coalesce("decided_by", F.when(F.col("_told").isNotNull(), "model")), "option": F.coalesce("option", "_told")}).drop("_told")
    return decided, rules, failures


def decision_summary(decided: DataFrame) -> DataFrame:
    """One row: how many transactions the user's rules decided, those by a confirmed name among them, the house's, the model, and none."""
    by = lambda who: F.count_if(F.coalesce(F.col("decided_by") == who, F.lit(False)))
    return decided.agg(by("user").alias("by_user"), F.count_if("via_agent").alias("by_agent"), by("house").alias("by_house"), by("model").alias("by_model"), F.count_if(F.col("option").isNull()).alias("without"))
