"""Categories by rules: the user's, the house's, and rules mined from history.

rules: rule_id, active, label, direction (in, out), name, terms array, min_cents, max_cents, exceptions array,
category_key, account_id, aliases_yes array, aliases_no array, priority, pos (place in the list).
tx: tx_id, description, flow (in, out), amount_cents, account_id. options: option, pos.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text
from ..functions.steps import stored

RULES = (
    "rule_id string, active boolean, label string, direction string, name string, terms array<string>, min_cents bigint, max_cents bigint, exceptions array<string>, "
    "category_key string, account_id string, aliases_yes array<string>, aliases_no array<string>, priority int, pos int"
)
#: Rules that meet each transaction one by one, and options that are broadcast, at most; more rules are found by an automaton.
FEW_RULES = 1_000
#: Probes of one automaton, and rules that are broadcast, at most.
MOST_PROBES = 200_000


@dataclass(frozen=True)
class HouseRule:
    id: str
    flow: str
    triggers: tuple[str, ...]
    exceptions: tuple[str, ...]
    options: tuple[str, ...]
    fallback: tuple[str, str]


# Words of the two house rules and the options they choose, in order.
HOUSE_RULES = (
    HouseRule(
        "sale-received", "in",
        ("PIX", "MAQUININHA", "MAQUINETA", "MAQUINA DE CARTAO", "CARTAO", "POS", "TEF", "ANTECIPACAO", "VENDA", "VENDAS"),
        ("APORTE", "EMPRESTIMO", "EMPRESTIMOS", "FINANCIAMENTO", "ESTORNO", "ESTORNADO", "ESTORNADA", "DEVOLUCAO", "DEVOLVIDO", "DEVOLVIDA", "REEMBOLSO", "RESGATE", "RENDIMENTO", "RENDIMENTOS", "JUROS", "CASHBACK", "TROCO", "ENTRE CONTAS", "CONTA PROPRIA", "MESMA TITULARIDADE", "SALDO ANTERIOR", "SALDO INICIAL"),
        ("RECEBIMENTO DE VENDA", "RECEBIMENTO DE VENDAS", "RECEBIMENTOS DE VENDA", "RECEBIMENTOS DE VENDAS", "RECEBIMENTO VENDA", "RECEITA DE VENDA", "RECEITA DE VENDAS", "VENDA", "VENDAS", "VENDA DE MERCADORIAS", "FATURAMENTO"),
        (r"\bVENDAS?\b", "RECEBIMENTO|RECEITA|FATURAMENTO"),
    ),
    HouseRule(
        "bank-fee", "out",
        ("TARIFA", "TARIFAS", "TAXA D[AEO] CARTAO", "TAXA CARTAO", "TAXA D[AEO] MAQUININHA", "TAXA D[AEO] ANTECIPACAO"),
        ("IFOOD", "I FOOD", "RAPPI", "UBER", "DAS", "SIMPLES NACIONAL", "INSS", "FGTS", "ENERGIA", "AGUA", "ESGOTO", "INTERNET", "ALUGUEL", "CONDOMINIO", "LIXO", "ILUMINACAO", "BOMBEIRO", "ALVARA", "CARTORIO"),
        ("TAXA DE CARTAO", "TAXA CARTAO", "TAXAS DE CARTAO", "TARIFA BANCARIA", "TARIFAS BANCARIAS", "DESPESAS BANCARIAS", "TAXA BANCARIA"),
        (r"\bTAXAS?\b", "CARTAO|BANCARIA|BANCARIAS|BANCO"),
    ),
)


def _any_word(words: tuple[str, ...]) -> str:
    return rf"\b(?:{'|'.join(words)})\b"


def house_options(options: DataFrame) -> DataFrame:
    """house, option: the spelling that the list of options has for each house rule; none if it has none. One pass, one row a rule."""
    key = text.option_key(F.col("option"))
    ranked = []
    for rule in HOUSE_RULES:
        named = F.array_position(F.array(*[F.lit(o) for o in rule.options]), key)
        rank = F.when(named > 0, named).when(key.rlike(rule.fallback[0]) & key.rlike(rule.fallback[1]), len(rule.options) + 1)
        best = F.min_by("option", F.when(rank.isNotNull(), F.struct(rank, F.col("pos"))))
        ranked.append(options.agg(F.lit(rule.id).alias("house"), F.when(F.max(rank).isNotNull(), best).alias("option")))
    return ranked[0].unionByName(ranked[1]).where("option is not null")


def house_rule(description: Column, flow: Column) -> Column:
    """Id of the first house rule that applies, or null: JVM patterns, no join."""
    key = text.option_key(description)
    hits = [F.when((flow == r.flow) & ~key.rlike(_any_word(r.exceptions)) & key.rlike(_any_word(r.triggers)), F.lit(r.id)) for r in HOUSE_RULES]
    return F.coalesce(*hits)


def with_house_option(tx: DataFrame, options: DataFrame) -> DataFrame:
    """tx with house and house_option."""
    known = F.broadcast(house_options(options).select("house", F.col("option").alias("house_option")))  # two rows at most
    return tx.withColumn("house", house_rule(F.col("description"), F.col("flow"))).join(known, "house", "left")


def canonical_options(answers: DataFrame, options: DataFrame, last: bool = False) -> DataFrame:
    """answers (answer) with the exact option of the same key; of several the first (or last) in the list."""
    pick = F.max_by if last else F.min_by
    by_key = options.groupBy(text.option_key(F.col("option")).alias("_k")).agg(pick("option", "pos").alias("option")).where("_k <> ''")
    return answers.withColumn("_k", text.option_key(F.coalesce("answer", F.lit("")))).join(by_key, "_k", "left").drop("_k")


def problems(rules: DataFrame) -> DataFrame:
    """rules with problems, an array of what is wrong; empty for a valid rule."""
    name = text.name_key(F.coalesce("name", F.lit("")))
    terms = F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: text.option_key(t) != "")
    ranged = F.col("min_cents").isNotNull() | F.col("max_cents").isNotNull()
    found = F.array(
        F.when(F.coalesce("rule_id", F.lit("")) == "", "no identifier"),
        F.when(~F.coalesce(F.col("direction").isin("in", "out"), F.lit(False)), "direction must be in or out"),
        F.when(text.option_key(F.coalesce("category_key", F.lit(""))) == "", "no category"),
        F.when((name == "") & (F.size(terms) == 0) & ~ranged, "no condition"),
        F.when((F.coalesce("name", F.lit("")) != "") & (name == ""), "generic words only"),
        F.when((name != "") & (F.length(F.replace(name, F.lit(" "), F.lit(""))) < 3), "name too short"),
        F.when(F.col("min_cents") > F.col("max_cents"), "range reversed"),
        F.when(ranged & (name == "") & (F.size(terms) == 0), "range alone"),
    )
    return rules.withColumn("problems", F.filter(found, lambda p: p.isNotNull()))


def matches(tx: DataFrame, rules: DataFrame, few: int = FEW_RULES, most: int = MOST_PROBES) -> DataFrame:
    """tx_id, rule_id, kind (exact, candidate), alias, weight, pos, category_key: rules that apply, candidates among them."""
    rules = problems(rules).where("active and size(problems) = 0")
    keys = lambda xs: F.transform(F.coalesce(F.col(xs), F.array().cast("array<string>")), text.option_key)
    r = rules.select(
        "rule_id", "direction", "label", "category_key", "pos", F.col("account_id").alias("r_account"), "min_cents", "max_cents",
        text.name_words(F.coalesce("name", F.lit(""))).alias("r_words"), keys("terms").alias("r_terms"), F.filter(keys("exceptions"), lambda x: x != "").alias("r_not"),
        F.coalesce("aliases_yes", F.array().cast("array<string>")).alias("yes"), F.coalesce("aliases_no", F.array().cast("array<string>")).alias("no"),
        F.coalesce("priority", F.lit(0)).alias("priority"),
    )
    t = tx.select("tx_id", "flow", "amount_cents", "account_id", text.option_key(F.col("description")).alias("k"), text.name_words(F.col("description")).alias("words"))
    t = t.withColumn("alias", F.array_join("words", " "))
    ranged = F.col("min_cents").isNotNull() | F.col("max_cents").isNotNull()
    in_range = F.coalesce(F.col("amount_cents") >= F.col("min_cents"), F.col("min_cents").isNull()) & F.coalesce(F.col("amount_cents") <= F.col("max_cents"), F.col("max_cents").isNull())
    on = (
        (F.col("flow") == F.col("direction"))
        & (F.col("r_account").isNull() | F.col("account_id").isNull() | (F.col("r_account") == F.col("account_id")))
        & (~ranged | (F.col("amount_cents").isNotNull() & in_range))
        & ~F.exists("r_not", lambda x: F.contains(F.col("k"), x))
        & F.forall("r_terms", lambda x: (x != "") & F.contains(F.col("k"), x))
    )
    named = F.size("r_words") > 0
    kind = (
        F.when(~named, "exact")
        .when(F.array_contains("no", F.col("alias")), "none")
        .when(F.array_contains("yes", F.col("alias")), "exact")
        .otherwise(text.name_match(F.col("r_words"), F.col("words")))
    )
    weight = F.size("r_words") * 10 + F.size("r_terms") * 5 + F.when(ranged, 3).otherwise(0) + F.when(F.col("r_account").isNotNull(), 1).otherwise(0) + F.col("priority") * 100
    met = _met(t, r, on, few, most).withColumns({"kind": kind, "weight": weight}).where("kind <> 'none'")
    return met.select("tx_id", "rule_id", "label", "kind", "alias", "weight", "pos", "category_key")


def _met(t: DataFrame, r: DataFrame, on: Column, few: int, most: int = MOST_PROBES) -> DataFrame:
    """Pairs of transactions and rules that may apply. Few rules are broadcast. Many are found by an automaton of what a transaction must
    have for them: of a rule with a name any word of the name or its aliases, of another one its longest term. One pass over a description
    meets all rules; only pairs whose probe is there go on to be judged. Of more than `most` probes automata of so many each are run one
    after the other, by ranges of the probes' hashes, so that no task holds more."""
    if r.count() <= few:
        return t.join(F.broadcast(r), on)
    r = stored(r)
    n_rules = r.count()
    words = lambda c: F.filter(F.flatten(F.transform(c, lambda x: F.split(x, " "))), lambda x: x != "")
    longest = F.array_max(F.transform("r_terms", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    # words stand between blanks; a rule with an empty term never applies, and one with neither name nor term is not valid
    under = F.when(F.size("r_words") > 0, F.transform(F.array_distinct(F.concat("r_words", words(F.col("yes")))), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))).otherwise(F.array(longest))
    probes = stored(r.select("rule_id", "pos", F.explode(under).alias("probe")).where("probe <> ''").groupBy("probe").agg(F.collect_set(F.struct("rule_id", "pos")).alias("rules")).withColumn("h", F.pmod(F.xxhash64("probe"), F.lit(1 << 30))))
    parts = max(1, -(-probes.count() // most))
    edges = [(1 << 30) * i // parts for i in range(parts + 1)]
    found = None
    for lo, hi in zip(edges, edges[1:]):
        part = _found_by(t, [r_["probe"] for r_ in probes.where(F.col("h").between(lo, hi - 1)).select("probe").collect()])
        found = part if found is None else found.unionByName(part)
    # a probe that thousands of rules share stands once in the automaton; its rules come by a join
    waiting = probes.select("probe", F.explode("rules").alias("x")).select(F.col("probe").alias("_probe"), F.col("x.rule_id").alias("_rule"), F.col("x.pos").alias("_pos"))
    few_enough = n_rules <= most
    waiting, own = (F.broadcast(waiting), F.broadcast(r)) if few_enough else (waiting, r)
    pairs = found.join(waiting, "_probe").join(own, (F.col("_rule") == F.col("rule_id")) & (F.col("_pos") == F.col("pos")) & on)
    return pairs.drop("_probe", "_rule", "_pos").dropDuplicates(["tx_id", "rule_id", "pos"])


def _found_by(t: DataFrame, probes: list[str]) -> DataFrame:
    """t with each probe that its key has, as _probe: one pass over the key for all of them."""
    automaton = ahocorasick.Automaton()
    for p in probes:
        automaton.add_word(p, p)
    automaton.make_automaton()
    held = t.sparkSession.sparkContext.broadcast(automaton) if probes else None
    at = t.columns.index("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, what = [], []
            for i, key in enumerate(batch.column(at).to_pylist() if held else []):
                for p in {p for _, p in held.value.iter(f" {key} ")} if key is not None else ():
                    where.append(i)
                    what.append(p)
            if where:
                own = batch.take(pa.array(where))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(what, pa.string())], [*batch.schema.names, "_probe"])

    return t.mapInArrow(run, StructType([*t.schema.fields, StructField("_probe", StringType())]))


def decide(tx: DataFrame, rules: DataFrame, options: DataFrame, house: bool = True) -> DataFrame:
    """tx with option, decided_by (user, house or null), rule_id, pending and conflicts (arrays of rule ids), against_house.

    An exact rule of the user decides, the heaviest one, the earlier on a tie. A candidate holds the decision back, house
    rules too. Else a house rule decides.
    """
    by_key = options.groupBy(text.option_key(F.col("option")).alias("_k")).agg(F.min_by("option", "pos").alias("_option"))
    if options.count() <= FEW_RULES:
        by_key = F.broadcast(by_key)
    found = matches(tx, rules).withColumn("_k", text.option_key(F.col("category_key"))).join(by_key, "_k")
    rank = F.struct(-F.col("weight"), F.col("pos"))
    exact = F.col("kind") == "exact"
    each = found.groupBy("tx_id").agg(
        F.min_by(F.when(exact, F.struct("rule_id", "_option")), F.when(exact, rank)).alias("best"),
        F.array_sort(F.collect_list(F.when(exact, F.struct((-F.col("weight")).alias("w"), "pos", "rule_id", "_option")))).alias("exacts"),
        F.array_sort(F.collect_list(F.when(~exact, F.struct("pos", "rule_id")))).alias("candidates"),
    )
    rows = with_house_option(tx, options) if house else tx.withColumns({"house": F.lit(None).cast("string"), "house_option": F.lit(None).cast("string")})
    rows = rows.join(each, "tx_id", "left")
    user, waits = F.col("best._option"), F.coalesce(F.size("candidates"), F.lit(0)) > 0
    option = F.when(user.isNotNull(), user).when(~waits, F.col("house_option"))
    decider = F.when(user.isNotNull(), "user").when(~waits & F.col("house_option").isNotNull(), "house")
    conflicts = F.transform(F.filter("exacts", lambda e: e["_option"] != user), lambda e: e["rule_id"])
    empty = F.array().cast("array<string>")
    return rows.withColumns(
        {
            "option": option, "decided_by": decider, "rule_id": F.col("best.rule_id"),
            "pending": F.coalesce(F.transform("candidates", lambda c: c["rule_id"]), empty), "conflicts": F.coalesce(conflicts, empty),
            "against_house": F.coalesce(user.isNotNull() & F.col("house_option").isNotNull() & (F.col("house_option") != user), F.lit(False)),
        }
    ).drop("best", "exacts", "candidates", "house", "house_option")


def identity_questions(found: DataFrame) -> DataFrame:
    """A row a rule: the distinct names that may or may not be its own, sorted."""
    return found.where("kind = 'candidate'").groupBy("rule_id").agg(F.array_sort(F.collect_set("alias")).alias("candidates"))


def apply_answers(rules: DataFrame, answers: DataFrame) -> DataFrame:
    """answers: rule_id, name, applies, pos. The last answer of a name decides which list of aliases it is in."""
    named = answers.withColumn("alias", text.name_key(F.col("name"))).where("alias <> ''")
    last = named.groupBy("rule_id", "alias").agg(F.max_by("applies", "pos").alias("applies"))
    lists = last.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.when(F.col("applies"), F.col("alias")))).alias("_yes"), F.array_sort(F.collect_list(F.when(~F.col("applies"), F.col("alias")))).alias("_no"))
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    out = rules.join(lists, "rule_id", "left")
    return out.withColumns(
        {"aliases_yes": F.array_union(F.array_except(some("aliases_yes"), some("_no")), some("_yes")), "aliases_no": F.array_union(F.array_except(some("aliases_no"), some("_yes")), some("_no"))}
    ).drop("_yes", "_no")


def mine(history: DataFrame, least: int = 3, most: int = 20, rules: DataFrame | None = None, dismissed: DataFrame | None = None, options: DataFrame | None = None) -> DataFrame:
    """Suggestions from history (description, category, flow, sheet, pos): names of two words or more that always have one category.

    Groups are summed map-side; the examples of a name are its first three distinct descriptions, kept as minima of positions.
    """
    words = text.name_words(F.col("description"))
    seen = history.where("trim(coalesce(category, '')) <> ''").withColumn("_w", words).where(F.size("_w") >= 2).withColumn("name", F.array_join("_w", " "))
    total = seen.groupBy("flow", "name").agg(
        F.count("*").alias("n"), F.min("category").alias("category"), F.max("category").alias("_other"), F.count_distinct("sheet").alias("n_sheets")
    )
    found = total.where((F.col("n") >= max(2, least)) & (F.col("category") == F.col("_other"))).drop("_other")
    distinct = seen.groupBy("flow", "name", "description").agg(F.min("pos").alias("pos"))
    nth = F.row_number().over(W.partitionBy("flow", "name").orderBy("pos"))
    examples = distinct.withColumn("_n", nth).where("_n <= 3").groupBy("flow", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "description"))), lambda e: e["description"]).alias("examples"))
    found = found.join(examples, ["flow", "name"])
    if dismissed is not None:
        found = found.join(dismissed.select("flow", "name"), ["flow", "name"], "left_anti")
    if rules is not None:
        known = rules.where("active and coalesce(name, '') <> ''").select(F.col("direction").alias("_d"), text.name_words(F.col("name")).alias("_r")).where("size(_r) > 0")
        # a rule that covers a name has its first word among the name's: they meet on that word
        said = found.select("flow", "name", F.explode(F.array_distinct(F.split("name", " "))).alias("_w"))
        ruled = known.withColumn("_w", F.col("_r")[0])
        covered = said.join(ruled, (said["_w"] == ruled["_w"]) & (said["flow"] == ruled["_d"])).where(F.size(F.array_except("_r", F.split("name", " "))) == 0)
        found = found.join(covered.select("flow", "name").distinct(), ["flow", "name"], "left_anti")
    if options is not None:
        asked = found.withColumn("description", F.col("examples")[0])
        found = with_house_option(asked, options).where("house_option is null or house_option <> category").withColumn("against_house", F.col("house_option").isNotNull()).drop("description", "house", "house_option")
    return found.orderBy(F.desc("n"), "name", "flow").limit(most)


def rule_of_suggestion(suggestions: DataFrame) -> DataFrame:
    return suggestions.select(
        F.concat_ws("|", "flow", "name").alias("rule_id"), F.concat_ws(" – ", F.trim("category"), text.title_case(F.col("name"))).alias("label"),
        F.col("flow").alias("direction"), "name", text.option_key(F.col("category")).alias("category_key"),
    )


def removed(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """Rules without those of these ids (rule_id); the order of the others stays."""
    return rules.join(ids.select("rule_id").distinct(), "rule_id", "left_anti")


def upsert(rules: DataFrame, changed: DataFrame) -> DataFrame:
    """Rules with those of changed put in by id: in place where the id is known, at the end else; of a repeated id the first stays."""
    first = lambda d: d.withColumn("_n", F.row_number().over(W.partitionBy("rule_id").orderBy("pos"))).where("_n = 1").drop("_n")
    old, new = first(rules), first(changed)
    places = old.select("rule_id", F.col("pos").alias("_pos"))
    end = old.agg(F.coalesce(F.max("pos") + 1, F.lit(0)).alias("_end"))
    put = new.join(places, "rule_id", "left").crossJoin(F.broadcast(end)).withColumn("pos", F.coalesce("_pos", F.col("pos") + F.col("_end")).cast("int")).drop("_pos", "_end")
    return old.join(new.select("rule_id"), "rule_id", "left_anti").unionByName(put)
