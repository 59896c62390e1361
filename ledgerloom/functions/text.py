"""Text normalisers as Column expressions: identity keys, names, methods, accounts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import then

#: White space beyond ASCII counts too.
SPACES = r"[\s   -     　﻿]+"
_MARKS = r"[̀-ͯ]"


def _plain_letters() -> tuple[str, str]:
    """Every Latin letter that decomposes into one base letter and marks, with that base letter."""
    found = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base != chr(code):
            found[chr(code)] = base
    return "".join(found), "".join(found.values())


_ACCENTED, _PLAIN = _plain_letters()


def _by_letters(text: Column, ascii_: Column, any_: Column) -> Column:
    """The cheap form where a text has no byte beyond ASCII: wide classes and long mappings cost most of a reader's time."""
    return F.when(F.octet_length(text) == F.char_length(text), ascii_).otherwise(any_)


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), _MARKS, "")


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _squeezed_wide(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def plain(text: Column) -> Column:
    """Without accents: composed letters, and combining marks."""
    return _by_letters(text, text, _bare(text))


def one_line(text: Column) -> Column:
    return _by_letters(text, _squeezed(text), _squeezed_wide(text))


def description(*parts: Column) -> Column:
    """Non-blank parts joined by a blank, white space collapsed."""
    return one_line(F.array_join(F.filter(F.array(*parts), lambda p: F.length(one_line(p)) > 0), " "))


def label_key(text: Column) -> Column:
    """Lower case without accents, white space collapsed: for headers and labels."""
    return _by_letters(text, _squeezed(F.lower(text)), _squeezed_wide(F.lower(_bare(text))))


def comparison_key(text: Column) -> Column:
    """Upper case without accents, white space collapsed; punctuation stays."""
    return _by_letters(text, _squeezed(F.upper(text)), _squeezed_wide(F.upper(_bare(text))))


def option_key(text: Column) -> Column:
    """Upper-case letters and digits, anything else a blank."""
    return F.trim(F.regexp_replace(F.upper(plain(text)), "[^A-Z0-9]+", " "))


# Words that end a company's name.
COMPANY_ENDINGS = ("LTDA", "ME", "MEI", "EPP", "EIRELI", "SA", "CIA", "EI", "SS")
# Words that say nothing about who a name is.
NOISE_WORDS = (
    "PIX", "TED", "DOC", "TEV", "TEF", "POS", "TRANSFERENCIA", "TRANSFERENCIAS", "TRANSF", "ENVIADO", "ENVIADA", "RECEBIDO", "RECEBIDA",
    "PAGAMENTO", "PAGTO", "PGTO", "DEBITO", "CREDITO", "MAQUININHA", "MAQUINETA", "CARTAO", "COMPRA", "SAQUE", "DE", "DA", "DO", "DAS", "DOS", "E",
    "LTDA", "ME", "MEI", "EPP", "EIRELI", "SA", "CIA", "EI", "SS",
)


def counterparty_key(text: Column) -> Column:
    """What comes before the first separator (bar, bullet, spaced dash or slash), without company endings; one word stays at least."""
    head = F.split(comparison_key(text), r"\s*(?:\||•|\s-\s|\s/\s)\s*", 2)[0]
    words = F.trim(F.regexp_replace(head, "[^A-Z0-9]+", " "))
    return F.regexp_replace(words, f"( ({'|'.join(COMPANY_ENDINGS)}))+$", "")


def same_counterparty(a: Column, b: Column) -> Column:
    ka, kb = counterparty_key(a), counterparty_key(b)
    return (ka != "") & (ka == kb)


def name_words(text: Column) -> Column:
    return F.filter(F.split(option_key(text), " "), lambda t: (t != "") & ~t.isin(*NOISE_WORDS))


def name_key(text: Column) -> Column:
    return F.array_join(name_words(text), " ")


def name_match(registered: Column, seen: Column) -> Column:
    """exact, candidate or none: all words of a registered name of two or more; a lone one or some telling one; neither.

    Both are arrays of name words.
    """
    present = F.filter(registered, lambda t: F.array_contains(seen, t))
    none = (F.size(registered) == 0) | (F.size(seen) == 0)
    whole = F.size(present) == F.size(registered)
    return (
        F.when(none, "none")
        .when(whole & (F.size(registered) >= 2), "exact")
        .when(whole | F.exists(present, lambda t: F.length(t) >= 3), "candidate")
        .otherwise("none")
    )


def title_case(name: Column) -> Column:
    return F.initcap(one_line(F.lower(name)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(plain(text)), "[^a-z0-9]+", "-"), "(^-|-$)", "")


# Institutions that are known by a short name, in this order.
INSTITUTIONS = ("stone", "pagseguro", "pagbank", "mercado pago", "nubank", "inter", "itau", "bradesco", "caixa", "santander", "banco do brasil", "sicoob", "sicredi")


def short_institution(name: Column) -> Column:
    known = F.coalesce(*[F.when(F.contains(F.lower(name), F.lit(k)), F.lit(k.replace(" ", "-"))) for k in INSTITUTIONS])
    return F.coalesce(known, F.nullif(slug(name), F.lit("")), F.lit("conta"))


def account_ref(institution: Column, number: Column) -> Column:
    """struct(id, label) of an account."""
    name, digits = F.coalesce(institution, F.lit("")), F.regexp_replace(F.coalesce(number, F.lit("")), SPACES, "")
    ident = F.when(digits == "", short_institution(name)).otherwise(F.concat_ws("-", short_institution(name), F.regexp_replace(digits, r"\D", "")))
    tail = F.when(digits == "", F.lit("")).otherwise(F.concat(F.lit("Conta "), digits))
    label = F.when(name == "", F.coalesce(F.nullif(tail, F.lit("")), F.lit("Conta"))).when(tail == "", name).otherwise(F.concat_ws(" - ", name, tail))
    return F.struct(ident.alias("id"), label.alias("label"))


# The payment method of a kind of movement; the first pattern that matches its key.
METHODS = (
    ("^pix$", "Pix"), ("^transacao$", "Maquininha"), ("maquin", "Maquininha"), ("recebivel de cartao|cartao", "Cartão"), ("entre contas|antecipa", "Antecipação"),
    ("recarga", "Recarga"), ("boleto", "Boleto"), ("^ted$|^doc$", "Transferência"),
)
# Counterparties that name nobody.
NOBODY = ("", "desconhecido", "desconhecida", "-", "nao informado", "stone principal")


def method_of(kind: Column, key: Column | None = None) -> Column:
    """key: the label_key of kind, if a step before has it."""
    key = label_key(kind) if key is None else key
    return F.when(key == "", "").otherwise(F.coalesce(*[F.when(key.rlike(p), F.lit(m)) for p, m in METHODS], F.trim(kind)))


def compose_description(method: Column, counterparty: Column, incoming: Column) -> Column:
    """`Method - NAME`; a name that repeats the method loses it; nobody is a sale received, or the method alone."""
    name = one_line(F.coalesce(counterparty, F.lit("")))
    return _composed(method, label_key(method), name, label_key(name), incoming)


def described(rows: DataFrame, method: str, counterparty: str, incoming: str, out: str = "description") -> DataFrame:
    """rows with compose_description of three columns, each of its steps computed once."""
    columns = [c for c in rows.columns if c != out]
    rows = then(rows, {"_mkey": label_key(F.col(method)), "_name": one_line(F.coalesce(F.col(counterparty), F.lit("")))}, *columns)
    rows = then(rows, {"_nkey": label_key(F.col("_name"))})
    return then(rows, {out: _composed(F.col(method), F.col("_mkey"), F.col("_name"), F.col("_nkey"), F.col(incoming))}, *columns)


def _composed(method: Column, method_key: Column, name: Column, name_key: Column, incoming: Column) -> Column:
    name = F.when(name_key.isin(*NOBODY), F.lit("")).otherwise(name)
    rest = F.trim(F.substring(name, F.length(method) + 1, F.length(name)))
    repeats = (method != "") & F.startswith(name_key, F.concat(method_key, F.lit(" "))) & (rest != "")
    name = F.when(repeats, rest).otherwise(name)
    with_method = lambda x: F.when(method != "", F.concat(method, F.lit(" - "), x)).otherwise(x)
    alone = F.when(method != "", method).otherwise(F.lit("Lançamento"))
    return F.when(name != "", with_method(name)).otherwise(F.when(incoming, with_method(F.lit("Recebimento vendas"))).otherwise(alone))


def instrument_method(instrument: Column) -> Column:
    """Method of the part of a memo after its last spaced dash, `first | second`."""
    return _method_of_parts(_instrument_parts(instrument), instrument)


def _instrument_parts(instrument: Column) -> Column:
    return F.transform(F.split(instrument, r"\|"), lambda p: F.trim(F.lower(plain(p))))


def _method_of_parts(parts: Column, instrument: Column) -> Column:
    a, b = parts[0], F.coalesce(F.get(parts, 1), F.lit(""))
    has = lambda c, x: F.contains(c, F.lit(x))
    return (
        F.when(has(a, "maquinin") | has(b, "maquinin"), "Maquininha")
        .when(has(a, "antecipa") | has(b, "antecipa"), "Antecipação")
        .when((a == "pix") | (b == "pix"), "Pix")
        .when(b.isin("debito", "credito"), "Cartão")
        .when(has(a, "recarga"), "Recarga")
        .when(has(a, "boleto"), "Boleto")
        .when(has(a, "transferencia"), "Transferência")
        .otherwise(F.trim(instrument))
    )


def memo_described(rows: DataFrame, memo: str, incoming: str, out: str = "description") -> DataFrame:
    """rows with memo_description of two columns, each of its steps computed once."""
    columns = [c for c in rows.columns if c != out]
    rows = then(rows, {"_text": one_line(F.coalesce(F.col(memo), F.lit("")))}, *columns)
    rows = then(rows, {"_who": F.trim(F.regexp_extract("_text", "^(.*) - (.*)$", 1)), "_how": F.trim(F.regexp_extract("_text", "^(.*) - (.*)$", 2))})
    rows = then(rows, {"_parts": _instrument_parts(F.col("_how"))})
    rows = then(rows, {"_method": _method_of_parts(F.col("_parts"), F.col("_how"))})
    rows = described(rows, "_method", "_who", incoming, "_full")
    empty = F.when(F.col(incoming), "Recebimento vendas").otherwise("Lançamento")
    short = F.when(F.col("_text") == "", empty).when(~F.contains("_text", F.lit(" - ")) | (F.col("_method") == ""), F.col("_text"))
    return rows.select(*columns, F.coalesce(short, "_full").alias(out))


def memo_description(memo: Column, incoming: Column) -> Column:
    text = one_line(F.coalesce(memo, F.lit("")))
    name, instrument = (F.trim(F.regexp_extract(text, "^(.*) - (.*)$", i)) for i in (1, 2))
    method = instrument_method(instrument)
    empty = F.when(incoming, "Recebimento vendas").otherwise("Lançamento")
    return F.when(text == "", empty).when(~F.contains(text, F.lit(" - ")) | (method == ""), text).otherwise(compose_description(method, name, incoming))


# Weights of wide, capital and narrow characters.
_WIDE, _CAPITAL, _NARROW = "MWmw@%＿", "ABCDEFGHKNOPQRSUVXYZÁÂÃÀÉÊÍÓÔÕÚÇ", "iljtIf.,:;'`|![]() "


def text_width(text: Column) -> Column:
    """Width in characters, by glyph."""
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    rest = F.length(F.translate(text, _WIDE + _CAPITAL + _NARROW, ""))
    return F.round(count(_WIDE) * 1.4 + count(_CAPITAL) * 1.15 + count(_NARROW) * 0.55 + rest, 2)


def column_number(letters: Column) -> Column:
    """A is 1, Z 26, AA 27."""
    return F.aggregate(F.split(F.upper(letters), "(?<=.)(?=.)"), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)


def column_letters(number: Column) -> Column:
    n = number - 1
    last = lambda x: F.char(F.lit(65) + F.pmod(x, F.lit(26)))
    up = lambda x: F.floor(x / 26) - 1
    two, three = up(n), up(up(n))
    return F.concat(F.when(three >= 0, last(three)).otherwise(""), F.when(two >= 0, last(two)).otherwise(""), last(n))


def unescape_xml(text: Column) -> Column:
    out = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def escape_xml(text: Column) -> Column:
    """Text or attribute: what it can't hold as it is, as entities; the ampersand first."""
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")


def sheet_link_id(link: Column) -> Column:
    return F.nullif(F.regexp_extract(link, r"/d/([A-Za-z0-9_-]+)", 1), F.lit(""))
