"""Text functions beside Spark's own: upper and lower case by language, matching without case by language, quoting, formatting, dictionaries for search terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages in which the dotted and the dotless i are two letters.
DOTTED = ("tr", "az")


def upper(text: Column, lang: str = "en") -> Column:
    return F.upper(F.translate(text, "iı", "İI") if lang in DOTTED else text)


def lower(text: Column, lang: str = "en") -> Column:
    return F.lower(F.translate(text, "Iİ", "ıi") if lang in DOTTED else text)


def initcap(text: Column, lang: str = "en") -> Column:
    """The first letter of each word in upper case, the others in lower case."""
    words = F.split(lower(text, lang), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(upper(F.substring(w, 1, 1), lang), F.substring(w, F.lit(2), F.length(w)))), " ")


def ilike(text: Column, pattern: str, lang: str = "en") -> Column:
    """LIKE without regard to case, as the language has it."""
    return F.like(lower(text, lang), lower(F.lit(pattern), lang))


def quote_literal(value: Column) -> Column:
    """A value as it stands in SQL: in single quotes, those inside doubled; null is NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def quote_ident(name: Column) -> Column:
    """A name as it stands in SQL: in double quotes unless it is plain and lower-case."""
    return F.when(name.rlike("^[a-z_][a-z0-9_$]*$"), name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def format_text(template: str, *values: Column) -> Column:
    """Values put into a template: %s as they are, %L as literals, %I as names, %n$s and the like by number, %% for a percent sign. A null is empty for %s."""
    import re

    parts: list[Column] = []
    at = turn = 0
    for m in re.finditer(r"%(?:(\d+)\$)?([sIL%])", template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[2] == "%":
            parts.append(F.lit("%"))
            continue
        turn = int(m[1]) if m[1] else turn + 1
        v = values[turn - 1]
        parts.append({"s": F.coalesce(v.cast("string"), F.lit("")), "I": quote_ident(v), "L": quote_literal(v)}[m[2]])
    return F.concat(*parts, F.lit(template[at:]))


def short_numbers(terms: Column, most: int = 6, reject: bool = False) -> Column:
    """Terms that are numbers, cut to so many digits (or dropped if longer)."""
    number = r"^[+-]?[0-9]+$"
    if reject:
        return F.filter(terms, lambda t: ~t.rlike(number) | (F.length(t) <= most))
    return F.transform(terms, lambda t: F.when(t.rlike(number), F.substring(t, 1, most)).otherwise(t))


def synonyms(terms: Column, groups: dict[str, list[str]], keep: bool = True) -> Column:
    """Each term followed by its synonyms, or by them alone if `keep` is false; terms without synonyms stay."""
    held = F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.transform(terms, lambda t: F.coalesce(F.concat(F.array(t), held[t]) if keep else held[t], F.array(t))))


def headline(text: Column, words: list[str], begin: str = "<b>", end: str = "</b>") -> Column:
    """The text with every whole occurrence of the words between two marks, whatever its case."""
    import re

    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({'|'.join(map(re.escape, words))})(?![\p{{L}}\p{{N}}])", f"{begin}$1{end}")


def enum_position(value: Column, labels: list[str]) -> Column:
    """The place of a value in the order in which the labels are declared, from 1 on; another value fails the query, null stays null."""
    at = F.array_position(F.array(*map(F.lit, labels)), value).cast("int")
    return F.when(at > 0, at).when(value.isNotNull(), F.raise_error(F.concat(F.lit("no such label: "), value)).cast("int"))
