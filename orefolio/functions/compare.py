"""When two stated values disagree. Values are parsed once per row; only parsed forms meet in a join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import quantity_value
from .text import bind, canonical, known_term, words_of


def parsed(value: Column) -> Column:
    """STRUCT<raw, canon, joined, term, number, tokens>."""
    return bind(canonical(value), lambda canon: F.struct(
        value.alias("raw"), canon.alias("canon"), F.replace(canon, F.lit(" "), F.lit("")).alias("joined"), known_term(canon).alias("term"),
        quantity_value(value).alias("number"), F.array_distinct(words_of(canon)).alias("tokens")))


def same_figure(a: Column, b: Column) -> Column:
    """Both figures known and less than 1 % apart."""
    larger = F.greatest(F.abs(a), F.abs(b))
    return F.when((larger == 0) | (F.abs(a - b) < 1e-9), True).otherwise(F.abs(a - b) / larger < 0.01)


def values_conflict(a: Column, b: Column) -> Column:
    """True when two parsed values genuinely disagree.

    In order: a blank agrees with anything; equal canonical forms agree; forms equal without spaces agree, unless both
    state figures and these differ (so 5.25 and 52.5 disagree); two known terms agree if they are one term; two figures
    agree within 1 %; a value whose words are all in the other agrees; everything else disagrees.
    """
    both = a["number"].isNotNull() & b["number"].isNotNull()
    subset = ((F.size(a["tokens"]) > 0) & (F.size(b["tokens"]) > 0)
              & ((F.size(F.array_except(a["tokens"], b["tokens"])) == 0) | (F.size(F.array_except(b["tokens"], a["tokens"])) == 0)))
    blank = lambda x: F.coalesce(x["raw"], F.lit("")) == ""
    return (F.when(blank(a) | blank(b), False)
            .when(a["canon"] == b["canon"], False)
            .when((a["joined"] == b["joined"]) & ~(both & ~same_figure(a["number"], b["number"])), False)
            .when(a["term"].isNotNull() & b["term"].isNotNull(), a["term"] != b["term"])
            .when(both, ~same_figure(a["number"], b["number"]))
            .otherwise(~subset))


def verdict(expected: Column, actual: Column) -> Column:
    """missing, exact, equivalent or wrong; both parsed."""
    absent = F.coalesce(F.trim(actual["raw"], F.lit(" \t\n\r")), F.lit("")) == ""
    return (F.when(absent, "missing").when(expected["canon"] == actual["canon"], "exact")
            .when(~values_conflict(expected, actual), "equivalent").otherwise("wrong"))
