"""Reporting periods: (year, quarter) read from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import (EDGE_BEFORE, EN_MONTHS, HI_MONTHS, HI_ORDINAL, HI_ORDINALS, HI_QUARTER, TE_MONTHS, TE_ORDINAL, TE_ORDINALS,
                      TE_QUARTER, either, fold_digits)
from .text import bind

EDGE_AFTER = r"(?![\p{L}\p{N}_])"


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _by_map(key: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _quarter_of_month(month: Column) -> Column:
    return F.floor((month - 1) / 3 + 1).cast("int")


def _quarter(text: Column) -> Column:
    return F.coalesce(
        _found(text, rf"(?i){EDGE_BEFORE}Q([1-4]){EDGE_AFTER}").cast("int"),
        _by_map(_found(text, rf"({HI_ORDINAL})(?U:\s)*{HI_QUARTER}"), {x: n for n, v in HI_ORDINALS.items() for x in v}),
        _found(text, rf"{HI_QUARTER}(?U:\s)*([1-4])").cast("int"),
        _by_map(_found(text, rf"({TE_ORDINAL})(?U:\s)*{TE_QUARTER}"), {x: n for n, v in TE_ORDINALS.items() for x in v}),
        _found(text, rf"{TE_QUARTER}(?U:\s)*([1-4])").cast("int"),
        _quarter_of_month(_by_map(F.lower(_found(text, rf"(?i){EDGE_BEFORE}({'|'.join(EN_MONTHS)})[a-z]*{EDGE_AFTER}")),
                                  {m: k for k, m in enumerate(EN_MONTHS, 1)})),
        _quarter_of_month(_by_map(_found(text, f"({either(HI_MONTHS)})"), HI_MONTHS)),
        _quarter_of_month(_by_map(_found(text, f"({either(TE_MONTHS)})"), TE_MONTHS)))


def period_of(c: Column) -> Column:
    """STRUCT<year INT, quarter INT>, quarter null when unknown, the whole null when no year can be read.

    Rules in order: ISO year-month, then with a year anywhere: Qn, Hindi ordinal or number, Telugu ordinal or number,
    English, Hindi or Telugu month. A fiscal year such as "2011-12" reads as December 2011.
    """
    def read(text: Column) -> Column:
        iso = EDGE_BEFORE + r"((?:19|20)\p{Nd}{2})[-/](\p{Nd}{1,2})"
        year = _found(text, EDGE_BEFORE + r"((?:19|20)\p{Nd}{2})" + EDGE_AFTER)
        return F.struct(_found(text, iso).cast("int").alias("iso_year"), _found(text, iso, 2).cast("int").alias("month"), year.cast("int").alias("year"), text.alias("text"))

    def rules(r: Column) -> Column:
        make = lambda y, q: F.struct(y.alias("year"), q.cast("int").alias("quarter"))
        return (F.when(r["month"].between(1, 12), make(r["iso_year"], _quarter_of_month(r["month"])))
                .when(r["year"].isNotNull(), make(r["year"], _quarter(r["text"]))))

    return bind(bind(fold_digits(c), read), rules)


def periods_differ(year_a: Column, quarter_a: Column, year_b: Column, quarter_b: Column) -> Column:
    """True only if both periods are known and disagree; coarser never differs from finer."""
    return F.coalesce((year_a != year_b) | ((year_a == year_b) & (quarter_a != quarter_b)), F.lit(False))
