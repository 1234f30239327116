"""Quantities: figures stated in free text, and the forms under which one is looked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

DEVANAGARI_DIGITS = "०१२३४५६७८९"
TELUGU_DIGITS = "౦౧౨౩౪౫౬౭౮౯"

# Period vocabulary, by value.
HI_ORDINALS = {1: ["पहली", "पहला", "प्रथम"], 2: ["दूसरी", "दूसरा", "द्वितीय"], 3: ["तीसरी", "तीसरा", "तृतीय"],
               4: ["चौथी", "चौथा", "चतुर्थ"]}
TE_ORDINALS = {1: ["మొదటి", "మొదట", "ప్రథమ"], 2: ["రెండవ", "రెండో", "ద్వితీయ"], 3: ["మూడవ", "మూడో", "తృతీయ"],
               4: ["నాల్గవ", "నాలుగవ", "నాల్గో", "చతుర్థ"]}
EN_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
HI_MONTHS = {"जनवरी": 1, "फरवरी": 2, "मार्च": 3, "अप्रैल": 4, "मई": 5, "जून": 6, "जुलाई": 7, "अगस्त": 8, "सितंबर": 9,
             "सितम्बर": 9, "अक्टूबर": 10, "नवंबर": 11, "नवम्बर": 11, "दिसंबर": 12, "दिसम्बर": 12}
TE_MONTHS = {"జనవరి": 1, "ఫిబ్రవరి": 2, "మార్చి": 3, "ఏప్రిల్": 4, "మే": 5, "జూన్": 6, "జూలై": 7, "ఆగస్టు": 8,
             "సెప్టెంబర్": 9, "అక్టోబర్": 10, "నవంబర్": 11, "డిసెంబర్": 12}


def either(items) -> str:
    """Alternatives, longest first, so that none is cut short by another."""
    return "|".join(sorted(items, key=lambda x: (-len(x), x)))


HI_ORDINAL = either(x for v in HI_ORDINALS.values() for x in v)
TE_ORDINAL = either(x for v in TE_ORDINALS.values() for x in v)
HI_QUARTER, TE_QUARTER = "तिमाही", "త్రైమాసికం?"

EDGE_BEFORE = r"(?<![\p{L}\p{N}_])"
_S = r"(?U:\s)"
_D = r"\p{Nd}"
_YEARS = rf"{_S}*[-/]?{_S}*(?:{_D}{{4}}{_S}*[-/]{_S}*{_D}{{2,4}}(?![{_D},])|{_D}{{2,4}}(?![{_D},]))?"

# The patterns of period labels in front of a figure (English, Hindi, Telugu), of a figure and of a figure with its unit.
PERIOD_LABELS = [
    rf"(?i){EDGE_BEFORE}(?:q[1-4]|(?:fy|ay){_S}*[-/]?{_S}*{_D}{{2,4}}|h[12]|(?:{'|'.join(EN_MONTHS)})[a-z]*)" + _YEARS,
    rf"(?:(?:{HI_ORDINAL}){_S}*{HI_QUARTER}|{HI_QUARTER}{_S}*[1-4]?|(?:वित्तीय|वित्त){_S}*वर्ष|छमाही|अर्धवार्षिक|{either(HI_MONTHS)})" + _YEARS,
    rf"(?:(?:{TE_ORDINAL}){_S}*{TE_QUARTER}|{TE_QUARTER}{_S}*[1-4]?|ఆర్థిక{_S}*సంవత్సరం|అర్ధ{_S}*సంవత్సరం|అర్ధవార్షిక|{either(TE_MONTHS)})" + _YEARS,
]


def fold_digits(c: Column) -> Column:
    return F.translate(c, DEVANAGARI_DIGITS + TELUGU_DIGITS, "0123456789" * 2)


def quantity_value(c: Column) -> Column:
    """The figure a value states, without the period label in front of it; null for a label alone or no figure.

    A month-like word takes a two- to four-digit figure behind it for a year ("March 950 t" is null); units are never
    converted ("3.5 lakh" is 3.5).
    """
    folded = fold_digits(c)
    bare = folded
    for label in PERIOD_LABELS:
        bare = F.regexp_replace(bare, label, " ")
    figure = F.regexp_extract(bare, r"[-+]?\p{Nd}[\p{Nd},]*\.?\p{Nd}*", 0)
    return F.replace(figure, F.lit(","), F.lit("")).try_cast("double")


def production_number(c: Column) -> Column:
    """Digits and dots only, leading float, else 0: the explorer's sort key, period labels and all."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9.]", "")
    return F.coalesce(F.regexp_extract(kept, r"^(\d*\.?\d*)", 1).try_cast("double"), F.lit(0.0))


# See PERIOD_LABELS.
FIGURE = r"\p{Nd}[\p{Nd},]*\.?\p{Nd}*"
WITH_UNIT = rf"(?i){FIGURE}\s*(?:million|billion|lakh|crore|thousand)?\s*(?:tonnes?|tons?|mtpa|mt|cubic metres|cu\.? ?m)(?![\p{{L}}\p{{N}}_])"


def search_variants(value: Column) -> Column:
    """Forms of a value worth looking for: whole, without commas, figure with unit, figure, bare figure; of at least
    three characters, longest first, equal lengths in text order."""
    no_comma = lambda c: F.replace(c, F.lit(","), F.lit(""))

    def forms(text: Column, figure: Column) -> Column:
        unit = F.trim(F.regexp_extract(text, WITH_UNIT, 0))
        return F.filter(F.array_distinct(F.array(text, no_comma(text), unit, figure, no_comma(figure))), lambda v: F.length(v) >= 3)

    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))
    found = bind(text, lambda t: bind(F.regexp_extract(t, FIGURE, 0), lambda figure: forms(t, figure)))
    ranked = F.array_sort(F.transform(found, lambda v: F.struct((-F.length(v)).alias("k"), v.alias("v"))))
    return F.transform(ranked, lambda s: s["v"])


def digit_tolerant_pattern(variant: Column) -> Column:
    """A pattern that allows separators between digits, and no digit on either side of a variant that begins or ends
    with one."""
    quoted = F.regexp_replace(variant, r"([^\p{L}\p{N}\s_])", r"\\$1")
    spaced = F.regexp_replace(quoted, r"(?<=\p{Nd})(?=\p{Nd})", r"[,\\s]*")
    before = F.when(variant.rlike(r"^\p{Nd}"), r"(?<![\p{Nd}.,])").otherwise("")
    after = F.when(variant.rlike(r"\p{Nd}$"), r"(?!\p{Nd})").otherwise("")
    return F.concat(F.lit("(?i)"), before, spaced, after)


def is_bare_number(variant: Column) -> Column:
    return variant.rlike(r"^[\p{Nd},.\s]+$")
