"""Passages: page-aligned chunks, paragraph packs, embeddings, cue scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import text
from ..functions.text import bind

SIZE, OVERLAP = 1200, 150
BLANKS = " \n\t"
DIMENSION = 64

# Cues per field group, in three languages.
FIELD_CUES = {
    "identity": ["limited", "ltd", "colliery", "collieries", "company", "subsidiary", "कंपनी", "लिमिटेड", "खान", "సంస్థ", "లిమిటెడ్", "గని"],
    "period": ["financial year", "fiscal", "during the year", "reporting period", "quarter", "fy20", "fy 20", "वर्ष", "वित्तीय", "अवधि",
               "సంవత్సరం", "ఆర్థిక"],
    "location": ["district", "state of", "tehsil", "village", "block", "coalfield", "located", "situated", "जिला", "राज्य", "क्षेत्र", "स्थित",
                 "జిల్లా", "రాష్ట్రం", "ప్రాంతం"],
    "production": ["production", "produced", "output", "extracted", "despatch", "dispatch", "tonne", "tonnes", "million tonnes", "mt", "lakh",
                   "overburden", "उत्पादन", "टन", "निष्कासन", "ఉత్పత్తి", "టన్నులు"],
    "reserves": ["reserve", "reserves", "proved", "indicated", "inferred", "estimated reserves", "geological", "भंडार", "अनुमानित", "सिद्ध",
                 "నిల్వలు", "అంచనా"],
    "method": ["opencast", "open cast", "underground", "mining method", "longwall", "board and pillar", "खुली", "भूमिगत", "विधि", "ఓపెన్‌కాస్ట్",
               "భూగర్భ", "పద్ధతి"],
    "mineral": ["coal", "coking", "non-coking", "lignite", "iron ore", "bauxite", "mineral", "grade", "कोयला", "खनिज", "బొగ్గు", "ఖనిజ"],
    "environment": ["environment", "environmental", "reclamation", "plantation", "afforestation", "safety", "accident", "पर्यावरण", "सुरक्षा",
                    "పర్యావరణ", "భద్రత"],
}


def _cells(c: Column, size: int) -> Column:
    """The text in cells of `size` characters, so that a place is looked up and not walked to."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _from_cells(cells: Column, size: int, at: Column, end: Column, most: int) -> Column:
    """Characters at to end (0-based, end exclusive, at most `most` of them) of a text in cells."""
    near = F.array_join(F.slice(cells, F.floor(at / size).cast("int") + 1, F.lit(most // size + 2)), "")
    return F.substring(near, (at % size + 1).cast("int"), (end - at).cast("int"))


def _fold_spans(cells: Column, n: Column, size: int, overlap: int) -> Column:
    half = size // 2
    rounds = F.sequence(F.lit(1), (n / (half - overlap) + 1).cast("int"))
    start = F.struct(F.lit(0).alias("at"), (n == 0).alias("done"), F.array().cast("array<struct<at:int,end:int>>").alias("spans"))

    def step(acc: Column, _: Column) -> Column:
        at = acc["at"]
        full = F.least(at + size, n)
        tail = F.reverse(F.when(full > at + half, _from_cells(cells, half, at + half, full, half)).otherwise(""))

        def cut(t: Column) -> Column:
            dot, blank = (F.call_function("locate", F.lit(x), t) for x in (" .", " "))
            end = F.when(full == n, n).when(dot > 0, full - dot).when(blank > 0, full - blank + 1).otherwise(full).cast("int")
            return bind(end, lambda e: F.struct(F.greatest(e - overlap, at + 1).alias("at"), (e >= n).alias("done"),
                                                 F.concat(acc["spans"], F.array(F.struct(at.alias("at"), e.alias("end")))).alias("spans")))

        return F.when(acc["done"], acc).otherwise(bind(tail, cut))

    return F.aggregate(rounds, start, step, lambda acc: acc["spans"])


def spans(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """ARRAY<STRUCT<at, end>> of a page's chunks (0-based, end exclusive), folded over a sequence that carries the start.

    A window ends behind its last ". ", else its last space, found in its second half, else at its full size; the next
    begins `overlap` earlier, at least one character on. A step looks at a few cells of the page, whatever its length.
    """
    return bind(_cells(c, size // 2), lambda cells: _fold_spans(cells, F.length(c), size, overlap))


def pieces(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """The chunks of a page in order, stripped."""
    half = size // 2
    cut = lambda cells: F.transform(_fold_spans(cells, F.length(c), size, overlap), lambda s: F.trim(
        _from_cells(cells, half, s["at"], s["end"], size), F.lit(BLANKS)))
    return bind(_cells(c, half), cut)


def chunk_pages(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """report_id, page, chunk_index, content (and the pages' other columns); blank pieces are dropped and chunk_index
    runs over the report. A raw text without pages comes in as page 0."""
    keep = [c for c in pages.columns if c != "text"]
    cut = bind(text.tidy_text(F.coalesce("text", F.lit(""))), lambda t: pieces(t, size, overlap))
    rows = pages.select(*keep, F.posexplode(cut).alias("__k", "content")).where(F.length("content") > 0)
    order = Window.partitionBy("report_id").orderBy("page", "__k")
    return rows.withColumn("chunk_index", F.row_number().over(order) - 1).drop("__k").select(*keep, "content", "chunk_index")


def pages_or_raw(reports: DataFrame) -> DataFrame:
    """Pages of every report; one with no page that holds text gives its raw text as page 0."""
    some = F.exists(F.coalesce("page_texts", F.array().cast("array<string>")), lambda p: text.clean(p).isNotNull())
    base = reports.select(F.col("id").alias("report_id"), F.col("company_name").alias("organisation"), "filename", "raw_text", "page_texts", some.alias("some"))
    paged = base.where("some").select("report_id", "organisation", "filename", F.posexplode("page_texts").alias("pos", "text"))
    return (paged.select("report_id", "organisation", "filename", (F.col("pos") + 1).alias("page"), "text")
            .unionByName(base.where("NOT some").select("report_id", "organisation", "filename", F.lit(0).alias("page"), F.col("raw_text").alias("text"))))


def chunk_paragraphs(docs: DataFrame, size: int = 2000, carry: int = 34, text_col: str = "text") -> DataFrame:
    """Paragraphs packed up to `size` characters; a pack that is full hands its last `carry` words to the next. A
    first paragraph that is too long is packed by sentences."""
    parts = F.filter(F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n\n"), lambda p: F.trim(p, F.lit(BLANKS))), lambda p: F.length(p) > 0)
    pieces = bind(parts, lambda ps: F.flatten(F.transform(ps, lambda p: F.when(F.length(p) > size, F.split(p, r"(?<=\. )")).otherwise(F.array(p)))))
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["now"] == "") | (F.length(acc["now"]) + F.length(p) + 2 <= size)
        tail = F.array_join(F.slice(F.split(acc["now"], " "), F.greatest(-F.size(F.split(acc["now"], " ")), F.lit(-carry)), F.lit(carry)), " ")
        return (F.when(fits, F.struct(F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p)).alias("now"), acc["out"].alias("out")))
                .otherwise(F.struct(F.concat(tail, F.lit("\n\n"), p).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))))

    done = F.aggregate(pieces, start, step, lambda acc: F.when(acc["now"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["now"]))))
    keep = [c for c in docs.columns if c != text_col]
    return docs.select(*keep, F.posexplode(done).alias("chunk_index", "content"))


def hash_embedding(c: Column, dimension: int = DIMENSION) -> Column:
    """The default, reproducible embedding: words counted in hashed places, scaled to length one."""
    places = F.transform(text.words(c, 1), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(dimension)).cast("int"))
    count = bind(places, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: F.size(F.filter(ps, lambda p: p == k)).cast("double")))
    return bind(count, lambda v: bind(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)),
                                        lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def embed(passages: DataFrame, fn: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 100) -> DataFrame:
    """Passages with an embedding; the hashing one, or fn on batches of `batch` contents, counts checked per batch."""
    if fn is None:
        return passages.withColumn("embedding", hash_embedding(F.col("content")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = []
            for at in range(0, len(frame), batch):
                part = frame["content"].iloc[at:at + batch].tolist()
                found = fn(part)
                if len(found) != len(part):
                    raise ValueError(f"{len(part)} passages gave {len(found)} vectors")
                vectors += [[float(x) for x in v] for v in found]
            yield frame.assign(embedding=vectors)

    schema = StructType([*passages.schema.fields, StructField("embedding", ArrayType(DoubleType()))])
    return passages.mapInPandas(run, schema)


def _hits(low: Column) -> list[Column]:
    """Hits per field group in a lower-cased text that is computed already."""
    n = F.length(low)
    count = lambda cue: F.floor((n - F.length(F.replace(low, cue, F.lit("")))) / F.length(cue)).cast("int")
    return [F.aggregate(F.array(*map(F.lit, cues)), F.lit(0), lambda total, cue: total + count(cue)).alias(group) for group, cues in FIELD_CUES.items()]


def cue_hits(c: Column) -> Column:
    """Hits per field group: non-overlapping occurrences of each of its cues in the lower-cased text, which is made once."""
    return bind(F.lower(c), lambda low: F.struct(*_hits(low)))


def with_cue_score(passages: DataFrame) -> DataFrame:
    """2 x groups hit + 0.5 x hits (three per group at most) + 12 x digits per character."""
    def scored(hits: Column) -> Column:
        breadth = sum(((hits[g] > 0).cast("int") for g in FIELD_CUES), F.lit(0))
        depth = sum((F.least(hits[g], F.lit(3)) for g in FIELD_CUES), F.lit(0))
        return F.struct(hits.alias("hits"), (breadth * F.lit(2.0) + depth * F.lit(0.5) + text.mentions_figure(F.col("content")) * F.lit(12.0)).alias("score"))

    return passages.withColumn("__s", bind(cue_hits(F.col("content")), scored)).select(*passages.columns, "__s.hits", "__s.score")
