"""Statistics, distributions, coverage, topics, profiles, dossier sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import bind
from ..schemas import DEPENDED_ON, EXTRACTED_ONLY
from ..sources.staging import staged
from .findings import completed, scope, value_of

# Words that say nothing about a report, by language.
STOPWORDS_EN = """
the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would could
should may might shall can this that these those it its not no nor also than then so very just about above after before between
under during through here there where when how all each every both few more most other some such only own same too into over any
if their them they he she we you me my your his her our what which who whom while although though because since until unless
whether however therefore thus hence otherwise meanwhile furthermore moreover report reports data table figure given mentioned
below following according ref etc ie viz per annexure annex sr sl page para section chapter note notes source prepared view based
total year month day period date time
""".split()
STOPWORDS_HI = """
का के की को में से है हैं था थे थी और या पर यह वह इस उस एक तथा कि तो ही भी ने हुआ हुई हुए गया गई गए किया करने करना लिए द्वारा साथ अपने सभी
कुछ जो जब तक नहीं रहा रही रहे होता होती होने बाद आदि अन्य इसके उनके वाले वाली गयी
""".split()
STOPWORDS_TE = """
మరియు లేదా కోసం ద్వారా ఉంది ఉన్నాయి ఉన్న చేసిన చేయడం జరిగింది వారు అతను ఆమె ఇది అది ఇవి అవి తర్వాత ముందు అన్ని కొన్ని ఎక్కువ వంటి కూడా మాత్రమే
ప్రకారం అయితే అలాగే గురించి వరకు నుండి కాదు లేదు అందుకే వల్ల కంటే వంటివి
""".split()
STOPWORDS = STOPWORDS_EN + STOPWORDS_HI + STOPWORDS_TE


def stats(reports: DataFrame, history: DataFrame, organisation: str | None = None) -> DataFrame:
    """A1: one pass over the reports in scope; queries are not scoped."""
    own = scope(reports, organisation).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "error").alias("errors"))
    return own.join(history.agg(F.count(F.lit(1)).alias("queries")))  # one row each


def distribution(reports: DataFrame, column: str) -> DataFrame:
    """A2: completed reports per value, blank values dropped, most frequent first."""
    key = F.col(column)
    return (completed(reports).where(key.isNotNull() & (key != "")).groupBy(key.alias("label")).agg(F.count(F.lit(1)).alias("reports"))
            .orderBy(F.desc("reports"), "label"))


def populated(field: str) -> Column:
    column = F.lit(None).cast("string") if field in EXTRACTED_ONLY else F.col(field)
    return text.is_populated(column, F.col(f"extracted_data.{field}"))


def coverage(reports: DataFrame) -> DataFrame:
    """A3: populated over expected depended-on fields of completed reports; null ratio without any."""
    found = reduce(Column.__add__, [populated(f).cast("int") for f in DEPENDED_ON])
    return (completed(reports).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(found), F.lit(0)).alias("fields_populated"))
            .select("documents", (F.col("documents") * len(DEPENDED_ON)).alias("fields_expected"), "fields_populated",
                    F.try_divide(F.col("fields_populated"), F.col("documents") * len(DEPENDED_ON)).alias("ratio")))


def organisations(documents: DataFrame) -> DataFrame:
    """A4: trimmed names, count descending, name ascending."""
    name = text.clean(F.col("organisation"))
    return (documents.where(name.isNotNull()).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("reports"))
            .orderBy(F.desc("reports"), "name"))


def term_counts(c: Column) -> Column:
    """ARRAY<STRUCT<n, first, term>> of a text's words that are no stopwords: how often and where first. Words are sorted with their
    places, and a term's count is the length of its run, so that nothing leaves the row."""
    kept = F.filter(F.transform(text.words(c), lambda w, k: F.struct(w.alias("w"), k.alias("k"))), lambda x: ~x["w"].isin(STOPWORDS))

    def runs(ws: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda k: (k == 0) | (F.get(ws, k)["w"] != F.get(ws, F.greatest(k - 1, F.lit(0)))["w"]))
        return bind(begins, lambda b: F.transform(b, lambda k, j: F.struct(
            (F.coalesce(F.get(b, j + 1), F.size(ws)) - k).cast("bigint").alias("n"), F.get(ws, k)["k"].alias("first"), F.get(ws, k)["w"].alias("term"))))

    return bind(F.array_sort(kept), lambda ws: F.when(F.size(ws) > 0, runs(ws)).otherwise(F.array().cast("array<struct<n:bigint,first:int,term:string>>")))


def top_terms(docs: DataFrame, n: int = 10, id_col: str = "report_id", text_col: str = "text") -> DataFrame:
    """A9 per report: id, term, n, rank; ties by first occurrence. Frequencies are counted and ranked within the row: nothing is
    shuffled."""
    ranked = F.slice(F.array_sort(F.transform(term_counts(F.col(text_col)), lambda t: F.struct((-t["n"]).alias("least"), t["first"].alias("first"), t["term"].alias("term")))), 1, n)
    return docs.select(F.col(id_col).alias("report_id"), F.posexplode(ranked).alias("k", "t")).select(
        "report_id", "t.term", (-F.col("t.least")).alias("n"), (F.col("k") + 1).alias("rank"))


def corpus_terms(docs: DataFrame, n: int = 10, text_col: str = "text") -> DataFrame:
    """A9 over the corpus: ties in text order. A term leaves a report once, with its count."""
    return (docs.select(F.explode(term_counts(F.col(text_col))).alias("t")).groupBy("t.term").agg(F.sum("t.n").alias("n"))
            .orderBy(F.desc("n"), "term").limit(n))


def report_topics(reports: DataFrame) -> DataFrame:
    """report_id, term: distinct trimmed topics of every report."""
    return (reports.select(F.col("id").alias("report_id"), F.explode("topics").alias("t"))
            .select("report_id", text.clean(F.col("t")).alias("term")).where("term IS NOT NULL").distinct())


def co_occurrence(topics: DataFrame) -> DataFrame:
    """Term, other, documents shared. A report holds a handful of topics, which bounds its pairs."""
    other = topics.select("report_id", F.col("term").alias("other"))
    return (topics.join(other, "report_id").where("term <> other").groupBy("term", "other").agg(F.count(F.lit(1)).alias("shared")))


def topic_entities(reports: DataFrame, related: int = 6) -> DataFrame:
    """A10: per topic its reports, weight against the largest, category and most shared other topics (ties by text)."""
    topics = report_topics(reports)
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("shared"), "other"))
    near = (co_occurrence(topics).withColumn("r", rank).where(F.col("r") <= related).groupBy("term")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "other"))), lambda s: s["other"]).alias("related_terms")))
    counts = topics.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    most = counts.agg(F.max("documents").alias("most"))
    return (counts.join(F.broadcast(most)).join(near, "term", "left")  # one row
            .select(text.topic_slug(F.col("term")).alias("id"), F.col("term").alias("name"),
                    F.floor(F.col("documents") * 100 / F.col("most") + 0.5).cast("int").alias("weight"),
                    text.topic_category(F.col("term")).alias("category"), "documents",
                    F.coalesce("related_terms", F.array().cast("array<string>")).alias("related_terms")))


#: Characters of the grams under which strings are found that contain another one.
GRAM = 3


def _grams(c: Column, of_all: bool) -> Column:
    """Distinct grams of a string: those of GRAM characters, or the string itself if it is shorter; of_all: those of fewer characters
    as well, and the empty one."""
    n = F.length(c)
    of = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda k: F.substring(c, k, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    if of_all:
        return F.array_distinct(F.concat(F.array(F.lit("")), *[of(size) for size in range(1, GRAM + 1)]))
    return F.array_distinct(F.when(n >= GRAM, of(GRAM)).otherwise(F.array(c)))


def containing(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (inner, outer) of distinct strings, columns s, where the one stands in the other. An inner string is looked up under its
    rarest gram among the outer ones, and what is found is verified; both sides may be of any size."""
    index = outer.select(F.col("s").alias("outer"), F.explode(_grams(F.col("s"), True)).alias("gram"))
    common = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    asked = inner.select(F.col("s").alias("inner"), F.explode(_grams(F.col("s"), False)).alias("gram")).join(common, "gram", "left")
    rarest = asked.groupBy("inner").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(index, "gram").where(F.col("outer").contains(F.col("inner"))).select("inner", "outer")


def topic_documents(reports: DataFrame, terms: DataFrame) -> DataFrame:
    """Term, report_id where the term and one of the report's topics contain each other, either way, in any case.
    Distinct topics meet distinct terms through an index of grams, not reports, and no pair is tried that shares none.

    A report's topics are made distinct in their row. Of the joins by topic, which a few topics may fill, the rows of the matches are
    the ones that are held and the reports' rows run past them."""
    clean = F.transform(F.coalesce("topics", F.array().cast("array<string>")), lambda t: F.lower(text.clean(t)))
    topics = reports.select(F.col("id").alias("report_id"), F.explode_outer(F.array_distinct(clean)).alias("t")).where("t IS NOT NULL")
    asked = terms.select("name", F.lower("name").alias("q")).where("q IS NOT NULL").distinct()
    some, all_ = staged(asked.select(F.col("q").alias("s")).distinct(), "terms"), staged(topics.select(F.col("t").alias("s")).distinct(), "topics")
    match = (containing(some, all_).select(F.col("inner").alias("q"), F.col("outer").alias("t"))
             .unionByName(containing(all_, some).select(F.col("outer").alias("q"), F.col("inner").alias("t"))).distinct())
    names = staged(match.join(asked, "q").select("t", "name").distinct(), "matches")
    return topics.join(names, "t").select("name", "report_id").distinct()


def topic_share(reports: DataFrame, terms: DataFrame, organisation: str | None = None) -> DataFrame:
    """Matched documents per term and their percentage of the scope."""
    rows = scope(reports, organisation)
    matched = topic_documents(rows, terms).groupBy("name").agg(F.count(F.lit(1)).alias("documents"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return matched.join(F.broadcast(total)).select(  # one row
        "name", "documents", F.floor(F.try_divide(F.col("documents") * 100, F.col("total")) + 0.5).cast("int").alias("percent"))


def dossier_overview(reports: DataFrame) -> DataFrame:
    """How many reports, and the sorted distinct minerals and locations."""
    distinct = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), ", ")
    row = completed(reports).agg(F.count(F.lit(1)).alias("reports"), distinct("mineral_type").alias("minerals"), distinct("location").alias("locations"))
    return row.select("reports", *[F.when(F.col(c) == "", "none recorded").otherwise(F.col(c)).alias(c) for c in ("minerals", "locations")])


def dossier_production(reports: DataFrame) -> DataFrame:
    """The production table in id order, cells cut to 42/22/22/22 characters, '-' for what is absent."""
    cell = lambda c: F.left(F.coalesce(text.blank_to_null(F.col(c)), F.lit("-")), F.lit(22)).alias(c)
    return completed(reports).select("id", F.left(F.coalesce("filename", F.lit("")), F.lit(42)).alias("filename"), cell("mineral_type"),
                                     cell("quantity_extracted"), cell("extraction_method"))


def dossier_findings(reports: DataFrame) -> DataFrame:
    """Key findings per report in order; one row saying so when there are none at all."""
    rows = completed(reports).select("id", "filename", F.posexplode("extracted_data.key_findings").alias("pos", "finding"))
    none = rows.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("filename"), F.lit(0).alias("pos"),
        F.lit("No key findings were extracted from the indexed documents.").alias("finding"))
    return rows.unionByName(none)


def dossier_sources(reports: DataFrame) -> DataFrame:
    """A12d: one line per source."""
    pages = F.coalesce(F.size("page_texts"), F.lit(0))
    return completed(reports).select("id", F.concat(F.lit("["), F.col("id").cast("string"), F.lit("] "), "filename",
                                                    F.when(pages > 0, F.concat(F.lit(" ("), pages.cast("string"), F.lit(" pages)"))).otherwise("")).alias("line"))


def corpus_profile(pages: DataFrame, passages: DataFrame) -> DataFrame:
    """A13 per document: pages, characters, text layer, passages, scripts, notes."""
    stripped = F.coalesce(text.clean(F.col("text")), F.lit(""))
    flag = [F.max(F.array_contains(text.scripts_in(stripped), n)).alias(n) for n in text.SCRIPTS]
    per = pages.groupBy("report_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length(stripped)).alias("chars"), *flag)
    count = passages.groupBy("report_id").agg(F.count(F.lit(1)).alias("passages"))
    thin = F.col("chars") < F.col("pages") * 120
    notes = F.array_compact(F.array(F.when(thin, "no usable text layer - OCR carries this one"),
                                    F.when(thin, "almost no text extracted - check this by eye before labelling"),
                                    F.when(F.col("pages") > 200, F.concat(F.col("pages").cast("string"), F.lit(" pages - OCR runs on every one of them, synchronously")))))
    scripts = F.array_join(F.array_compact(F.array(*[F.when(F.col(n), n) for n in text.SCRIPTS])), ", ")
    return per.join(count, "report_id", "left").select(
        "report_id", "pages", "chars", (~thin).alias("text_layer"), F.coalesce("passages", F.lit(0)).alias("passages"),
        F.when(scripts == "", "Latin").otherwise(F.concat(F.lit("Latin + "), scripts)).alias("script"), F.array_join(notes, "; ").alias("notes"))


def corpus_totals(profile: DataFrame, pace: int = 100) -> DataFrame:
    """A13 in total, with the minutes that indexing takes at a pace of passages per minute."""
    return profile.agg(F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"), F.sum("passages").alias("passages"),
                       F.count_if(~F.col("text_layer")).alias("without_layer")).withColumn("minutes", F.ceil(F.col("passages") / pace))


def capacity(pages: DataFrame, passages: DataFrame) -> DataFrame:
    """Passages per page, characters per passage, passages per document."""
    p = pages.agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("report_id").alias("documents"))
    c = passages.agg(F.count(F.lit(1)).alias("passages"), F.sum(F.length("content")).alias("chars"))
    return p.join(c).select("pages", "documents", "passages", F.round(F.col("passages") / F.col("pages"), 4).alias("per_page"),
                            F.round(F.col("chars") / F.col("passages"), 2).alias("chars_per_passage"),
                            F.round(F.col("passages") / F.col("documents"), 4).alias("per_document"))


def latency(samples: DataFrame, column: str) -> DataFrame:
    """Exact median, 95th percentile and maximum."""
    return samples.agg(F.percentile(column, 0.5).alias("median"), F.percentile(column, 0.95).alias("p95"), F.max(column).alias("max"))


def analytics_export(reports: DataFrame, history: DataFrame, organisation: str | None = None) -> DataFrame:
    """Section, label, value in the order of the sheet."""
    rows = scope(reports, organisation)
    line = lambda at, section, label, value: F.struct(F.lit(at).alias("part"), F.lit(section).alias("section"), F.lit(label).alias("label"), value.cast("string").alias("value"))
    top = stats(rows, history).select(F.explode(F.array(
        line(0, "Scope", "Organisation", F.lit(organisation or "All organisations")), line(1, "Totals", "Documents", F.col("total")),
        line(2, "Totals", "Completed", F.col("completed")), line(3, "Totals", "Errors", F.col("errors")), line(4, "Totals", "Queries", F.col("queries")))).alias("x")).select("x.*")
    spread = lambda at, section, column: distribution(rows, column).select(F.lit(at).alias("part"), F.lit(section).alias("section"), "label", F.col("reports").cast("string").alias("value"))
    return reduce(DataFrame.unionByName, [top, spread(5, "Minerals", "mineral_type"), spread(6, "Locations", "location")])


def label_census(labels: DataFrame) -> DataFrame:
    """A16."""
    return labels.groupBy("corpus").agg(F.count(F.lit(1)).alias("labels"), F.count_if(F.col("status") == "draft").alias("drafts"))


# Labels of a report's summary lines, in order.
SUMMARY_LINES = [("Report Date", "report_date"), ("Location", "location"), ("State", "state"), ("District", "district"),
                 ("Mineral Type", "mineral_type"), ("Mine Name", "mine_name"), ("Company", "company_name"),
                 ("Quantity Extracted", "quantity_extracted"), ("Extraction Method", "extraction_method"), ("Area (sq km)", "area_sq_km"),
                 ("Reserve Estimate", "reserve_estimate"), ("Financial Data", "financial_data")]


def report_summary_lines(reports: DataFrame) -> DataFrame:
    """Labelled fields that hold something, as lines."""
    cell = lambda label, f: F.when(F.col(f"extracted_data.{f}") != "", F.concat(F.lit(label + ": "), F.col(f"extracted_data.{f}")))
    return reports.select("id", F.array_join(F.array_compact(F.array(*[cell(*x) for x in SUMMARY_LINES])), "\n").alias("lines"))


def example_questions(documents: DataFrame, limit: int = 4) -> DataFrame:
    """Questions of the first distinct minerals, mines, places and organisations (at most 60 characters), by id."""
    firsts = []
    for name, column in (("minerals", "mineral_type"), ("mines", "mine_name"), ("places", "location"), ("organisations", "organisation")):
        value = text.clean(F.col(column))
        two = (documents.where(value.isNotNull() & (F.length(value) <= 60)).groupBy(value.alias("v")).agg(F.min("id").alias("first"))
               .orderBy("first", "v").limit(2))
        firsts.append(two.agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "v"))), lambda s: s["v"]).alias(name)))
    row = reduce(DataFrame.join, firsts)  # one row each
    at = lambda c, k: F.get(F.col(c), F.lit(k))
    said = F.array_compact(F.array(
        F.when(F.size("minerals") > 1, F.concat(F.lit("Compare the quantities reported for "), at("minerals", 0), F.lit(" and "), at("minerals", 1), F.lit(".")))
        .otherwise(F.concat(F.lit("What quantity of "), at("minerals", 0), F.lit(" is reported across the indexed documents?"))),
        F.concat(F.lit("Summarise the extraction method and reserves reported for "), at("mines", 0), F.lit(".")),
        F.concat(F.lit("What do the indexed reports say about operations in "), at("places", 0), F.lit("?")),
        F.concat(F.lit("List the key findings reported by "), at("organisations", 0), F.lit(".")),
        F.concat(F.lit("How do the figures for "), at("mines", 0), F.lit(" and "), at("mines", 1), F.lit(" differ?"))))
    return row.select(F.posexplode(F.slice(said, 1, limit)).alias("place", "question"))


def value_columns(reports: DataFrame) -> DataFrame:
    """P1 and P2 of every depended-on field, wide."""
    return reports.select("id", *[value_of(f).alias(f"value_{f}") for f in DEPENDED_ON], *[populated(f).alias(f"has_{f}") for f in DEPENDED_ON])
