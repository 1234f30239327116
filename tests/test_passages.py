"""Chunks, paragraph packs, cue scores, selection, terms and topics against plain loops over whole tables."""

import hashlib
import random
import re
import time
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from orefolio.operators import aggregates, passages, selection
from orefolio.plans import fixtures, registry

STRIP = " \n\t"


def tidy(t):
    return re.sub("[ \t]+", " ", (t or "").replace("\r", "")).strip(" \t\n\r\f\v")


def page_chunks(t, size=1200, overlap=150):
    """Windows of `size`; a cut behind the last full stop and space, else the last space, of the second half."""
    found, start = [], 0
    while True:
        stop = min(len(t), start + size)
        if stop < len(t):
            second = t[start + size // 2:stop]
            dot, space = second.rfind(". "), second.rfind(" ")
            stop = start + size // 2 + (dot + 1 if dot >= 0 else space + 1) if max(dot, space) >= 0 else stop
        found.append(t[start:stop].strip(STRIP))
        if stop >= len(t):
            return [x for x in found if x]
        start = max(stop - overlap, start + 1)


def chunks_of(text):
    """(page, content) over pages of 2,000 characters."""
    out = []
    for k in range(0, len(text), 2000):
        page = tidy(text[k:k + 2000])
        out += [(k // 2000 + 1, c) for c in (page_chunks(page) if page else [])]
    return out


def score(content):
    low = content.lower()
    hits = {g: sum(low.count(cue) for cue in cues) for g, cues in passages.FIELD_CUES.items()}
    digits = sum(unicodedata.category(c) == "Nd" for c in content)
    return {g for g in hits if hits[g]}, 2 * sum(h > 0 for h in hits.values()) + 0.5 * sum(min(h, 3) for h in hits.values()) + 12 * digits / max(1, len(content))


def selected(chunks, budget):
    """The two first that fit, then the groups in turn, then the best of all; by repeated scans."""
    facts = [score(c) for _, c in chunks]
    size = [len(c) for _, c in chunks]
    if sum(size) <= budget:
        return list(range(len(chunks)))
    taken, passed = [], {g: set() for g in passages.FIELD_CUES}
    room = lambda: budget - sum(size[k] for k in taken)
    for k in (0, 1):
        if size[k] > room():
            break
        taken.append(k)
    while room() > 0:
        before = len(taken)
        for g in passages.FIELD_CUES:
            if room() <= 0:
                break
            while True:
                left = [(facts[k][1], k) for k in range(len(chunks)) if g in facts[k][0] and k not in passed[g]]
                if not left:
                    break
                k = max(left)[1]
                passed[g].add(k)
                if k not in taken and size[k] <= room():
                    taken.append(k)
                    break
        if len(taken) == before:
            break
    for k in sorted(range(len(chunks)), key=lambda k: (-facts[k][1], k)):
        if k not in taken and 0 < size[k] <= room():
            taken.append(k)
    return sorted(taken)


def excerpt(chunks, places):
    parts = []
    for before, k in zip([None, *places], places):
        page, content = chunks[k]
        parts.append(f"[... page {page} ...]\n\n{content}" if before is not None and k != before + 1 else content)
    return "\n\n".join(parts)


def cued_texts(n=60):
    """Long reports with cues in three languages, ties between chunks, and lengths around the budget."""
    rng = random.Random(6)
    filler = ["the annual meeting was held", "minutes were read", "कोयला उत्पादन", "గని ఉత్పత్తి", "production was 21.9 million tonnes", "proved reserves", "district", "opencast", "12", "x" * 40, "environment and safety"]
    return [". ".join(rng.choice(filler[:rng.randrange(2, 12)]) for _ in range(rng.randrange(100, 2500))) for _ in range(n)]


def test_selection_of_every_long_document(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for k, t in enumerate(cued_texts()):
        texts[10**6 + k] = t
    extra = spark.createDataFrame([(k, t) for k, t in texts.items() if k >= 10**6], "doc_id long, text string")
    pages = fixtures.pages(spark, sf_dir).select("report_id", "page", "text").unionByName(
        extra.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 2000).cast("int"))).alias("k"))
        .select(F.col("doc_id").alias("report_id"), (F.col("k") + 1).alias("page"), F.substring("text", F.col("k") * 2000 + 1, F.lit(2000)).alias("text")))
    got = {r["report_id"]: r for r in selection.select_passages(passages.chunk_pages(pages)).collect()}
    over = 0
    for k, t in texts.items():
        chunks = chunks_of(t or "")
        if not chunks:
            assert k not in got
            continue
        places = selected(chunks, 8000)
        over += len(places) < len(chunks)
        assert got[k]["excerpt"] == excerpt(chunks, places) and got[k]["pages"] == sorted({chunks[p][0] for p in places})
    assert over > 40
    rows = registry.QUERIES["c9_select_passages"](spark, sf_dir).collect()
    assert {r["report_id"]: r["excerpt"] for r in rows} == {k: hashlib.md5(r["excerpt"].encode()).hexdigest() for k, r in got.items() if k < 10**6}


def test_chunks_of_odd_pages(spark):
    rng = random.Random(3)
    texts = ["😀" * 3000, "é. " * 900, "x" * 1199, "x" * 1200, "x" * 1201, "a " * 600 + "b", " \n ", "", None, "𝒳 . " * 700, "a\r\n\r\nb" * 500]
    texts += ["".join(rng.choice("ab. \n😀é") for _ in range(rng.randrange(1, 6000))) for _ in range(40)]
    pages = spark.createDataFrame([(k, 1, t) for k, t in enumerate(texts)], "report_id long, page int, text string")
    got = {}
    for r in passages.chunk_pages(pages).orderBy("report_id", "chunk_index").collect():
        got.setdefault(r["report_id"], []).append(r["content"])
    assert got == {k: found for k, t in enumerate(texts) if (found := page_chunks(tidy(t)) if tidy(t) else [])}


def test_chunks_of_a_megabyte_take_no_longer_than_of_many_pages(spark):
    text = "Block seven é raised coal. " * 40_000
    one = spark.createDataFrame([(1, 1, text)], "report_id long, page int, text string")
    many = spark.createDataFrame([(1, k, text[k * 10_800:(k + 1) * 10_800]) for k in range(100)], "report_id long, page int, text string").coalesce(1)
    took = []
    for rows in (many, one, many, one):
        began = time.time()
        passages.chunk_pages(rows).select(F.sum(F.length("content"))).collect()
        took.append(time.time() - began)
    assert took[3] < 4 * took[2] + 2
    assert [r["content"] for r in passages.chunk_pages(one).orderBy("chunk_index").limit(50).collect()] == page_chunks(text.strip(STRIP))[:50]


def packed(text, size=2000, carry=34):
    """Paragraphs into packs; a full pack leaves its last words to the next one."""
    units = []
    for p in (p.strip(STRIP) for p in (text or "").split("\n\n")):
        if p:
            units += re.split(r"(?<=\. )", p) if len(p) > size else [p]
    done, pack = [], ""
    for u in units:
        if not pack:
            pack = u
        elif len(pack) + 2 + len(u) <= size:
            pack += "\n\n" + u
        else:
            done.append(pack)
            pack = " ".join(pack.split(" ")[-carry:]) + "\n\n" + u
    return done + [pack] if pack else done


def test_paragraph_packs_of_every_document(spark, sf_dir):
    got = {}
    for r in registry.QUERIES["c2_chunk_paragraphs"](spark, sf_dir).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["content"])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {k: found for k, t in texts.items() if (found := packed((t or "").replace("\n", "\n\n")))}
    assert got == want and max(map(len, want.values())) > 3
    odd = ["", None, "\n\n \n\n", "a\n\nb", "w " * 3000, "s one. " * 900 + "\n\nend", "x" * 5000 + "\n\n" + "y" * 1999]
    rows = spark.createDataFrame(list(enumerate(odd)), "k int, text string")
    found = {}
    for r in passages.chunk_paragraphs(rows).orderBy("k", "chunk_index").collect():
        found.setdefault(r["k"], []).append(r["content"])
    assert found == {k: x for k, t in enumerate(odd) if (x := packed(t))}


def test_embeddings_of_every_passage(spark, sf_dir):
    """Hashed words, counted and scaled to length one, in the passages' order."""
    import zlib

    rows = passages.embed(passages.chunk_pages(fixtures.pages(spark, sf_dir))).select("content", "embedding").limit(400).collect()
    for r in rows:
        counts = Counter(zlib.crc32(w.encode()) % 64 for w in re.findall(r"[^\W\d_]\w*", unicodedata.normalize("NFC", r["content"].lower())))
        length = sum(n * n for n in counts.values()) ** 0.5
        assert all(abs(x - (counts[k] / length if length else 0)) < 1e-9 for k, x in enumerate(r["embedding"]))


def test_terms_in_their_row(spark):
    texts = ["coal seam coal Seam coal ore", "", None, "the and of", "कोयला खदान कोयला", "ab abc abcd abc", "z" * 5 + " y1y " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "report_id long, text string")
    got = {}
    for r in aggregates.top_terms(rows, 2).collect():
        got.setdefault(r["report_id"], []).append((r["rank"], r["term"], r["n"]))
    assert {k: sorted(v) for k, v in got.items()} == {0: [(1, "coal", 3), (2, "seam", 2)], 4: [(1, "कोयला", 2), (2, "खदान", 1)], 5: [(1, "abc", 2), (2, "abcd", 1)], 6: [(1, "y1y", 3000), (2, "zzzzz", 1)]}
    assert [(r["term"], r["n"]) for r in aggregates.corpus_terms(rows, 3).collect()] == [("y1y", 3000), ("coal", 3), ("abc", 2)]
    plan = aggregates.top_terms(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_topics_and_terms_contain_each_other(spark):
    rng = random.Random(1)
    topics = list({"".join(rng.choice("abé ") for _ in range(rng.randrange(1, 9))).strip() for _ in range(300)} - {""})
    names = list({"".join(rng.choice("ABé ") for _ in range(rng.randrange(0, 7))) for _ in range(200)})
    reports = spark.createDataFrame([(k, topics[k % len(topics):][:3]) for k in range(300)], "id long, topics array<string>")
    terms = spark.createDataFrame([(x,) for x in names], "name string")
    found = aggregates.topic_documents(reports, terms)
    want = {(x, k) for x in names for k in range(300) for t in topics[k % len(topics):][:3] if x.lower() in t.lower() or t.lower() in x.lower()}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
