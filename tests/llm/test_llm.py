"""Training-data operators against brute-force forms, library encoders and edge cases: nulls, empty and long texts, ties,
repeated rows, empty tables, extra columns whose names clash with inner ones."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orefolio.llm import bpe, chat, common, exact_dedup, mixing, pii, quality, simhash, token_store, topk, toxicity

LONG = "lorem ipsum " * 4000
TEXTS = [(1, "Hello World again and again", "a"), (2, "hello world AGAIN and again", "a"), (3, None, None), (4, "", "b"), (5, LONG, "b"), (5, LONG, "b"), (6, " \n\t ", "a"),
         (None, "no id here at all", "a"), (7, "Ünïcode ß 中文 😀 text\x1c with\x85odd  spaces ", "c"), (8, "x" * 1500, "c"), (9, "It's 'll a's don't 12345 !!??", "a")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*t, "clash", 1, 2.0, b"k") for t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, norm string, size long, score double, ids binary")


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(docs):
    found = rows_of(exact_dedup.exact_dedup(docs))
    groups = {}
    for i, t, _ in TEXTS:
        groups.setdefault(lower(t), []).append(i)
    assert len(found) == len(TEXTS)
    for t, ids in groups.items():
        own = [r for r in found if r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()]
        assert len(own) == len(ids) and sum(r["kept"] for r in own) == 1
        assert {r["keep_id"] for r in own} == {max((i for i in ids if i is not None), default=None)} and {r["group_size"] for r in own} == {len(ids)}
    stay = exact_dedup.drop_copies(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0
    assert exact_dedup.merge_runs(exact_dedup.digests(docs), 1).count() == exact_dedup.merge_runs(exact_dedup.digests(docs), 64, 2).count() == len(groups)


def test_mixing(docs, real):
    found = rows_of(mixing.mix(docs))
    assert len(found) == len(TEXTS) and all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", dict_text(r["doc_id"]))) for r in found if r["doc_id"] is not None)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in found)
    assert mixing.mix(docs.limit(0)).count() == 0
    rows = mixing.mix(real).join(real.select("doc_id", "source"), "doc_id").toPandas()
    per = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"), most=("size", "max"))
    assert abs(per["target"].sum() - 1.5 * rows["size"].sum()) < 1e-6 and (per["target"] <= 2 * per["size"] + 1e-9).all()
    assert ((per["taken"] - per["target"]).abs() <= per["most"] + 1).all() and per["taken"].sum() <= 1.5 * rows["size"].sum()
    again = mixing.mix(real.repartition(7)).toPandas().set_index("doc_id")["taken"].sort_index()
    assert again.equals(rows.set_index("doc_id")["taken"].sort_index())
    assert mixing.take_mix(real).count() == int((rows["taken"] / rows["size"].clip(lower=1)).sum())


def dict_text(doc_id):
    return next((t or "" for i, t, _ in TEXTS if i == doc_id))


def test_bpe(docs, real):
    import public_tokenizers
    import tiktoken

    table = bpe.read_ranks()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    both = docs.select("doc_id", "text", "norm").unionByName(real.select("doc_id", "text", F.lit("x").alias("norm")).limit(40))
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -9, library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in both.collect())
    for most in (0, 50, bpe.HOT_WORDS):  # all words open, few, none
        found = bpe.decode(bpe.encode(both, most=most)).collect()
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -9, np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in found)
        assert got == want
    assert bpe.encode(docs.limit(0)).count() == 0
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(list("ab  \n\t\x1c\u0085 'sétl12.,!　中")) for _ in range(rng.randint(0, 14)))
        cut = bpe.Units(pa.array([text, "a b", ""]))
        units = [cut.units[int(k)].as_py() for k in cut.at[:cut.ends[0]]]
        assert "".join(units) == text
        assert [i for u in units for w in bpe.SPLIT.findall(u) for i in bpe.merge_long(w.encode(), table)] == library.encode_ordinary(text)


def test_bpe_slices(docs, real, monkeypatch):
    """Open words of one slice are not taken for those of another; null ids and repeated rows pass through."""
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    texts = pa.array([f"alpha{k % 7} wordy{k} 'tis" + "x" * (k % 5) for k in range(40)])
    none = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), texts], names=["doc_id", "text"])
    monkeypatch.setattr(common, "SLICE", 200)
    for part in bpe.slices([batch], 1):
        lists, opened = bpe.look_up(part.column(1), *none, bpe.read_ranks())
        folded = [bpe.merge_long(w.encode("latin-1"), bpe.read_ranks()) for w in opened]
        sizes = np.array([len(x) for x in folded])
        values, ends = bpe.close(*bpe.numbers(bpe.as_binary(*bpe.flat(lists))), np.concatenate(folded), np.cumsum(sizes) - sizes, sizes)
        got = [x.tolist() for x in np.split(values, ends[:-1])]
        assert got == [library.encode_ordinary(t) for t in part.column(1).to_pylist()]
        assert bpe.decoded(values, ends, bpe.pieces_of(bpe.read_ranks())).to_pylist() == [t.encode() for t in part.column(1).to_pylist()]


def test_chat(spark):
    extra = "</s>[INST] ok [/INST]"
    odd = ["\\", "<|turn:user|>\n", "a\\<|b</s>\\\\[INST]", "\n<|end|>\n", "", extra, "<\\|", "\\<s>"]
    for t in odd:
        assert chat.unescape(chat.escape(t)) == t and not chat.CONTROL.search(chat.escape(t))
    rows = [(1, 1, '{"role": "assistant", "text": "b"}'), (1, 0, '{"role": "user", "text": null}'), (2, 0, '{"prompt": "p", "response": "r"}'), (2, 1, '{"system": null, "prompt": "p2", "response": "r2"}'),
            (3, 0, '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}'), (4, 0, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
            (5, 0, '{"instruction": "i", "input": "n", "output": "o"}'), (6, 0, None)] + [(7, k, f'{{"role": "assistant", "text": {__import__("json").dumps(t)}}}') for k, t in enumerate(odd)]
    records = spark.createDataFrame(rows, "conv_id long, turn long, record string")
    got = {r["conv_id"]: r for r in chat.read_formatted(chat.format_turns(chat.canonical_turns(records))).collect()}
    turns = {1: [("user", ""), ("assistant", "b")], 2: [("user", "p"), ("assistant", "r"), ("user", "p2"), ("assistant", "r2")], 3: [("user", "hi"), ("assistant", "yo")],
             4: [("user", "q"), ("assistant", "a")], 5: [("user", "i"), ("user", "n"), ("assistant", "o")], 7: [("assistant", t) for t in odd]}
    assert set(got) == set(turns)
    for k, want in turns.items():
        loss = "".join(t for r, t in want if r == "assistant")
        assert got[k]["n_turns"] == len(want) and got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        assert got[k]["loss_chars"] == len(loss) and got[k]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    with pytest.raises(Exception, match="no mapping for layout"):
        chat.canonical_turns(spark.createDataFrame([(1, 0, '{"what": 1}')], "conv_id long, turn long, record string")).collect()
    assert chat.read_formatted(chat.format_turns(chat.canonical_turns(records.limit(0)))).count() == 0


def test_simhash_fingerprint(docs):
    import xxhash

    def plain(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
        return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles)) if shingles else 0

    found = rows_of(simhash.near_duplicates(docs))
    assert len(found) == len(TEXTS)
    for r in found:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{plain(dict_text(r['doc_id'])):016x}"
    by = {r["doc_id"]: r for r in found}
    assert by[3]["component_id"] == by[4]["component_id"] == by[6]["component_id"] == 3 and by[2]["component_id"] == 1
    assert sum(r["keeper"] for r in found) == len({r["component_id"] for r in found})
    stay = simhash.drop_near_duplicates(docs)
    assert stay.columns == docs.columns and stay.count() == sum(r["keeper"] for r in found)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_links(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for seed in rng.sample(sorted(prints), 6):  # chains and one large, dense group
        at = seed
        for _ in range(8):
            at ^= 1 << rng.randrange(64)
            prints.add(at)
        prints |= {seed ^ (1 << b) for b in range(0, 64, 3)} | {seed ^ (1 << b) ^ (1 << c) for b in range(10) for c in range(b)}
    ordered = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    root = {x: x for x in ordered}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ordered):
        for b in ordered[:k]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    links = simhash.links(spark.createDataFrame([(x,) for x in ordered], "fp long"))
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert all(got.get(x, x) == find(x) for x in ordered)


@pytest.mark.parametrize("per_region, block, query_block", [(1024, 4096, 1024), (20, 40, 5)])
def test_top_k(spark, monkeypatch, per_region, block, query_block):
    monkeypatch.setattr(topk, "PER_REGION", per_region)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", query_block)
    rng = np.random.default_rng(1)
    vectors = np.round(rng.standard_normal((700, 16)) / 3, 3)
    vectors[100:400] = vectors[100]  # many ties
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)] + [(800, None), (801, []), (802, [float("nan")] * 16), (803, [None] * 16), (None, [1.0] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("tree", F.lit(2))
    ready = topk.integer_vectors(table)
    found = topk.top_k(ready, ready.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()
    whole = np.floor(256 * vectors).astype(np.int64)
    want = []
    for query in range(0, 700, 50):
        scores = sorted(((-int(s), k) for k, s in enumerate(whole @ whole[query]) if k != query))[:5]
        want += [(query, rank, k, -s) for rank, (s, k) in enumerate(scores, 1)]
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == want
    assert topk.top_k(ready, ready.limit(0)).count() == 0 and topk.top_k(ready.limit(0), ready.limit(0)).count() == 0
    few = ready.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2


def test_far_regions_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(topk, "PER_REGION", 50)
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (20, 8))
    vectors = np.concatenate([c + rng.integers(-3, 4, (60, 8)) for c in centres])
    table = spark.createDataFrame([(k, [int(x) for x in v]) for k, v in enumerate(vectors)], "vec_id long, v array<long>")
    queries = table.where("vec_id % 40 = 0")
    found, one, two, regions = topk._top_k(table, queries, 3)
    scores = vectors @ vectors.T
    want = [(q, r, k, int(scores[q, k])) for q in range(0, 1200, 40) for r, k in enumerate(sorted((k for k in range(1200) if k != q), key=lambda k: (-scores[q, k], k))[:3], 1)]
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.orderBy("query_id", "rank").collect()] == want
    assert regions == 24 and one.count() == 30 and two.count() < 30 * 23 / 2


def test_tree_prunes():
    rng = np.random.default_rng(0)
    centres = rng.integers(-200, 200, (20, 8))
    vectors = np.concatenate([c + rng.integers(-3, 4, (200, 8)) for c in centres])
    tree = topk.Tree(pd.DataFrame(topk.build_pages(np.arange(len(vectors)), vectors), columns=[c.split()[0] for c in topk.PAGE.split(", ")]))
    opened = []
    pages = tree.pages
    tree.pages = type("Spy", (dict,), {"__getitem__": lambda self, k: opened.append(k) or pages[k]})()
    best = tree.search(vectors[5], 5, 3)
    scores = sorted(((int(s), -k) for k, s in enumerate(vectors @ vectors[5]) if k != 5), reverse=True)[:3]
    assert best == [(s, -k) for s, k in scores] and len(opened) < len(pages)


def test_token_store(spark, docs, real, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_store.VOCABULARY)
    odd = spark.createDataFrame([(1000, "a\x1cb \x1d c"), (1001, "<|endoftext|> x<|startoftext|>"), (1002, "É é ́ ΑΣ ΑΣΑ   İ")], "doc_id long, text string")
    both = docs.select("doc_id", "text", "norm").unionByName(odd.withColumn("norm", F.lit(""))).unionByName(real.where("doc_id > 20").select("doc_id", "text", F.lit("").alias("norm")))
    path = f"file://{tmp_path}/tokens"
    token_store.write_packs(both, path)
    got = token_store.with_starts(token_store.read_packs(spark, path), path).orderBy("start").collect()
    ids = {}
    for r in both.collect():
        ids.setdefault(r["doc_id"], []).append(library.encode(r["text"] or "", add_special_tokens=False).ids + [2])
    start = 0
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda x: -1 if x is None else x)
    for r in got:
        found = np.frombuffer(r["ids"], "<u4").tolist()
        assert found in ids[r["doc_id"]] and r["n_tokens"] == len(found) and r["start"] == start
        start += len(found)
    assert len(got) == sum(map(len, ids.values()))
    pack = spark.read.parquet(f"{path}/packs").first()
    raw = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    opened = token_store.Pack(bytes(pack["blob"]), raw)
    assert opened.ids(len(opened.index) - 1)[-1] == token_store.END_ID
    with pytest.raises(ValueError):
        token_store.Pack(bytes(pack["blob"]), raw + b"x")
    token_store.write_packs(docs.limit(0), f"{path}-empty")
    assert token_store.with_starts(token_store.read_packs(spark, f"{path}-empty"), f"{path}-empty").count() == 0
    assert token_store.plain_crc32([1, 2]) == zlib.crc32(b"\1\0\0\0\2\0\0\0")


def held_accuracy(found, labels, column, folds, fold):
    pairs = [(r["predicted"], labels[r["doc_id"]]) for r in found if r["doc_id"] in labels and r["held_out"]]
    assert all(r["held_out"] == (quality.crc_mod(r["doc_id"], folds) == fold) for r in found)
    return pairs


def test_quality(spark, docs):
    base = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    found = quality.op9_quality(spark, base).collect()
    pairs = held_accuracy(found, labels, "quality", 5, 0)
    assert len(found) == 1000 and sum(a == b for a, b in pairs) / len(pairs) > 0.9 and all(0 <= r["score"] <= 1 for r in found)
    model = quality.train(spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet"))
    scored = quality.score_quality(docs, model).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r["__score"] <= 1 for r in scored)
    assert quality.score_quality(docs.limit(0), model).count() == 0
    empty = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {round(r["__score"], 6) for r in quality.score_quality(docs, empty).collect()} == {0.5}


def test_trees_learn_a_step():
    x = np.random.default_rng(0).random((400, 3))
    model = quality.fit_trees(x, (x[:, 1] > 0.4).astype(float), rounds=20)
    assert ((model.score(x) > 0.5) == (x[:, 1] > 0.4)).mean() > 0.98


def test_toxicity(spark, docs):
    base = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    found = toxicity.op10_toxicity(spark, base).where(F.col("doc_id").isin(list(labels))).collect()
    pairs = held_accuracy(found, labels, "toxic", 3, 1)
    hit = sum(a and b for a, b in pairs)
    assert hit / sum(a for a, _ in pairs) > 0.95 and hit / sum(b for _, b in pairs) > 0.8
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert len(toxicity.score_toxicity(docs, model).collect()) == len(TEXTS) and toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_label_model_finds_the_classes():
    rng = np.random.default_rng(3)
    y = rng.random(3000) < 0.2
    fired = np.stack([rng.random(3000) < np.where(y, a, b) for a, b in ((0.7, 0.02), (0.6, 0.03), (0.5, 0.02), (0.1, 0.1))], 1).astype(np.float32)
    fired = np.hstack([fired, fired[:, :1]])  # a voter that repeats another
    stated = np.array([0.8, 0.8, 0.8, 0.3, 0.8])
    model = toxicity.label_model(fired, stated, 0.2)
    best = np.log(0.25) + sum(np.where(fired[:, v], np.log(p / q), np.log((1 - p) / (1 - q))) for v, (p, q) in enumerate(((0.7, 0.02), (0.6, 0.03), (0.5, 0.02), (0.1, 0.1))))
    assert ((model.posterior > 0.5) == y).mean() > ((best > 0) == y).mean() - 0.05  # the rule that knows the true rates
    assert model.weight[4] < 0.7 < model.weight[3]
    truth = np.array([y[fired[:, v] > 0].mean() for v in range(5)])
    assert np.abs(model.accuracy - truth).max() < 0.12 and model.accuracy[3] < 0.4
    assert model.correlation[0, 4] > 0.9 and np.abs(model.correlation[:4, :4]).max() < 0.6
    turned = toxicity.label_model(fired, stated, 0.2).posterior  # labels are no input: wrong ones cannot be followed
    wrong = np.where(rng.random(3000) < 0.1, ~y, y)
    assert np.array_equal(turned, model.posterior) and ((turned > 0.5) != wrong).mean() > 0.05


def test_label_model_against_a_plain_loop():
    rng = np.random.default_rng(5)
    y = rng.random(400) < 0.3
    fired = np.stack([rng.random(400) < np.where(y, a, b) for a, b in ((0.6, 0.05), (0.5, 0.04), (0.4, 0.1))], 1).astype(np.float32)
    stated, prior = np.array([0.7, 0.8, 0.6]), 0.3
    post = [1.0 - math.prod(1 - s for s, f in zip(stated, row) if f) for row in fired]
    for _ in range(5):  # before the first estimate of correlations
        total, yes, no = sum(post), [], []
        for v in range(3):
            fires = sum(row[v] for row in fired)
            right = (sum(p for p, row in zip(post, fired) if row[v]) + toxicity.PRIOR * stated[v]) / (fires + toxicity.PRIOR)
            a, b = (right * fires + 0.01) / (total + 0.02), ((1 - right) * fires + 0.01) / (len(fired) - total + 0.02)
            yes.append(math.log(a / b))
            no.append(math.log((1 - a) / (1 - b)))
        odds = [sum(yes[v] if row[v] else no[v] for v in range(3)) + math.log(prior / (1 - prior)) for row in fired]
        post = [1 / (1 + math.exp(-o)) for o in odds]
    assert np.allclose(toxicity.label_model(fired, stated, prior, 5).posterior, post, atol=1e-4)


def test_voters_of_families_and_numbers_of_words():
    assert toxicity.family_voters([("abc", 1, 5.0), ("abcd", 1, 9.0), ("=abcde", 1, 3.0), ("abc", 2, 4.0), ("xyz", 1, 1.0)]) == [("abcd", 1), ("abc", 2), ("xyz", 1)]
    assert toxicity.family_voters([("tra", 1, 5.0), ("=trashy", 1, 4.0), ("xyz", 1, 1.0)], ["trash"]) == [("xyz", 1)]
    voters = toxicity.Voters({"abc": 0, "=idiot": 1}, np.array([1, 0, 0, 0]), np.array([1, 1, 2, 3]), np.zeros(8))
    for text, want in (("", [0, 0, 0, 0, 0]), ("Idiot! abcx", [1, 1, 0, 0, 2]), ("abcx abcx abcy", [0, 0, 1, 0, 2]), ("abc1 abcd abce abcf", [0, 0, 0, 1, 4])):
        assert voters.fired(text, {}).tolist() == want


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


def test_base_spans():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice("0123456789 .-+@ab()%_é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("1" * 50_000 + "." * 9 + "a" * 50_000) == []


HARMLESS = ["2024-03-05 12:30:11 build 10.4.22-7 passed 1 200 300", "The book 978-3-16-148410-0 costs 12.99 or 1,299.00 in all.", "Weights were 0.25, 0.50, 0.75, 1.00 in order.",
            "Seasons 1998/1999/2000/2001 were dry.", "See pages 120 - 134 - 156 of the report.", "Rooms 101, 102, 103, 104 are free; call after 10 at 14.30", "Version 3.11.2 came after 3.10.14 on 14.02.2023",
            "invoice 20240117-00042 of 1 234 567 units", "coordinates 48.85661, 2.35222 and -33.86882, 151.20929", "sections 1.2.3.4.5 and 7-8-9-10", "lot 1200 3400 5600 7800 was sold",
            "order 12-34-56 shipped 2021/12/24", "population 1.234.567 in 2019, 1.245.001 in 2020", "speed 300 000 000 m per s", "the at sign and the dot in names", "mail box 12 at gate 4"]


@pytest.mark.parametrize("kind, yes, no", [
    ("email", ["x_y (at) mail (dot) de", "bob[at]site.co.uk", "carl @ host.example.net", "anna.k at example dot org"], ["at mail.de", "12 at 3.45", "bob at home", "a dot b"]),
    ("ip", ["10[.]0[.]12[.]7", "8 dot 8 dot 4 dot 4", "172-16-254-1", "9,9,9,9"], ["10.4.22-7", "0.25, 0.50, 0.75", "1998/1999/2000/2001", "978-3-16-148410-0", "300-1-1-1"]),
    ("card", ["4111.1111.1111.1111", "4012_8888_8888_1881", "5500/0000/0000/0004"], ["4111.1111.1111.1112", "120 - 134 - 156", "4111-1111 1111.1111", "1234 5678"]),
    ("phone", ["(415) 555-2671", "0049 30 1234567", "+ 44 20 7946 0958"], ["2024-03-05 12", "14.02.2023", "1 200 300", "1,234,567,890", "12:30:11 12345"])])
def test_plausible_spans(kind, yes, no):
    assert [t for t in yes if not pii.plausible(kind, t)] == [] and [t for t in no if pii.plausible(kind, t)] == []


def test_pii(spark, docs, real):
    texts = spark.createDataFrame([(101, "write to jo.smith42@mail7.example.com or +1 (415) 555-2671 from 10.0.0.1"), (102, None), (103, "4111 1111 1111 1111 ok"), (103, "4111 1111 1111 1111 ok")], "doc_id long, text string")
    large = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tagger = pii.train(large.where("doc_id % 7 != 3"))
    found = [(r["doc_id"], [tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]) for r in pii.find_pii(texts, tagger).collect()]
    by = {i: (b, s) for i, b, s in found}
    assert by[102] == ([], []) and len(found) == 4
    for r in texts.collect():
        assert by[r["doc_id"]][0] == plain_spans(r["text"] or "") and set(by[r["doc_id"]][0]) <= set(by[r["doc_id"]][1])
    fresh = large.where("doc_id % 7 = 3").orderBy("doc_id")
    written, wanted = [], {}
    for r in fresh.collect():  # spans that no pattern matches, in documents the tagger was not trained on
        text, _, new = pii.rewritten(r["text"] or "", r["doc_id"])
        written.append((r["doc_id"], text))
        wanted[r["doc_id"]] = new
    found = pii.find_pii(spark.createDataFrame(written, "doc_id long, text string"), tagger).collect()
    added = {r["doc_id"]: [tuple(s) for s in r["spans"] if s not in r["base"]] for r in found}
    hit = sum(len(set(wanted[i]) & set(added[i])) for i in wanted)
    assert hit / sum(map(len, wanted.values())) > 0.6 and hit / sum(map(len, added.values())) > 0.8
    assert [s for t, s in zip(HARMLESS, pii.added_spans(HARMLESS, [pii.base_spans(t) for t in HARMLESS], tagger)) if s] == []
    assert pii.find_pii(docs, tagger).count() == len(TEXTS) and pii.find_pii(docs.limit(0), tagger).count() == 0
    assert pii.train(docs.limit(0)).p["move"].shape == (pii.TAGS, pii.TAGS)
    assert pii.plain_digest([("phone", 1, 2), ("email", 5, 9), ("email", 3, 4)]) == hashlib.sha256(b"email:3:4,email:5:9,phone:1:2").hexdigest()


def test_paths_against_enumeration():
    tagger = pii.Tagger(4)
    rng = np.random.default_rng(6)
    tagger.p["move"] = rng.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    e = rng.standard_normal((2, 4, pii.TAGS)).astype(np.float32) * 2
    move = tagger.p["move"] + tagger.banned
    paths = list(itertools.product(range(pii.TAGS), repeat=4))
    for k in range(2):
        score = np.array([tagger.begin[p[0]] + sum(e[k, t, p[t]] for t in range(4)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths], float)
        assert tuple(tagger.viterbi(e)[k]) == paths[int(score.argmax())]
        chance = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        want = np.zeros((4, pii.TAGS))
        for p, c in zip(paths, chance):
            want[np.arange(4), p] += c
        assert np.allclose(tagger.marginals(e)[0][k], want, atol=1e-4)


def test_windows_are_averaged_over_the_text():
    tagger = pii.Tagger(2)
    text = "word " * 30 + "call 415 555 2671 now " + "word " * 30 + "x"
    (places, mean), = pii.mean_marginals([text], tagger)
    starts = pii.windows_of(text)
    assert sorted(places) == sorted({p for s in starts for p in range(s, min(s + pii.WINDOW, len(text)))}) and np.allclose(mean.sum(1), 1, atol=1e-4)
    at = text.index("555")
    total = np.zeros(pii.TAGS)
    for s in starts:
        if s <= at < s + pii.WINDOW:
            codes = np.full(pii.WINDOW, pii.CODES - 1)
            part = pii.codes_of(text)[s:s + pii.WINDOW]
            codes[:len(part)] = part
            total += tagger.marginals(tagger.emissions(codes[None])[0])[0][0, at - s] * min(at - s + 1, pii.WINDOW - (at - s))
    assert np.allclose(mean[list(places).index(at)], total / total.sum(), atol=1e-4)
    long = "1" * 40_000  # every place is looked at
    assert len(pii.mean_marginals([long], tagger)[0][0]) == 40_000 and pii.mean_marginals(["", "no place"], tagger)[1][0].size == 0
    assert all(0 <= a < b <= 40_000 for _, a, b in pii.added_spans([long], [[]], tagger)[0])


def test_rewritten_spans_leave_the_patterns():
    text = "mail a.b7@c.de or 10.0.0.1 and +1 (415) 555-2671 or 4111 1111 1111 1111 end"
    kinds = set()
    for seed in range(200):
        out, spans, new = pii.rewritten(text, seed)
        assert len(spans) == 4 and [k for k, _, _ in spans] == ["email", "ip", "phone", "card"] and set(new) <= set(spans)
        assert out.startswith("mail ") and out.endswith(" end") and pii.windows_of(out)
        assert not set(new) & set(pii.base_spans(out))
        kinds |= {k for k, _, _ in new}
    assert kinds == set(pii.KINDS) and pii.rewritten("", 1) == ("", [], [])


def test_tagger_gradients():
    tagger = pii.Tagger(1)
    x, y = pii.training_windows("mail a.b7@c.de or 10.0.0.1 and +1 (415) 555-2671 but not 12 of 99 things")
    grad = tagger.gradients(x, y)

    def loss():
        e, _ = tagger.emissions(x)
        _, _, _, z, move = tagger.marginals(e)
        return sum(z[k] - e[k, np.arange(pii.WINDOW), t].sum() - tagger.begin[t[0]] - move[t[:-1], t[1:]].sum() for k, t in enumerate(y)) / len(x)

    for name in ("embed", "xf", "hb", "out", "move"):
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        kept = tagger.p[name][at]
        tagger.p[name][at] = kept + 1e-2
        up = loss()
        tagger.p[name][at] = kept - 1e-2
        down = loss()
        tagger.p[name][at] = kept
        assert abs((up - down) / 2e-2 - grad[name][at]) < 0.1 * abs(grad[name][at]) + 1e-2


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns
        docs = exact_dedup.staged(after, "stage")
    assert corpus_pipeline.run(spark, sf_dir).count() == docs.count() > 0
