"""Operator 3: byte-level BPE encoding and decoding.

Merges are folded by Spark higher-order functions over the bytes of distinct words, by ranks that are one row, broadcast to
rows of many words each. Words are the matches of the split pattern.

1. Count the words of `SAMPLE_DOCS` documents at most (those with the smallest hash of their id).
2. Fold the most frequent of them, `HOT_WORDS` at most, once each. Their number and length are bounded, so they go to every
   task, as two flat Arrow arrays. Which words these are decides only where a word is folded, not what it becomes.
3. Walk the documents in slices of a few MB: a slice's distinct words are looked up at once. A slice becomes one row of its
   documents' ids, where ids of words that are not known are left open, and of these words, each once. The rows are staged.
4. Fold the words of every such row with the same expression, and close the row's open places. Nothing is shuffled.

Words of over `LONG_WORD` bytes, for which a fold over arrays would take time with the square of the length, are merged
by a queue of ranked pairs instead; the result is the same. Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, slices, staged, text_of

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bounds of what is sent to every task: words, and bytes of each.
HOT_WORDS, HOT_BYTES = 1 << 20, 32
#: Bound of the documents that frequent words are chosen from.
SAMPLE_DOCS = 50_000
LONG_WORD = 400
BUCKETS, SPREAD = 1 << 15, 31
NO_RANK = (1 << 31) - 1

# Fixed value: the white space of the split pattern, spelled out, since libraries differ on U+001C to U+001F.
EDGE = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPACE = "".join(f"\\u{ord(x):04x}" for x in sorted(EDGE))
SPLIT = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s\p", rf"[^{SPACE}\p").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def rank_row(spark: SparkSession, path: str = RANKS) -> DataFrame:
    """One row, ranks: ids of single bytes by value, and ids of merged pairs in buckets, keys and ids side by side. A piece
    is known by its id, which is its rank; a pair's key is first id x 2^20 + second id. A task builds the row. It is no
    literal, since Spark's driver writes a literal out in every text of a plan and keeps these."""

    def build(_):
        table = read_ranks(path)
        keys: list[list[int]] = [[] for _ in range(BUCKETS)]
        ids: list[list[int]] = [[] for _ in range(BUCKETS)]
        for piece, rank in table.items():
            for cut in range(1, len(piece)):
                first, second = table.get(piece[:cut]), table.get(piece[cut:])
                if first is not None and second is not None:
                    at = (first * SPREAD + second) % BUCKETS
                    keys[at].append((first << 20) + second)
                    ids[at].append(rank)
        columns = [pa.array([table[bytes([k])] for k in range(256)], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.int32()))]
        ranks = pa.StructArray.from_arrays([in_one(c) for c in columns], ["single", "keys", "ids"])
        yield pa.RecordBatch.from_arrays([ranks], names=["ranks"])

    return staged(spark.range(0, 1, 1, 1).mapInArrow(build, "ranks struct<single array<int>, keys array<array<bigint>>, ids array<array<int>>>"), "ranks")


def in_one(column: pa.Array) -> pa.ListArray:
    """All of a column as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


def pair_rank(ranks: Column, first: Column, second: Column) -> Column:
    """The rank of a pair of ids, NO_RANK for none."""
    at = ((first * SPREAD + second) % BUCKETS).cast("int")
    place = F.array_position(F.get(ranks["keys"], at), first.cast("bigint") * (1 << 20) + second).cast("int") - 1
    return F.coalesce(F.get(F.get(ranks["ids"], at), place), F.lit(NO_RANK))


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def fold_merges(rows: DataFrame, words: str, ranks: DataFrame) -> DataFrame:
    """rows with a column folded, the ids of each of a row's words; these are Latin-1 strings of their bytes. A row should
    have many words, as it gets the ranks beside it."""
    folded = _bind(F.col("ranks"), lambda ranks: F.transform(words, lambda w: _fold(w, ranks)))
    return rows.crossJoin(F.broadcast(ranks)).select(*rows.columns, folded.alias("folded"))


def _fold(word: Column, ranks: Column) -> Column:
    """ids of a word: always merge the leftmost pair of lowest rank.

    The fold carries p, the ids so far, and r, the rank of every pair of neighbours. A merge at k puts the pair's rank in
    place of both ids and looks up the two pairs that are new.
    """
    def start(ids: Column) -> Column:
        pairs = F.transform(F.slice(ids, 1, F.size(ids) - 1), lambda x, i: pair_rank(ranks, x, F.get(ids, i + 1)))
        return F.struct(ids.alias("p"), pairs.alias("r"), F.array_min(pairs).alias("low"))

    def merge(acc: Column, k: Column) -> Column:  # k counts from 1; lambdas with an index are far cheaper than slices
        p, r, new = acc["p"], acc["r"], acc["low"]
        pairs = F.transform(r, lambda x, i: F.when(i == k - 2, pair_rank(ranks, F.get(p, i), new))
                            .when(i == k, pair_rank(ranks, new, F.get(p, i + 1))).otherwise(x))
        ids = F.filter(F.transform(p, lambda x, i: F.when(i == k - 1, new).otherwise(x)), lambda x, i: i != k)
        return _bind(F.filter(pairs, lambda x, i: i != k - 1), lambda r: F.struct(ids.alias("p"), r.alias("r"), F.array_min(r).alias("low")))

    def step(acc: Column, _: Column) -> Column:
        return F.when(F.coalesce(acc["low"], F.lit(NO_RANK)) == NO_RANK, acc).otherwise(
            _bind(F.array_position(acc["r"], acc["low"]).cast("int"), lambda k: merge(acc, k)))

    ids = F.transform(F.split(word, ""), lambda c: F.get(ranks["single"], F.ascii(c)))
    return _bind(ids, lambda ids: F.aggregate(F.sequence(F.lit(1), F.size(ids)), start(ids), step, lambda acc: acc["p"]))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one long word, by a queue of ranked pairs: n log n."""
    n = len(word)
    end = list(range(1, n + 1))
    back = list(range(-1, n - 1))
    alive = [True] * n
    queue: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (rank := ranks.get(word[i:end[j]])) is not None:
            heapq.heappush(queue, (rank, i, j, end[j]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, j, stop = heapq.heappop(queue)
        if alive[i] and end[i] == j and alive[j] and end[j] == stop:
            alive[j] = False
            end[i] = stop
            if stop < n:
                back[stop] = i
            offer(i)
            if back[i] >= 0:
                offer(back[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


# White space beside a space, at an end or of other kinds: such a text is not cut at its spaces.
ODD = "[" + "".join(sorted(EDGE - {" ", "\n"})) + "]|  | \n|\n |^[ \n]|[ \n]$"


#: Latin letters, or ASCII digits, behind a space or none: one match of the pattern in every version of Unicode.
SIMPLE = "^ ?([A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+)$"


class Units:
    """Texts as sequences of units. A text is cut at its single spaces, where no match of the pattern can cross; its first
    chunk is a unit, and so is every further chunk with its space. An odd text is one unit. Chunks that repeat in the
    texts are one unit; units: the distinct ones, at: the unit of every place, ends: the places of each text, summed."""

    def __init__(self, texts: pa.StringArray):
        odd = pc.match_substring_regex(texts, ODD)
        whole = odd.to_numpy(zero_copy_only=False).astype(bool)
        parts = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        chunks = parts.flatten().dictionary_encode()
        count = np.ones(len(texts), np.int64)
        count[~whole] = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
        self.ends = np.cumsum(count)
        place = chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(count[~whole]) - count[~whole]
        spaced = np.ones(len(place), bool)
        spaced[first] = False
        used = np.zeros(len(chunks.dictionary), bool)
        used[place[spaced]] = True
        number = np.cumsum(used) - 1
        led = pc.binary_join_element_wise(" ", chunks.dictionary.filter(pa.array(used)), "")
        bare = chunks.dictionary.take(chunks.indices.take(pa.array(first)))
        self.units = pa.concat_arrays([led, bare, texts.filter(odd)])
        inside = number[place]
        inside[first] = len(led) + np.arange(len(first))
        self.at = np.empty(int(self.ends[-1]) if len(count) else 0, np.int64)
        even = np.repeat(~whole, count)
        self.at[even] = inside
        self.at[~even] = len(led) + len(bare) + np.arange(int(whole.sum()))


def words_of(units: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct words of the units, the word of every match of the pattern, unit after unit, and each unit's matches.
    A simple unit is one match."""
    simple = pc.match_substring_regex(units, SIMPLE)
    one = simple.to_numpy(zero_copy_only=False).astype(bool)
    found = [SPLIT.findall(u) for u in units.filter(pc.invert(simple)).to_pylist()]
    counts = np.ones(len(units), np.int64)
    counts[~one] = np.fromiter(map(len, found), np.int64, len(found))
    words = pa.concat_arrays([units.filter(simple), pa.array(chain.from_iterable(found), pa.string())]).dictionary_encode()
    place = words.indices.to_numpy(zero_copy_only=False)
    at = np.empty(len(place), np.int64)
    single = np.repeat(one, counts)
    at[single] = place[:int(one.sum())]
    at[~single] = place[int(one.sum()):]
    return words.dictionary, at, counts


def regroup(lists: pa.ListArray, counts: np.ndarray) -> pa.ListArray:
    """Neighbouring lists joined: counts[k] of them make list k."""
    ends = np.concatenate(([0], np.cumsum(counts)))
    return pa.ListArray.from_arrays(lists.offsets.take(pa.array(ends)), lists.values)


def look_up(texts: pa.StringArray, words: pa.StringArray, ids: pa.ListArray, table: dict[bytes, int]) -> tuple[pa.ListArray, list[str]]:
    """The ids of every text by known words and their ids, and the other words as Latin-1 strings of their bytes: the k-th
    of them stands in a text as -1 - k."""
    texts = Units(texts)
    distinct, at, counts = words_of(texts.units)
    found = pc.index_in(words, value_set=distinct)  # this way round the table of hashes is a slice's
    known = found.is_valid().to_numpy(zero_copy_only=False).nonzero()[0]
    place = np.full(len(distinct), -1)
    place[found.drop_null().to_numpy()] = np.arange(len(known))
    lists, opened = [], []
    for w in distinct.filter(pa.array(place < 0)).to_pylist():
        raw = w.encode()
        if len(raw) > LONG_WORD:
            lists.append(merge_long(raw, table))
        else:
            opened.append(raw.decode("latin-1"))
            lists.append([-len(opened)])
    place[place < 0] = len(known) + np.arange(len(lists))
    pool = pa.concat_arrays([ids.take(pa.array(known)), pa.array(lists, ids.type)])
    split = regroup(pool.take(pa.array(place[at])), counts)
    return regroup(split.take(pa.array(texts.at)), np.diff(texts.ends, prepend=0)), opened


def as_binary(values: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """Rows of numbers, given one after the other with the end of each row, as bytes."""
    offsets = np.concatenate(([0], ends * values.itemsize)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def numbers(column: pa.BinaryArray, dtype: str = "<i4") -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column without nulls, and where each row's end."""
    width = np.dtype(dtype).itemsize
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype, int(ends[-1] - ends[0]) // width, int(ends[0])) if data is not None else np.zeros(0, dtype)
    return values, (ends[1:] - ends[0]) // width


def flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of lists, and where each list's end."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[ends[0]:ends[-1]], ends[1:] - ends[0]


def close(values: np.ndarray, ends: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values with every open place -1 - k replaced by its word's ids, ids[starts[k]:][:sizes[k]], and the new ends."""
    left_open = values < 0
    if not left_open.any():
        return values, ends
    word = -1 - values[left_open]
    n = np.ones(len(values), np.int64)
    n[left_open] = sizes[word]
    after = np.cumsum(n)
    out = np.empty(int(after[-1]), "<i4")
    out[(after - n)[~left_open]] = values[~left_open]
    n = sizes[word]
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(after[left_open] - n, n) + step] = ids[np.repeat(starts[word], n) + step]
    return out, np.concatenate(([0], after))[ends]


def pieces_of(table: dict[bytes, int]) -> pa.BinaryArray:
    """The pieces by id."""
    out = [b""] * (max(table.values()) + 1)
    for piece, rank in table.items():
        out[rank] = piece
    return pa.array(out, pa.binary())


def decoded(values: np.ndarray, ends: np.ndarray, pieces: pa.BinaryArray) -> pa.BinaryArray:
    """The pieces of each row's ids, concatenated."""
    taken = pieces.take(pa.array(values))
    at = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)[np.concatenate(([0], ends))]
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.copy()), taken.buffers()[2] or pa.py_buffer(b"")])


def count_words(texts: DataFrame) -> DataFrame:
    """w, n: every distinct word of column text with its count over all rows."""

    def run(batches):
        for batch in slices(batches, 0):
            texts = Units(batch.column(0))
            times = np.bincount(texts.at, minlength=len(texts.units))
            words, at, counts = words_of(texts.units)
            n = np.bincount(at, np.repeat(times, counts), len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([words, pa.array(n)], names=["w", "n"])

    return texts.mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def latin(word: Column) -> Column:
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def hot_words(rows: DataFrame, ranks: DataFrame, most: int = HOT_WORDS) -> tuple[pa.StringArray, pa.ListArray]:
    """The most frequent words of the sample, `most` at most, and their ids: all words from a count on, ties in or out
    together. rows: doc_id, text."""
    none = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
    h = F.xxhash64("doc_id")
    cut = rows.select(h.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    if cut is None or not most:
        return none
    texts = rows.where(h <= cut).select("text")  # ties of the last hash come along
    counts = staged(count_words(texts), "words").where(F.octet_length("w") <= HOT_BYTES)
    down = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = (counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).withColumn("through", F.sum("words").over(down))
             .where(F.col("through") <= most).agg(F.min("n")).first()[0])
    if least is None:
        return none
    pa.set_memory_pool(pa.system_memory_pool())
    parts = 8 * rows.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: by cores, not by size

    def gather(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([in_one(column) for column in batch.columns], names=["words", "raw"])

    lists = (counts.where(F.col("n") >= least).select("w", latin(F.col("w")).alias("raw")).repartition(parts)
             .mapInArrow(gather, "words array<string>, raw array<string>"))
    found = fold_merges(lists, "raw", ranks).select("words", "folded").toArrow()
    out = []
    for kind in none:  # a column at a time, so that the driver holds each twice only while it is joined
        column, found = found.column(0), found.remove_column(0)
        out.append(pa.concat_arrays([*(chunk.flatten().cast(kind.type) for chunk in column.chunks), kind]))
        del column
    return tuple(out)


def _encoded(docs: DataFrame, id_col: str, text_col: str, ranks_path: str, most: int, decode_too: bool) -> DataFrame:
    table = read_ranks(ranks_path)
    ranks = rank_row(docs.sparkSession, ranks_path)
    rows = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("text"))
    hot = docs.sparkSession.sparkContext.broadcast(hot_words(rows, ranks, most))
    kind = dict(rows.dtypes)["doc_id"]

    narrow = max(table.values()) < 0xFFFF  # ids take two bytes between walk and fill, 0xFFFF for an open place

    def walk(batches):
        pa.set_memory_pool(pa.system_memory_pool())  # gives freed memory back
        words, ids = hot.value
        table = read_ranks(ranks_path)
        for batch in slices(batches, 1):
            lists, opened = look_up(batch.column(1), words, ids, table)
            values, ends = flat(lists)
            left = -1 - values[values < 0]
            if narrow:
                values = np.where(values < 0, 0xFFFF, values).astype("<u2")
            yield pa.RecordBatch.from_arrays([in_one(batch.column(0)), in_one(as_binary(values, ends)), pa.array([left.astype("<i4").tobytes()], pa.binary()),
                                              pa.array([opened], pa.list_(pa.string()))], names=["doc_id", "ids", "left", "opened"])

    def fill(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        pieces = pieces_of(read_ranks(ranks_path)) if decode_too else None
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, ids, left, words = (batch.column(c).slice(k, 1) for c in range(4))
                values, ends = numbers(ids.flatten(), "<u2" if narrow else "<i4")
                if narrow:
                    values = values.astype("<i4")
                    values[values == 0xFFFF] = -1 - np.frombuffer(left[0].as_py(), "<i4")
                words = words.flatten()  # a list of ids for each word
                found, stops = flat(words)
                sizes = np.diff(stops, prepend=0)
                values, ends = close(values, ends, found, stops - sizes, sizes)
                out = [doc_ids.flatten(), as_binary(values, ends), *([decoded(values, ends, pieces)] if decode_too else [])]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "decoded"][:len(out)])

    walked = staged(rows.mapInArrow(walk, f"doc_id array<{kind}>, ids array<binary>, left binary, opened array<string>"), "walked")
    hot.destroy()
    folded = fold_merges(walked, "opened", ranks).select("doc_id", "ids", "left", "folded")
    return folded.mapInArrow(fill, f"doc_id {kind}, ids binary" + ", decoded binary" * decode_too)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS,
           most: int = HOT_WORDS) -> DataFrame:
    """doc_id and ids (binary: unsigned 32-bit little-endian) of every row.

    Null text counts as empty; an empty text has no ids. Special tokens in a text are ordinary text. Rows are encoded one
    by one, so ties, null ids and repeated rows pass through; an empty table gives an empty result; extra columns are
    ignored.
    """
    return _encoded(docs, id_col, text_col, ranks_path, most, False)


def decode(encoded: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """The rows with a column decoded (binary): the pieces of the ids, concatenated."""

    @F.arrow_udf("binary")
    def join(column: pa.Array) -> pa.Array:
        return decoded(*numbers(column), _pieces(ranks_path))

    return encoded.withColumn("decoded", join("ids"))


_PIECES: dict[str, pa.BinaryArray] = {}


def _pieces(path: str) -> pa.BinaryArray:
    if path not in _PIECES:
        _PIECES[path] = pieces_of(read_ranks(path))
    return _PIECES[path]


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS, most: int = HOT_WORDS) -> DataFrame:
    """encode() with decode()'s column beside it, in one pass through Python."""
    return _encoded(docs, id_col, text_col, ranks_path, most, True)


def encode_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return round_trip(docs).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                                   F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir))
