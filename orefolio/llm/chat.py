"""Operator 4: chat formatting by schema fingerprints.

A record's fingerprint is a hash of its nested field paths. It selects a declarative mapping that turns the record's
layout (rows by turn, prompt and response, instruction with input and output, message lists) into canonical turns.
Turns of a conversation are brought together in order and formatted as a stream: a task keeps one turn at a time, however
long a conversation is. The template marks turns and breaks control strings inside texts reversibly.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The template's own strings, and the strings of common templates that a text must not smuggle in.
OPENING, AFTER_ROLE, CLOSING = "<|turn:", "|>\n", "\n<|end|>\n"
CONTROL = re.compile(r"<\||</?s>|\[/?INST\]")
ESCAPE = "\\"


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of every control string."""
    return CONTROL.sub(lambda m: m[0][0] + ESCAPE + m[0][1:], text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def field_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a parsed record; list items share one path, empty containers are paths of their own."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}") for k, v in value.items())) if value else {at + "{}"}
    if isinstance(value, list):
        return set().union(*(field_paths(v, at + "[]") for v in value)) if value else {at + "[]"}
    return {at}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns. `turns`: (role, field) pairs in order; or `each`: a list field (empty: the record
    itself) with the fields of role and text. Fields in `optional` may be missing; null optional fields make no turn."""

    turns: tuple[tuple[str, str], ...] = ()
    each: str | None = None
    role: str = ""
    text: str = ""
    optional: tuple[str, ...] = ()

    def layouts(self) -> list[set[str]]:
        if self.each is None:
            fixed = {f".{f}" for _, f in self.turns if f not in self.optional}
            found = [fixed]
            for f in self.optional:
                found += [x | {f".{f}"} for x in found]
            return found
        stem = f".{self.each}[]" if self.each else ""
        return [{f"{stem}.{self.role}", f"{stem}.{self.text}"}]

    def apply(self, record: dict) -> list[tuple[str, str]]:
        if self.each is None:
            return [(role, record.get(f) or "") for role, f in self.turns if f not in self.optional or record.get(f) is not None]
        items = record[self.each] if self.each else [record]
        return [(x.get(self.role) or "", x.get(self.text) or "") for x in items]


# The layouts that are known.
MAPPINGS = (
    Mapping(each="", role="role", text="text"),
    Mapping(each="", role="role", text="content"),
    Mapping(each="messages", role="role", text="content"),
    Mapping(each="conversations", role="from", text="value"),
    Mapping(turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping(turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Mapping(turns=(("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("input",)),
)
# Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def by_fingerprint(mappings=MAPPINGS) -> dict[str, Mapping]:
    return {fingerprint(paths): m for m in mappings for paths in m.layouts()}


def canonical_turns(records: DataFrame, mappings=MAPPINGS) -> DataFrame:
    """records: conv_id, turn (place of the record in its conversation), record (JSON) -> conv_id, turn, part, role, text.

    A record that does not parse or has an unknown layout raises with its fingerprint: nothing is dropped silently. A null
    record makes no turn; null texts and roles read as empty.
    """
    table = by_fingerprint(mappings)

    def run(batches):
        for batch in batches:
            out = {"conv_id": [], "turn": [], "part": [], "role": [], "text": []}
            for conv, turn, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if raw is None:
                    continue
                record = json.loads(raw)
                found = table.get(mark := fingerprint(field_paths(record)))
                if found is None:
                    raise ValueError(f"no mapping for layout {mark}: {sorted(field_paths(record))[:20]}")
                for part, (role, text) in enumerate(found.apply(record)):
                    for name, value in zip(out, (conv, turn, part, ROLES.get(role, role), text)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, SCHEMA)

    return records.select("conv_id", "turn", "record").mapInArrow(run, "conv_id long, turn long, part int, role string, text string")


SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("part", pa.int32()), ("role", pa.string()), ("text", pa.string())])
ORDER = ["conv_id", "turn", "part", "role", "text"]


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, place, formatted, loss_from, loss_to: the formatted conversation in pieces, in order within a task; the
    mask covers code points loss_from to loss_to of the piece (equal: none), which is an assistant's text."""

    def run(batches):
        last, place = object(), 0
        for batch in batches:
            out = {"conv_id": [], "place": [], "formatted": [], "loss_from": [], "loss_to": []}
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 3, 4))):
                last, place = conv, place + 1 if conv == last else 0
                head = OPENING + escape(role) + AFTER_ROLE
                body = escape(text)
                to = len(head) + len(body)
                for name, value in zip(out, (conv, place, head + body + CLOSING, len(head) if role == "assistant" else to, to)):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("formatted", pa.string()),
                                                             ("loss_from", pa.int64()), ("loss_to", pa.int64())]))

    return (turns.repartition("conv_id").sortWithinPartitions(*ORDER)
            .mapInArrow(run, "conv_id long, place long, formatted string, loss_from long, loss_to long"))


TURN = re.compile(re.escape(OPENING) + "(.*?)" + re.escape(AFTER_ROLE) + "(.*)" + re.escape(CLOSING), re.DOTALL)


def read_formatted(pieces: DataFrame) -> DataFrame:
    """Read back from the formatted pieces, as they come from format_turns: one row per conversation with n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. A task keeps two running digests, not the conversation."""

    def run(batches):
        state, last = None, object()
        fields = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        schema = pa.schema([(f, pa.string() if "sha" in f else pa.int64()) for f in fields])

        def ended():
            n, turns, chars, loss, total = state
            row = (last, n, turns.hexdigest(), chars, loss.hexdigest(), total)
            return {f: v for f, v in zip(fields, row)}

        for batch in batches:
            done = []
            for conv, text, start, stop in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if state is None or conv != last:
                    if state is not None:
                        done.append(ended())
                    state, last = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], conv
                role, body = map(unescape, TURN.fullmatch(text).groups())
                masked = unescape(text[start:stop])
                state[0] += 1
                state[1].update(f"{role}\n{body}\n".encode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += len(text)
            yield pa.RecordBatch.from_pylist(done, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([ended()], schema)

    return pieces.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_records(conversations: DataFrame) -> DataFrame:
    """The table's rows as JSON records in the rows-by-turn layout."""
    return conversations.select("conv_id", "turn", F.to_json(
        F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("record"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, which comes as a prompt-and-response record. Turns are ordered by turn, then
    role and text; null roles and texts read as empty; repeated rows are repeated turns; extra columns are ignored."""
    extra = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, json.dumps({"prompt": extra, "response": extra}))], "conv_id long, turn long, record string")
    rows = conversation_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return read_formatted(format_turns(canonical_turns(rows.unionByName(own))))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, v.t, v.r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(19 + length(role) + length(text) + length(text) - length(replace(text, '\', ''))
                + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
