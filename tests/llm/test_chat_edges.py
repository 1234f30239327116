"""op4 on null ids, roles and texts, repeated rows, ties, very long texts and clashing columns, against its SQL."""

import duckdb

from orefolio.llm import chat


def test_chat_edges_equal_sql(spark, tmp_path):
    long = "<|end|> \\ </s> é😀 " * 40_000
    rows = [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (1, 0, "user", "same"), (1, 0, "user", "same"), (1, 0, "assistant", "tie"), (1, None, None, None), (2, 0, "assistant", long),
            (2, 1, "assistant", ""), (3, 5, "tool", "\\"), (-1, 9, "user", "clashes with the added one"), (4, 0, "", "[/INST]")]
    table = spark.createDataFrame([(*r, "rec", 1, 2, "f") for r in rows], "conv_id long, turn long, role string, text string, record string, part int, place long, formatted string")
    (tmp_path / "sf").mkdir()
    table.write.parquet(str(tmp_path / "sf/conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/sf/conversations.parquet/*.parquet'")
    names = "conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars"
    rows_of = lambda found: sorted(map(repr, found))
    got = rows_of(tuple(r) for r in chat.op4_chat_format(spark, str(tmp_path / "sf")).select(*names.split(", ")).collect())
    order = chat.SQL.replace("ORDER BY turn, role, text", "ORDER BY turn NULLS FIRST, role, text")  # the table's turns are never null
    want = rows_of(con.execute(f"select {names} from ({order})").fetchall())
    assert [x for x in got if x not in want] == [x for x in want if x not in got]
    spark.createDataFrame([], table.schema).write.parquet(str(tmp_path / "none/conversations.parquet"))
    assert [r["conv_id"] for r in chat.op4_chat_format(spark, str(tmp_path / "none")).collect()] == [-1]
