"""Decisions reach their own rows when the input is cut into other splits between the scans."""

import pytest

from orefolio.llm import exact_dedup, mixing, near, simhash

SPLITS = "spark.sql.files.maxPartitionBytes"
COST = "spark.sql.files.openCostInBytes"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("parts") / "docs")
    rows = [(k, f"alpha {'beta ' * (k % 7)} row {k if k % 2 else 0}", "ab"[k % 2]) for k in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(9).write.parquet(path)
    return path


@pytest.mark.parametrize("stage", [exact_dedup.drop_copies, simhash.drop_near_duplicates, mixing.take_mix])
def test_tags_are_computed_once(spark, parts, stage):
    docs = spark.read.parquet(parts)

    def kept(cut_anew):
        before = {key: spark.conf.get(key) for key in (SPLITS, COST)}
        try:
            found = stage(docs)
            if cut_anew:  # as when executors join or leave
                spark.conf.set(SPLITS, "1k")
                spark.conf.set(COST, "1k")
            return sorted(r["doc_id"] for r in found.collect())
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)

    same = kept(False)
    assert len(same) > 0 and kept(True) == same


@pytest.mark.parametrize("stage", [exact_dedup.drop_copies, simhash.drop_near_duplicates, near.drop_near_copies, mixing.take_mix])
def test_columns_of_any_name_come_back(spark, stage):
    """Columns named like the operators' own, with dots and quotes, keep their values; repeated and missing ids too."""
    names = ["__rid", "__copy", "__copies", "norm", "digest", "u", "size", "node", "a.b", "x`y", "text", "doc_id", "source"]
    texts = ["one two three four five six", "One two three four five six", None, "seven eight nine ten eleven twelve", "seven eight nine ten eleven twelve"]
    rows = [tuple(f"{n}-{k}" for n in names[:-3]) + (t, i, "s") for k, (t, i) in enumerate(zip(texts, (1, 2, 3, None, None)))]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n.replace('`', '``')}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    found = stage(docs)
    assert found.columns == names
    got = {tuple(r) for r in found.collect()}
    assert got <= set(rows) and {r[-3] and r[-3].lower() for r in got} >= {"one two three four five six", "seven eight nine ten eleven twelve"}


def test_mix_of_repeated_ids_equals_sql(spark):
    import duckdb

    rows = [(k % 40 if k % 5 else None, f"word{k % 90} " * (k % 13), f"s{k % 4}" if k % 11 else None) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.execute("create table d as select try_cast(doc_id as bigint) doc_id, text, source from documents")
    con.unregister("documents")
    con.execute("create view documents as select * from d")
    names = "doc_id, size, source_size, target, taken"
    want = con.execute(f"select {names} from ({mixing.SQL})").fetchall()
    got = [tuple(r) for r in mixing.mix(docs).select(*names.split(", ")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 400
    again = [tuple(r) for r in mixing.mix(docs.repartition(7)).select(*names.split(", ")).collect()]
    assert sorted(map(repr, again)) == sorted(map(repr, got))
