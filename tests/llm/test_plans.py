"""What Spark's driver keeps of executions: plans hold no tables of an operator."""

from pyspark.sql import functions as F

from orefolio.llm import bpe, simhash


def kept_nodes(spark, after=-1):
    """Texts of the plan's nodes by execution, as Spark keeps them, for executions with larger ids."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    found, runs = {}, store.executionsList()
    for run in (runs.apply(k).executionId() for k in range(runs.size())):
        if run > after:
            nodes = store.planGraph(run).allNodes()
            found[run] = [nodes.apply(k).desc() for k in range(nodes.size())]
    return found


def test_ranks_stand_in_no_plan(spark):
    docs = spark.createDataFrame([(1, "Hello World again and again"), (2, "hello wörld 123")], "doc_id long, text string")
    before = max(kept_nodes(spark), default=-1)
    text_length = spark.conf.get("spark.sql.maxPlanStringLength")
    found = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.round_trip(docs).collect()}
    assert found == {1: "Hello World again and again", 2: "hello wörld 123"}
    kept = [sum(map(len, nodes)) for nodes in kept_nodes(spark, before).values()]
    assert len(kept) >= 4 and max(kept) < 50_000  # 1.77 million with the ranks as a literal
    assert spark.conf.get("spark.sql.maxPlanStringLength") == text_length


def test_variants_are_counted_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARE", 100, raising=False)
    prints = spark.range(250, numPartitions=1).select(F.xxhash64("id").alias("fp"))
    near = prints.unionByName(prints.limit(3).select(F.col("fp").bitwiseXOR(F.lit(3)).alias("fp"))).coalesce(1)
    before = max(kept_nodes(spark), default=-1)
    assert simhash.links(near).count() == 3
    assert any("RoundRobinPartitioning(3)" in text for nodes in kept_nodes(spark, before).values() for text in nodes)
