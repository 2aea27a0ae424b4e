"""Stored key filters and relational reads."""

import uuid

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import membership as M
from loomgraph.sources import external


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(20_000).select((F.col("id") * 7).alias("a"), F.concat(F.lit("k"), F.col("id") % 50).alias("b"))


def test_no_key_is_refused_and_few_others_pass(spark, keys, tmp_path):
    M.store(M.key_filter(keys, ["a", "b"]), str(tmp_path / "f"))
    found = M.stored(spark, str(tmp_path / "f"))
    assert found.size == -(-20_000 * 16 // M.BLOCK_BITS) and found.hashes == 5
    assert M.tested(keys, ["a", "b"], found).where("NOT may").count() == 0
    others = keys.select("a", F.concat("b", F.lit("!")).alias("b"))
    assert M.tested(others, ["a", "b"], found).where("may").count() < 20_000 / 200
    crowded = M.key_filter(keys, ["a", "b"], most=2)
    assert crowded.size == 2 and M.tested(keys, ["a", "b"], crowded).where("NOT may").count() == 0


def test_exact_rows_whatever_the_filter_lets_through(spark, keys):
    rows = spark.range(3000).select((F.col("id") * 3).alias("a"), F.concat(F.lit("k"), F.floor(F.col("id") * 3 / 7) % 50).alias("b"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, "k0", 9000), (0, None, 9001), (0, "k0", 9002), (0, "k0", 9002)], "a long, b string, id long"))
    key = keys.unionByName(spark.createDataFrame([(None, "k0")], "a long, b string"))
    want = rows.join(key, ["a", "b"], "left_semi").count() + 1
    for found in (M.key_filter(key, ["a", "b"]), M.key_filter(key, ["a", "b"], bits=1, hashes=1, most=1)):
        inside, outside = M.within(rows, key, ["a", "b"], found), M.without(rows, key, ["a", "b"], found)
        assert inside.count() == want and outside.count() == 3004 - want
        assert inside.where("a IS NULL").count() == 1 and outside.where("a = 0 AND b IS NULL").count() == 1
    none = M.key_filter(key.limit(0), ["a", "b"])
    assert M.within(rows, key.limit(0), ["a", "b"], none).count() == 0 and M.without(rows, key.limit(0), ["a", "b"], none).count() == 3004


def test_refused_rows_are_not_shuffled(spark, keys):
    """Only what the filter lets through meets the exact join."""
    found = M.key_filter(keys, ["a", "b"])
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.range(50_000).select((F.col("id") * 7 + 1).alias("a"), F.lit("k1").alias("b"))
        df = M.within(rows, keys, ["a", "b"], found)
        assert df.count() == 0
        plan = df._jdf.queryExecution().executedPlan().toString()
        exchange = plan.index("Exchange hashpartitioning")
        assert "__bits" in plan[exchange:] and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("derby") / "log"))
    return f"jdbc:derby:memory:loom{uuid.uuid4().hex};create=true"


def test_crowded_keys_are_read_in_even_parts(spark, url):
    crowded = spark.range(4000).select(F.when(F.col("id") < 3900, F.col("id")).otherwise(F.col("id") * 1_000_000).alias("id"), (F.col("id") % 9).alias("x"))
    crowded = crowded.unionByName(spark.createDataFrame([(None, 1)], "id long, x long"))
    crowded.write.format("jdbc").option("url", url).option("dbtable", "crowded").save()
    plain = external.jdbc_table(spark, url, "crowded", "id", (0, 4_000_000_000), 8)
    even = external.jdbc_table(spark, url, "crowded", "id", parts=8)
    sizes = lambda d: sorted(r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect())
    assert max(sizes(plain)) >= 3900 and len(sizes(even)) == 8 and max(sizes(even)) < 700
    assert even.count() == 4001 and even.agg(F.sum("x")).first()[0] == crowded.agg(F.sum("x")).first()[0]
    assert even.select("id").distinct().count() == 4001


def test_empty_and_text_keyed_tables(spark, url):
    spark.createDataFrame([], "id long").write.format("jdbc").option("url", url).option("dbtable", "nothing").save()
    assert external.key_predicates(spark, url, "nothing", "id") == [] and external.jdbc_table(spark, url, "nothing", "id").count() == 0
    words = spark.range(300).select(F.concat(F.lit("it's "), F.lpad(F.col("id").cast("string"), 3, "0")).alias("word"))
    words.write.format("jdbc").option("url", url).option("dbtable", "words").option("createTableColumnTypes", "word VARCHAR(20)").save()
    read = external.jdbc_table(spark, url, "words", "word", parts=4)
    assert read.count() == 300 == read.distinct().count() and len(external.key_predicates(spark, url, "words", "word", 4)) == 4
