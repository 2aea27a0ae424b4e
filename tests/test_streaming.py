from pyspark.sql import functions as F

from loomgraph.functions.normalize import SoftQuantile
from loomgraph.streaming.features import degree_windows, normalize_stream, read_folder


def drained(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def test_normalizers_run_on_a_stream(spark, tmp_path):
    d = spark.range(10).select("id", F.col("id").cast("double").alias("x"))
    d.write.parquet(str(tmp_path / "in"))
    plan = {"x": [SoftQuantile([0.0, 9.0])]}
    out = drained(normalize_stream(read_folder(spark, str(tmp_path / "in"), d), plan, ["id"]), "t_norm")
    want = normalize_stream(d, plan, ["id"])
    assert sorted(out.collect()) == sorted(want.collect())


def test_windows_count_events(spark, tmp_path):
    d = spark.range(6).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 1200).alias("t"))
    d.write.parquet(str(tmp_path / "in"))
    out = drained(degree_windows(read_folder(spark, str(tmp_path / "in"), d), "k", "t"), "t_win", "complete")
    assert sorted((r["k"], r["n"]) for r in out.collect()) == [(0, 1), (0, 2), (1, 1), (1, 2)]
