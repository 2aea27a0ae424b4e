"""Feature engineering queries: normalizers, time series, vectors, sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import normalize as nz
from loomgraph.functions import timeseries as ts
from loomgraph.functions import vectors as vec
from loomgraph.operators import statistics as st
from loomgraph.sources.tables import rows_from_json, trade_graph


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "user_id", "event_type", "value", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "props")


def _series(spark, sf_dir):
    return ts.series(_events(spark, sf_dir), "user_id", "t", ["value", "event_id"])


def dictionary_index(spark, sf_dir):
    part = trade_graph(spark, sf_dir).nodes["part"]
    words = [r["value"] for r in st.dictionary(part, "brand", max_items=20).orderBy("idx").collect()]
    out = nz.normalized(part, {"brand": [nz.DictionaryIndex(words)]}, ["id"])
    return out.select("id", F.col("brand_INDEX").cast("long").alias("brand_INDEX"))


def soft_quantile(spark, sf_dir):
    orders = trade_graph(spark, sf_dir).nodes["orders"]
    q = [r["q"] for r in st.quantiles(orders, "totalprice", 9, exact=True).orderBy("k").collect()]
    out = nz.normalized(orders, {"totalprice": [nz.SoftQuantile(q)]}, ["id"])
    return out.select("id", F.round("totalprice_SOFT_QUANTILE", 9).alias("totalprice_SOFT_QUANTILE"))


def hash_bucket(spark, sf_dir):
    return nz.normalized(trade_graph(spark, sf_dir).nodes["part"], {"type": [nz.HashBucket(97)]}, ["id"])


def sinusoid(spark, sf_dir):
    out = nz.normalized(_events(spark, sf_dir), {"value": [nz.Sinusoid(4, 1.0, 100.0)]}, ["event_id"])
    return out.select("event_id", *[(F.round(F.col("value_SINUSOID")[i], 6) + 0.0).alias(f"w{i}") for i in range(4)])


def auto_normalize(spark, sf_dir):
    g = trade_graph(spark, sf_dir)
    plan = nz.auto(g.nodes["customer"], g.schema.node_sets["customer"], 5, exact=True)
    out = nz.normalized(g.nodes["customer"], plan, ["id"])
    return out.select("id", F.round("acctbal_SOFT_QUANTILE", 9).alias("acctbal"), F.col("segment_INDEX").cast("long").alias("segment"))


def calendar(spark, sf_dir):
    out = ts.calendar_columns(_events(spark, sf_dir).select("event_id", "t"), "t")
    return out.select("event_id", *[F.col(f"t_{p}").cast("long").alias(p) for p in ts.PARTS])


def seed_delta(spark, sf_dir):
    s = _series(spark, sf_dir).select("user_id", ts.seed_delta(F.col("t"), F.array_max("t")).alias("d"))
    return s.select("user_id", F.posexplode("d").alias("step", "delta")).select("user_id", F.col("step").cast("long").alias("step"), "delta")


def pad_and_cap(spark, sf_dir):
    last = ts.series(_events(spark, sf_dir), "user_id", "t", ["value", "event_id"], most=8)
    s = last.select("user_id", ts.pad_and_cap(F.col("event_id"), 8, F.lit(0).cast("long")).alias("v"), ts.step_mask(F.col("event_id"), 8).alias("m"))
    rows = s.select("user_id", F.posexplode(F.arrays_zip("v", "m")).alias("step", "x"))
    return rows.select("user_id", F.col("step").cast("long").alias("step"), F.col("x.v").alias("event_id"), F.col("x.m").alias("observed"))


def causal_slice(spark, sf_dir):
    """Each user's last five events up to the middle of their history."""
    e = _events(spark, sf_dir)
    middle = e.groupBy("user_id").agg(((F.min("t") + F.max("t")) / 2).cast("long").alias("mid"))
    seen = e.join(middle, "user_id").where("t <= mid")
    return ts.series(seen, "user_id", "t", ["value", "event_id"], most=5).select("user_id", F.explode("event_id").alias("event_id"))


def masked_mean(spark, sf_dir):
    s = _series(spark, sf_dir)
    return s.select("user_id", F.round(ts.masked_mean(F.col("value"), F.transform("value", lambda x: x > 50)), 6).alias("mean_large"))


def json_features(spark, sf_dir):
    return rows_from_json(_events(spark, sf_dir).select("event_id", "props"), "props", "k BIGINT, absent STRING")


def embedding_scores(spark, sf_dir):
    """Each vector against the one with the smallest id, after scaling to length one."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", vec.unit(F.col("embedding")).alias("u"))
    first = v.agg(F.min_by("u", "vec_id").alias("w"))
    s = v.crossJoin(F.broadcast(first)).select("vec_id", vec.dot(F.col("u"), F.col("w")).alias("s"))
    return s.select("vec_id", F.round("s", 5).alias("score"), F.round(vec.sigmoid(F.col("s")), 5).alias("p"))


def minhash(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", F.concat_ws(":", "event_type", F.floor("value").cast("string")).alias("item"))
    s = vec.minhash(e, "user_id", "item", 8)
    return s.select("user_id", F.posexplode("sketch").alias("k", "m")).select("user_id", F.col("k").cast("long").alias("k"), "m")


QUERIES = {
    f.__name__: f
    for f in (
        dictionary_index, soft_quantile, hash_bucket, sinusoid, auto_normalize, calendar, seed_delta, pad_and_cap, causal_slice,
        masked_mean, json_features, embedding_scores, minhash,
    )
}

_SOFT = """q AS (SELECT DISTINCT unnest(quantile_cont({c}, [i / {k}.0 for i in range(0, {k} + 1)])) AS p FROM {t}),
b AS (SELECT row_number() OVER (ORDER BY p) - 1 AS k, p AS lo, lead(p) OVER (ORDER BY p) AS hi, count(*) OVER () AS n FROM q),
f AS (SELECT {i} AS id, {c} AS x, greatest(0, (SELECT max(k) FROM b WHERE lo <= {c} AND hi IS NOT NULL)) AS k FROM {t})"""
_PERM = ", ".join(f"({i}, {a}::BIGINT, {b}::BIGINT)" for i, (a, b) in enumerate(vec.permutations(8)))
_S = "WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) // 1000000 AS t FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, value, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)"

ORACLE = {
    "dictionary_index": """WITH c AS (SELECT p_brand AS v, row_number() OVER (ORDER BY count(*) DESC, p_brand) - 1 AS i FROM part GROUP BY 1), d AS (SELECT * FROM c WHERE i < 20)
SELECT p_partkey AS id, coalesce(i, (SELECT count(*) FROM d)) AS "brand_INDEX" FROM part LEFT JOIN d ON v = p_brand""",
    "soft_quantile": f"""WITH {_SOFT.format(c="o_totalprice", k=8, t="orders", i="o_orderkey")}
SELECT id, round((f.k + (x - lo) / (hi - lo)) / (n - 1) - 0.5, 9) AS "totalprice_SOFT_QUANTILE" FROM f JOIN b ON b.k = f.k""",
    "hash_bucket": "SELECT p_partkey AS id, ('0x' || substr(md5(p_type), 1, 8))::BIGINT % 97 AS \"type_HASH\" FROM part",
    "sinusoid": "SELECT event_id, round(sin(value * 2 * pi()), 6) + 0.0::DOUBLE AS w0, round(sin(value * 2 * pi() / 100), 6) + 0.0::DOUBLE AS w1, round(cos(value * 2 * pi()), 6) + 0.0::DOUBLE AS w2, round(cos(value * 2 * pi() / 100), 6) + 0.0::DOUBLE AS w3 FROM events",
    "auto_normalize": f"""WITH {_SOFT.format(c="c_acctbal", k=4, t="customer", i="c_custkey")},
d AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i FROM customer GROUP BY 1)
SELECT id, round((f.k + (x - lo) / (hi - lo)) / (n - 1) - 0.5, 9) AS acctbal, d.i AS segment FROM f JOIN b ON b.k = f.k JOIN customer ON c_custkey = id JOIN d ON d.v = c_mktsegment""",
    "calendar": "SELECT event_id, CAST(second(ts) AS BIGINT) AS second, CAST(minute(ts) AS BIGINT) AS minute, CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, CAST(month(ts) AS BIGINT) AS month, CAST(year(ts) AS BIGINT) AS year FROM events",
    "seed_delta": _S + " SELECT user_id, i - 1 AS step, max(t) OVER (PARTITION BY user_id) - t AS delta FROM s",
    "pad_and_cap": _S + """, u AS (SELECT DISTINCT user_id, n FROM s) SELECT u.user_id, k AS step, coalesce(event_id, 0) AS event_id, event_id IS NOT NULL AS observed
FROM u CROSS JOIN range(0, 8) r(k) LEFT JOIN s ON s.user_id = u.user_id AND s.i = u.n - 8 + k + 1""",
    "causal_slice": _S + """, m AS (SELECT *, (min(t) OVER (PARTITION BY user_id) + max(t) OVER (PARTITION BY user_id)) // 2 AS mid FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS r FROM m WHERE t <= mid) SELECT user_id, event_id FROM k WHERE r <= 5""",
    "masked_mean": "SELECT user_id, round(coalesce(avg(value) FILTER (WHERE value > 50), 0), 6) AS mean_large FROM events GROUP BY 1",
    "json_features": "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k, '' AS absent FROM events",
    "embedding_scores": """WITH w AS (SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS w FROM embeddings), s AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), w) AS s FROM embeddings, w)
SELECT vec_id, round(s, 5) AS score, round(1 / (1 + exp(-s)), 5) AS p FROM s""",
    "minhash": f"""WITH h AS (SELECT user_id, ('0x' || substr(md5(event_type || ':' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)), 1, 7))::BIGINT AS h FROM events), p(k, a, b) AS (VALUES {_PERM})
SELECT user_id, CAST(k AS BIGINT) AS k, min((a * h + b) % 2147483647) AS m FROM h, p GROUP BY ALL""",
}
