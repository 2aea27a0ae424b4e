"""One-hop samples around the ends of links: against brute force and a sampler, parallel edges and short lists among them."""

from collections import defaultdict

from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators import datasets, negatives

EDGES = [(s, t) for s in range(12) for t in range(9) if (s * 5 + t * 3) % 4 == 0] + [(20, 3), (20, 3), (20, 3), (21, 30), (1, 1), (1, 1), (5, 30)]


def graph(spark):
    a, b = (spark.createDataFrame([(i,) for i in range(n)], "id long") for n in (22, 31))
    e = spark.createDataFrame(EDGES, "source long, target long").repartition(3)
    return Graph.from_frames({"a": (a, "id"), "b": (b, "id")}, {"e": (e, "a", "b")})


def expected(end, node, pair, width):
    """Nodes of the sample: the start, and the ends of its first edges without those of the pair."""
    mine = sorted((t if end == "sources" else s) for s, t in EDGES if (s if end == "sources" else t) == node and (s, t) != pair)
    return {("a" if end == "sources" else "b", str(node), 0)} | {("b" if end == "sources" else "a", str(x), 1) for x in mine[:width]}


def test_a_link_is_left_out_of_its_own_samples(spark):
    """Followed backward too: there the edge was named target-source, and so never left out."""
    g = graph(spark)
    d = datasets.link_dataset(g, "e", 1, 2, per_edge=2)
    links = {f"{r['source']}|{r['target']}|{r['k']}": r for r in d.links.collect()}
    assert {(r["source"], r["target"]) for r in links.values()} == set(EDGES) and len(links) == 2 * len(set(EDGES))
    for end, sample, column in (("sources", d.sources, "source"), ("targets", d.targets, "target"), ("negatives", d.negatives, "negative")):
        nodes, edges = defaultdict(list), defaultdict(list)
        for r in sample.nodes.collect():
            nodes[r["seed"]].append((r["node_set"], r["node"], r["hop"]))
        for r in sample.edges.collect():
            edges[r["seed"]].append((r["source"], r["target"]))
        assert set(nodes) == set(links)
        for seed, r in links.items():
            want = expected(end, r[column], (r["source"], r["target"]), 2)
            assert sorted(nodes[seed]) == sorted(want)
            other = [n for _, n, hop in want if hop]
            assert sorted(edges[seed]) == sorted((str(r[column]), n) if end == "sources" else (n, str(r[column])) for n in other)


def test_two_hops_leave_the_link_out_of_the_first(spark):
    d = datasets.link_dataset(graph(spark), "e", 2, 50, per_edge=1)
    near = d.targets.nodes.where("hop = 1 AND node_set = 'a'").select("seed", "node")
    assert near.where(F.concat_ws("|", "node", F.substring_index(F.substring_index("seed", "|", 2), "|", -1)) == F.substring_index("seed", "|", 2)).count() == 0


def test_link_batches_carry_the_place(spark):
    d = datasets.link_dataset(graph(spark), "e", 1, 2, per_edge=1, once=False)
    b = datasets.link_batches(d, graph(spark).schema, 4)
    labels = {f"{r['source']}|{r['target']}|{r['k']}": (r["batch"], r["slot"]) for r in b.labels.collect()}
    for stream in (b.sources, b.targets, b.negatives):
        assert {(r["seed"], (r["batch"], r["slot"])) for r in stream.nodes.where("seed IS NOT NULL").collect()} == set(labels.items())
        assert stream.edges.groupBy("batch").count().select("count").distinct().count() == 1


def test_splits_and_batches_are_those_of_ranked_digests(spark):
    for n, share in ((0, 0.5), (1, 0.5), (7, 1.0), (500, 0.13), (500, 0.0)):
        df = spark.range(n).select((F.col("id") % 400).alias("key"))  # some keys repeat
        rows = sorted((r["h"], r["key"]) for r in df.select("key", negatives.hash_int(F.col("key"), salt="split").alias("h")).collect())
        got = negatives.split_random(df, "key", share)
        assert sorted(r["key"] for r in got.where("valid").collect()) == sorted(k for _, k in rows[: int(n * share)]) and got.count() == n
    df = spark.range(130).select(F.col("id").alias("key"))
    rows = sorted((r["h"], r["key"]) for r in df.select("key", negatives.hash_int(F.col("key"), salt="batch").alias("h")).collect())
    for drop in (True, False):
        got = {r["key"]: (r["batch"], r["slot"]) for r in negatives.batches(df, "key", 16, drop).collect()}
        assert got == {k: divmod(i, 16) for i, (_, k) in enumerate(rows) if not drop or i < 128}
