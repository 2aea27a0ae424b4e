"""The graph directory: sidecars, one Parquet dataset per node set and edge set.

``metadata.json`` (version, optional timestamp), ``schema.json``,
``nodesets/<name>-00000-of-00001.parquet`` with the primary key, ``edgesets/<name>-…`` with
``#source`` and ``#target``.  Datasets are read with the declared schema, so files never drive inference.
"""

from __future__ import annotations

import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.graph import SOURCE, TARGET, Graph
from loomgraph.operators.structure import dangling, without_dangling
from loomgraph.schema import EdgeSet, Feature, GraphSchema, NodeSet, repaired

#: Layout names (fixed values).
FILE_SOURCE, FILE_TARGET = "#source", "#target"
NODE_DIR, EDGE_DIR = "nodesets", "edgesets"
VERSION = 0
#: Rows for a shard, and most shards of a set.
SHARD_ROWS, MAX_SHARDS = 1_000_000, 10_000


class Store:
    """Small text files and listings through Hadoop's file systems, so any path Spark reads works."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        p = self._path(name)
        return p.getFileSystem(self.conf).exists(p)

    def text(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect())

    def write(self, name: str, text: str) -> None:
        p = self._path(name)
        out = p.getFileSystem(self.conf).create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def rename(self, old: str, new: str) -> None:
        a, b = self._path(old), self._path(new)
        if not a.getFileSystem(self.conf).rename(a, b):
            raise OSError(f"{a} could not be renamed {b}")

    def delete(self, name: str) -> None:
        p = self._path(name)
        p.getFileSystem(self.conf).delete(p, True)

    def names(self, name: str = "") -> list[str]:
        p = self._path(name)
        return sorted(s.getPath().getName() for s in p.getFileSystem(self.conf).listStatus(p))


def shard_name(name: str, shard: int, shards: int, extension: str = "") -> str:
    return f"{name}-{shard:05d}-of-{shards:05d}{extension}"


def sharded(path: str) -> list[str]:
    """``name@3.ext`` as its three shard names, ``name@*.ext`` as a glob, anything else as it is."""
    m = re.fullmatch(r"(.*)@(\d+|\*)(\..*)?", path)
    if not m:
        return [path]
    if m[2] == "*":
        return [f"{m[1]}-?????-of-?????{m[3] or ''}"]
    n = int(m[2])
    return [shard_name(m[1], i, n, m[3] or "") for i in range(n)]


def struct_type(features: dict[str, Feature]) -> T.StructType:
    return T.StructType([T.StructField(n, f.spark_type(), True, {"semantic": f.semantic, "shape": json.dumps(f.shape)}) for n, f in features.items()])


def shard_count(rows: int, shard_rows: int = SHARD_ROWS, most: int = MAX_SHARDS) -> int:
    """How many files so many rows fill, at least one and at most ``most``."""
    return max(1, min(most, -(-rows // shard_rows)))


def write_graph(g: Graph, path: str, shard_rows: int = SHARD_ROWS, compression: str = "snappy", max_shards: int | None = None, count: bool = False) -> None:
    """Write the graph; large sets are cut into files by rows, not gathered.

    The whole directory is made beside its place, under a hidden name of this attempt: the tasks
    write each set, all sets at the same time, and their files are named as shards,
    ``<set>-00000-of-00003.parquet``.  Only then it is put in its place by one rename, after one that
    puts a graph that is there aside.  A write that fails or is killed leaves that graph
    readable; other files of its directory stay.  ``max_shards`` bounds the files of a set; with
    ``count`` rows are counted first, and small sets that lie in many partitions get as
    few files as their rows need.  Node sets need a primary id.
    """
    for s in g.schema.node_sets.values():
        s.key()
    spark = next(iter(g.nodes.values())).sparkSession
    root, base = path.rstrip("/").rsplit("/", 1)
    home, token = Store(spark, root), uuid.uuid4().hex
    attempt = f".{base}.attempt-{token}"
    store = Store(spark, f"{root}/{attempt}")
    meta = {"version": VERSION} | ({"timestamp": g.timestamp} if g.timestamp is not None else {})
    sets = [(NODE_DIR, n, d) for n, d in g.nodes.items()]
    sets += [(EDGE_DIR, n, d.withColumnsRenamed({SOURCE: FILE_SOURCE, TARGET: FILE_TARGET})) for n, d in g.edges.items()]

    def write(kind: str, name: str, d: DataFrame) -> list[tuple[str, str]]:
        most = max_shards or (shard_count(d.count(), shard_rows) if count else None)
        d = d.coalesce(most) if most else d
        spare = f"{kind}/_{name}"
        d.write.option("compression", compression).option("maxRecordsPerFile", 0 if max_shards else shard_rows).parquet(f"{store.root}/{spare}")
        files = [f for f in store.names(spare) if f.endswith(".parquet")]
        return [(f"{spare}/{f}", f"{kind}/{shard_name(name, i, len(files), '.parquet')}") for i, f in enumerate(files)]

    try:
        with ThreadPoolExecutor(8) as pool:
            moves = [m for found in pool.map(lambda s: write(*s), sets) for m in found]
            list(pool.map(lambda m: store.rename(*m), moves))
            list(pool.map(lambda s: store.delete(f"{s[0]}/_{s[1]}"), sets))
        store.write("schema.json", g.schema.to_json())
        store.write("metadata.json", json.dumps(meta))
    except BaseException:
        store.delete("")
        raise
    aside = f".{base}.aside-{token}"
    if home.exists(base):
        home.rename(base, aside)
    home.rename(attempt, base)
    for old in [n for n in home.names() if n.startswith(f".{base}.aside-")]:
        for name in set(home.names(old)) - {NODE_DIR, EDGE_DIR, "schema.json", "metadata.json"}:
            if not home.exists(f"{base}/{name}"):
                home.rename(f"{old}/{name}", f"{base}/{name}")
        home.delete(old)


def readable_place(spark: SparkSession, path: str) -> str:
    """``path``, or the graph put aside by a write that was killed between its two renames."""
    root, base = path.rstrip("/").rsplit("/", 1)
    home = Store(spark, root)
    if not home.exists(f"{base}/metadata.json") and home.exists(""):
        for old in [n for n in home.names() if n.startswith(f".{base}.aside-")]:
            if home.exists(f"{old}/metadata.json"):
                return f"{root}/{old}"
    return path


def read_schema(spark: SparkSession, path: str) -> GraphSchema:
    return GraphSchema.from_json(Store(spark, readable_place(spark, path)).text("schema.json"))


def read_graph(spark: SparkSession, path: str, schema: GraphSchema | None = None, drop_dangling: bool = False, strict: bool = False) -> Graph:
    """Read a graph directory, lazily and with column pruning by ``schema``.

    ``drop_dangling`` keeps only edges whose ends exist; ``strict`` raises ValueError
    for the first that doesn't.  A newer version than this one raises ValueError.
    """
    path = readable_place(spark, path)
    store = Store(spark, path)
    meta = json.loads(store.text("metadata.json"))
    if meta.get("version", 0) > VERSION:
        raise ValueError(f"graph version {meta['version']} is newer than {VERSION}")
    schema = repaired(schema or read_schema(spark, path), semantics=False)

    def load(kind: str, name: str, fields: T.StructType) -> DataFrame:
        # shards, or the files of a warehouse's export, which are not numbered so
        shards = [f for f in store.names(kind) if re.fullmatch(re.escape(name) + r"-\d{5}-of-\d{5}\.parquet", f)]
        digits = "[0-9]" * 5  # no other set whose name goes on with a hyphen
        return spark.read.schema(fields).parquet(f"{path}/{kind}/{name}-{digits}-of-{digits}.parquet" if shards else f"{path}/{kind}/{name}-*.parquet")

    nodes = {n: load(NODE_DIR, n, struct_type(s.features)) for n, s in schema.node_sets.items()}
    edges = {}
    for n, s in schema.edge_sets.items():
        ends = [T.StructField(c, schema.node_sets[o].features[schema.node_sets[o].key()].spark_type()) for c, o in ((FILE_SOURCE, s.source), (FILE_TARGET, s.target))]
        d = load(EDGE_DIR, n, T.StructType([*ends, *struct_type(s.features).fields]))
        edges[n] = d.withColumnsRenamed({FILE_SOURCE: SOURCE, FILE_TARGET: TARGET})
    g = Graph(schema, nodes, edges, meta.get("timestamp"))
    for n, s in schema.edge_sets.items():
        if strict:
            bad = dangling(edges[n], g.ids(s.source), g.ids(s.target)).limit(1).collect()
            if bad:
                raise ValueError(f"edge set {n}: no {bad[0]['side']} node {bad[0]['id']}")
        if drop_dangling:
            edges[n] = without_dangling(edges[n], g.ids(s.source), g.ids(s.target))
    return g


def write_snapshots(graphs: dict[str, Graph], path: str) -> None:
    """A directory of timestamped graphs of one schema."""
    first = next(iter(graphs.values()))
    store = Store(next(iter(first.nodes.values())).sparkSession, path)
    store.write("metadata.json", json.dumps({"version": VERSION, "format": "graph_snapshots"}))
    store.write("schema.json", first.schema.to_json())
    for name, g in graphs.items():
        write_graph(g, f"{path}/snapshots/{name}")


def read_snapshots(spark: SparkSession, path: str) -> dict[str, Graph]:
    return {n: read_graph(spark, f"{path}/snapshots/{n}") for n in Store(spark, path).names("snapshots") if not n.startswith(".")}


def write_sample(sample, path: str) -> None:
    """A sample in long form, its nodes and edges as two datasets."""
    sample.nodes.write.mode("overwrite").parquet(f"{path}/sample_nodes.parquet")
    sample.edges.write.mode("overwrite").parquet(f"{path}/sample_edges.parquet")


def read_sample(spark: SparkSession, path: str):
    from loomgraph.operators.sampling import Sample

    return Sample(spark.read.parquet(f"{path}/sample_nodes.parquet"), spark.read.parquet(f"{path}/sample_edges.parquet"))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The frame kept at ``path``, made and written the first time."""
    if not Store(spark, path).exists("_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_statistics(spark: SparkSession, path: str, values: dict, name: str = "statistics.json") -> None:
    Store(spark, path).write(name, json.dumps(values))


def read_statistics(spark: SparkSession, path: str, name: str = "statistics.json") -> dict:
    return json.loads(Store(spark, path).text(name))


def empty_graph_schema() -> GraphSchema:
    return GraphSchema({"nodes": NodeSet()}, {"edges": EdgeSet("nodes", "nodes")})
