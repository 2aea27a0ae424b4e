"""Feature statistics, degrees, topology, histograms, padding."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import SOURCE, TARGET
from loomgraph.operators.ranges import running_total
from loomgraph.session import cut


def dictionary(df: DataFrame, column: str, max_items: int = 10_000, min_count: int = 1) -> DataFrame:
    """``(value, n, idx)``: values by count descending, then value, ranked from 0.

    The rank is taken over the ``max_items`` largest only, which a top-k keeps bounded.
    """
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    top = n.orderBy(F.desc("n"), "value").limit(max_items)
    return top.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("n"), "value")) - 1)


def quantiles(df: DataFrame, column: str, count: int = 100, exact: bool = True) -> DataFrame:
    """``(k, q)``: ``count`` evenly spaced quantiles; NaN and null are left out.

    Equal values are counted, the counts added up along ranges of values, and the two values at
    each place interpolated, so a value that many rows have is one row.  ``exact=False`` asks a mergeable sketch of bounded size instead, in one pass:
    values of the column that are off by at most 1 / (100 * count) of the rows.
    """
    at = [i / (count - 1) for i in range(count)] if count > 1 else [0.5]
    clean = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(F.col(column).cast("double").alias("x"))
    if not exact:
        return clean.agg(F.percentile_approx("x", at, 100 * count).alias("q")).select(F.posexplode("q").alias("k", "q"))
    n = clean.count()
    spots = [(k, math.floor(a * (n - 1)), a * (n - 1) - math.floor(a * (n - 1))) for k, a in enumerate(at)] if n else []
    rows = [f"named_struct('k', {k}, 'idx', {i + up}L, 'share', {(share if up else 1 - share)!r}D)" for k, i, share in spots for up in (0, 1) if i + up < n]
    asked = F.expr(f"array({', '.join(rows)})") if rows else F.expr("array(named_struct('k', 0, 'idx', -1L, 'share', 0D))")  # two a quantile
    values = running_total(clean.groupBy("x").agg(F.count("*").alias("n")), "x", "n", name="ahead")
    mine = F.filter(asked, lambda s: (s["idx"] >= F.col("ahead")) & (s["idx"] < F.col("ahead") + F.col("n")))
    hits = values.select("x", F.explode(mine).alias("s"))
    return hits.groupBy(F.col("s.k").alias("k")).agg(F.sum(F.col("x") * F.col("s.share")).alias("q"))


def flat_values(df: DataFrame, column: str) -> DataFrame:
    """The numbers of a scalar or nested list feature as rows ``x``."""
    out, kind = df.select(F.col(column).alias("x")), df.schema[column].dataType.simpleString()
    for _ in range(kind.count("array<")):
        out = out.select(F.explode("x").alias("x"))
    return out


def feature_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, n, low, high, missing)``: rows, smallest and largest flattened value.

    All features are aggregated in one pass over the frame.
    """
    aggs: list[Column] = [F.count("*").alias("n")]
    for c in columns:
        depth = df.schema[c].dataType.simpleString().count("array<")
        lo = hi = F.col(c)
        for _ in range(max(0, depth - 1)):
            lo, hi = F.flatten(lo), F.flatten(hi)
        if depth:
            lo, hi = F.array_min(lo), F.array_max(hi)
        aggs += [F.min(lo).cast("double").alias(f"lo_{c}"), F.max(hi).cast("double").alias(f"hi_{c}"), F.count(F.when(F.col(c).isNull(), 1)).alias(f"mi_{c}")]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("n"), F.col(f"lo_{c}").alias("low"), F.col(f"hi_{c}").alias("high"), F.col(f"mi_{c}").alias("missing")) for c in columns])
    return df.agg(*aggs).select(F.inline(rows))


def degrees(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, out_degree, in_degree)`` of every node, zero included.

    Edges are counted per end before they meet the nodes, so hubs are combined
    map-side.
    """
    o = edges.groupBy(F.col(SOURCE).alias("id")).agg(F.count("*").alias("o"))
    i = edges.groupBy(F.col(TARGET).alias("id")).agg(F.count("*").alias("i"))
    joined = ids.join(o, "id", "left").join(i, "id", "left")
    return joined.select("id", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))


def end_degrees(ids: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """``(id, degree)`` for one end of an edge set, zero included."""
    n = edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("d"))
    return ids.join(n, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("degree"))


def bin_edges(low: float, high: float, bins: int = 32, log: bool = False, integer: bool = False, least_positive: float | None = None) -> list[float]:
    """Histogram edges for a range of values; integers get whole edges, rounded half to even."""

    def spaced(a: float, b: float, n: int) -> list[float]:
        return [a + (b - a) * i / n for i in range(n + 1)]

    if low == high:
        return [low, high]
    if integer and high - low < bins:
        return [float(v) for v in range(int(low), int(high) + 2)]
    if log and low == 0:
        start = 0.0 if integer else math.log10(least_positive or high)
        edges = [0.0, *[10**e for e in spaced(start, math.log10(high), bins - 1)]]
    elif log:
        edges = [10**e for e in spaced(math.log10(low), math.log10(high), bins)]
    else:
        edges = spaced(low, high, bins)
    return sorted({float(round(e)) for e in edges}) if integer else edges


def histogram(df: DataFrame, column: str, bins: int = 32, log: bool = False, integer: bool | None = None) -> DataFrame:
    """``(bin, lo, hi, n)``; bins are [lo, hi), the last one [lo, hi]; no values, no bins.

    One aggregate finds the range (three numbers on the driver), one counts.
    """
    x = F.col(column).cast("double")
    integer = dict(df.dtypes)[column] in ("int", "bigint", "smallint", "tinyint") if integer is None else integer
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.min(F.when(x > 0, x)).alias("pos")).first()
    spark = df.sparkSession
    if r["lo"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n bigint")
    edges = bin_edges(r["lo"], r["hi"], bins, log, integer, r["pos"])
    last = len(edges) - 2
    place = F.least(F.lit(last), F.greatest(F.lit(0), F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= x)) - 1))
    counted = df.where(x.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, {edges[i]!r}D, {edges[i + 1]!r}D)" for i in range(last + 1)) + " AS t(bin, lo, hi)")
    return frame.join(counted, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def topology(node_counts: dict[str, DataFrame], edge_counts: dict[str, DataFrame]) -> DataFrame:
    """``(kind, name, n)``: the size of each node set and edge set."""
    out = None
    for kind, sets in (("nodes", node_counts), ("edges", edge_counts)):
        for n, d in sets.items():
            row = d.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(n).alias("name"), "n")
            out = row if out is None else out.unionByName(row)
    return out


def density(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``(nodes, edges, mean_degree, density)`` of a homogeneous graph; density is 2E / (V (V - 1))."""
    v, e = ids.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    both = v.crossJoin(F.broadcast(e))
    pairs = F.col("nodes").cast("double") * (F.col("nodes") - 1)
    return both.select("nodes", "edges", F.try_divide(2.0 * F.col("edges"), F.col("nodes")).alias("mean_degree"), F.try_divide(2.0 * F.col("edges"), pairs).alias("density"))


def isolated(ids: DataFrame, edge_ends: list[tuple[DataFrame, str]]) -> DataFrame:
    """Keys that no given edge end has."""
    out = ids
    for d, end in edge_ends:
        ends = d.select(F.col(end).alias("__e"))
        out = out.join(ends, out["id"] == ends["__e"], "left_anti")
    return out


def homophily(edges: DataFrame, source_labels: DataFrame, target_labels: DataFrame) -> DataFrame:
    """Share of edges whose ends have one label; ``labels(id, label)``."""
    s = source_labels.select(F.col("id").alias("__s"), F.col("label").alias("__ls"))
    t = target_labels.select(F.col("id").alias("__t"), F.col("label").alias("__lt"))
    joined = edges.join(s, edges[SOURCE] == s["__s"]).join(t, edges[TARGET] == t["__t"])
    return joined.agg(F.count("*").alias("edges"), F.avg(F.when(F.col("__ls") == F.col("__lt"), 1.0).otherwise(0.0)).alias("homophily"))


def padding(rows: DataFrame, group: str, name: str, relative: float = 0.1, absolute: int = 1) -> DataFrame:
    """``(name, size)``: room per set that holds the largest sample, with margins."""
    n = rows.groupBy(group, F.col(name).alias("name")).agg(F.count("*").alias("n"))
    size = F.ceil((F.max("n") + absolute) * (1 + relative))
    return n.groupBy("name").agg(size.cast("long").alias("size"))


def components(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: the smallest key reachable over undirected edges between ``ids``.

    Large-star and small-star steps until nothing changes, whatever the diameter; each
    round is cut to the shared checkpoint folder.
    """
    from loomgraph.operators import connected

    known, kind = ids.select("id"), ids.schema["id"].dataType
    ends = edges.select(F.col(SOURCE).cast(kind).alias("u"), F.col(TARGET).cast(kind).alias("v"))
    for end in ("u", "v"):
        ends = ends.join(known.select(F.col("id").alias(end)), end, "left_semi")
    roots = connected.components(ends)
    return known.join(roots, known["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    """``(component, n)`` from ``components(id, component)``."""
    return components.groupBy("component").agg(F.count("*").alias("n"))


def largest_component(components: DataFrame) -> DataFrame:
    """``(component, n, share)`` of the component with most nodes, the smallest key on a tie."""
    sizes = component_sizes(components)
    top = sizes.agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("t"), F.sum("n").alias("all"))
    return top.select((-F.col("t.c")).alias("component"), F.col("t.n").alias("n"), (F.col("t.n") / F.col("all")).alias("share"))


def eccentricities(ids: DataFrame, edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """``(id, distance)``: how far each start's farthest reachable node is over undirected edges.

    Breadth-first, a join a level; the largest distance over all nodes as starts is
    the diameter of their components, over some starts a lower bound.  ``most`` stops after
    so many levels, with the distances reached so far.
    """
    both = edges.select(F.col(SOURCE).alias("a"), F.col(TARGET).alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = cut(starts.select("id", F.col("id").alias("at"), F.lit(0).alias("d")))
    front, level = seen, 0
    while most is None or level < most:
        level += 1
        step = front.join(both, front["at"] == both["a"]).select("id", F.col("b").alias("at")).distinct()
        front = cut(step.join(seen.select("id", "at"), ["id", "at"], "left_anti").withColumn("d", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.join(ids.select("id"), "id", "left_semi").groupBy("id").agg(F.max("d").cast("long").alias("distance"))


def both_ways(edges: DataFrame) -> DataFrame:
    """``(a, b)``: every edge in both directions, once."""
    e = edges.where(F.col(SOURCE) != F.col(TARGET)).select(F.col(SOURCE).alias("a"), F.col(TARGET).alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def reach(ids: DataFrame, edges: DataFrame, lg: int = 10, most: int | None = None) -> DataFrame:
    """``(id, distance, reached)`` of every node over undirected edges, from sketches of 2**lg registers.

    Each node starts with a HyperLogLog sketch of itself; a round unites it with its
    neighbours' sketches, one join and one mergeable aggregate over the edges.  ``distance``
    is the last round that changed a node's sketch, never more than its true eccentricity and equal to
    it as long as the sketches tell every new node apart; ``reached`` estimates
    the nodes that it can reach.  Rounds stop when no sketch changes, or after ``most``.  State is
    one sketch a node, whatever the distances are.
    """
    links = cut(both_ways(edges))
    now = cut(ids.select("id").distinct().groupBy("id").agg(F.hll_sketch_agg(F.xxhash64("id"), F.lit(lg)).alias("held")).select("id", "held", F.lit(0).cast("long").alias("distance")))
    level = 0
    while most is None or level < most:
        level += 1
        told = links.join(now.select(F.col("id").alias("b"), "held"), "b").groupBy(F.col("a").alias("id")).agg(F.hll_union_agg("held").alias("told"))
        grown = now.join(told, "id", "left").withColumn("more", F.coalesce(F.hll_union("held", "told"), F.col("held")))
        changed = F.hll_sketch_estimate("more") > F.hll_sketch_estimate("held")
        after = cut(grown.select("id", F.col("more").alias("held"), F.when(changed, level).otherwise(F.col("distance")).cast("long").alias("distance")))
        if after.where(F.col("distance") == level).isEmpty():
            break
        now = after
    return now.select("id", "distance", F.hll_sketch_estimate("held").alias("reached"))


def _searched(starts: DataFrame, links: DataFrame) -> DataFrame:
    """``(start, at, d)``: distances from ``starts(start, at, d)``, breadth first."""
    seen = front = cut(starts)
    level = 0
    while True:
        level += 1
        step = front.join(links, front["at"] == links["a"]).select("start", F.col("b").alias("at")).distinct()
        front = cut(step.join(seen.select("start", "at"), ["start", "at"], "left_anti").withColumn("d", F.lit(level)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def eccentricity_bounds(ids: DataFrame, edges: DataFrame, rounds: int | None = None, every: bool = True, lg: int = 10) -> DataFrame:
    """``(id, component, lower, upper)``: bounds of every node's distance to the farthest node of its component, undirected.

    Sketches give the first lower bounds (see ``reach``).  Then each round searches from
    two nodes of every component that is open, the one with the largest upper and the one with
    the smallest lower bound, and the distances tighten all others: with d from a start of
    eccentricity e, a node's is between max(d, e - d) and e + d.  No table is larger than two rows
    a node, however many nodes there are to search from.  A component is open while bounds differ, or with
    ``every`` false only until its largest upper bound is reached, which settles its
    diameter; ``rounds`` stops earlier, with the bounds so far.
    """
    links = cut(both_ways(edges.join(ids.select(F.col("id").alias(SOURCE)), SOURCE, "left_semi").join(ids.select(F.col("id").alias(TARGET)), TARGET, "left_semi")))
    sketched = reach(ids, links.select(F.col("a").alias(SOURCE), F.col("b").alias(TARGET)), lg).select("id", F.col("distance").alias("lower"))
    own = components(ids.distinct(), links.select(F.col("a").alias(SOURCE), F.col("b").alias(TARGET)))
    size = own.groupBy("component").agg(F.count("*").alias("n"))
    state = own.join(size, "component").join(sketched, "id")
    state = cut(state.select("id", "component", F.least("lower", F.col("n") - 1).alias("lower"), (F.col("n") - 1).alias("upper")))
    done = 0
    while rounds is None or done < rounds:
        done += 1
        unsettled = F.col("lower") < F.col("upper")
        if not every:  # only nodes that may be farther from another than any is known to be
            state = cut(state.join(state.groupBy("component").agg(F.max("lower").alias("best")), "component"))
            unsettled = unsettled & (F.col("upper") > F.col("best"))
        ends = state.where(unsettled).groupBy("component").agg(F.max_by("id", F.struct("upper", "lower", "id")).alias("far"), F.min_by("id", F.struct("lower", "upper", "id")).alias("near"))
        starts = ends.select(F.explode(F.array_distinct(F.array("far", "near"))).alias("start"))
        starts = cut(starts.select("start", F.col("start").alias("at"), F.lit(0).alias("d")))
        if starts.isEmpty():
            break
        seen = _searched(starts, links)
        far = seen.groupBy("start").agg(F.max("d").alias("e"))
        told = seen.join(far, "start").groupBy(F.col("at").alias("id")).agg(
            F.max(F.greatest(F.col("d"), F.col("e") - F.col("d"))).alias("lo"), F.min(F.when(F.col("d") == 0, F.col("e")).otherwise(F.col("e") + F.col("d"))).alias("hi")
        )
        state = state.join(told, "id", "left")
        state = cut(state.select("id", "component", F.greatest("lower", "lo").alias("lower"), F.least("upper", "hi").alias("upper")))
    return state.select("id", "component", F.col("lower").cast("long").alias("lower"), F.col("upper").cast("long").alias("upper"))


def diameters(ids: DataFrame, edges: DataFrame, lg: int = 10) -> DataFrame:
    """``(component, n, diameter)`` of every connected component, exact."""
    bounds = eccentricity_bounds(ids, edges, every=False, lg=lg)
    return bounds.groupBy("component").agg(F.count("*").alias("n"), F.max("lower").alias("diameter"))


def mean_metrics(steps: DataFrame, metrics: list[str], by: str | None = None) -> DataFrame:
    """``(metric, mean)`` over the steps that have the metric, for each value of ``by`` if given."""
    long = steps.select(*([by] if by else []), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("e"))
    return long.groupBy(*([by] if by else []), F.col("e.metric").alias("metric")).agg(F.avg("e.v").alias("mean"))


def sample_statistics(sample, g, columns: dict[str, list[str]]) -> DataFrame:
    """``(node_set, feature, n, low, high, missing)`` over the nodes that samples hold, each as often as samples hold it."""
    from loomgraph.operators.sampling import with_features

    out = [feature_statistics(with_features(sample, g, n, c), c).select(F.lit(n).alias("node_set"), "*") for n, c in columns.items()]
    return reduce(DataFrame.unionByName, out)


def summary(g, quantile_count: int = 100, max_items: int = 10_000, min_count: int = 1, skip: tuple[str, ...] = ("UNKNOWN", "MASK"), limit: int | None = None, exact: bool = True) -> dict:
    """Statistics of every node feature, as plain values for a JSON sidecar.

    Counts for all; extremes and quantiles for numbers and times, dictionaries for
    text categories; features whose meaning is in ``skip`` are left out.  Each value is bounded by a parameter.
    ``limit`` looks at that many nodes of a set only, those with the smallest key digests.  With ``exact``
    false a set's extremes and quantiles come from one pass of mergeable sketches (see ``sketches``) instead of a
    distributed sort for each feature; lists are sorted still.
    """
    from loomgraph.operators import sketches

    at = [i / (quantile_count - 1) for i in range(quantile_count)] if quantile_count > 1 else [0.5]
    out: dict = {}
    for n, s in g.schema.node_sets.items():
        d, found = g.nodes[n], {}
        if limit is not None:
            d = d.orderBy(F.md5(F.col(g.key(n)).cast("string")), g.key(n)).limit(limit)
        numbers = [f for f, x in s.features.items() if x.format not in ("BYTES", "BOOL") and x.semantic in ("NUMERICAL", "TIMESTAMP", "TIMEDELTA", "CATEGORICAL")]
        plain = [] if exact else [f for f in numbers if not s.features[f].shape]
        total = sketches.merged(sketches.state(d, plain)) if plain else None
        points: dict = {}
        if total is not None:
            total = cut(total)
            for r in sketches.quantiles(total, at).orderBy("at").collect():
                points.setdefault(r["feature"], []).append(r["q"])
        wide = {r["feature"]: r for r in total.select("feature", "low", "high").collect()} if plain else {}
        others = [f for f in numbers if f not in plain]
        wide |= {r["feature"]: r for r in feature_statistics(d, others).collect()} if others else {}
        rows = d.count()
        for f, x in s.features.items():
            if x.semantic in skip:
                continue
            found[f] = {"count": rows}
            if f in wide:
                found[f] |= {"min": wide[f]["low"], "max": wide[f]["high"]}
                if f in plain:
                    found[f]["quantiles"] = points.get(f, [])
                    continue
                flat = flat_values(d, f)
                found[f]["quantiles"] = [r["q"] for r in quantiles(flat, "x", quantile_count).orderBy("k").collect()]
            elif x.semantic == "CATEGORICAL" and x.format == "BYTES":
                words = dictionary(flat_values(d, f), "x", max_items, min_count).orderBy("idx").collect()
                found[f]["dictionary"] = {r["value"]: [r["idx"], r["n"]] for r in words}
        out[n] = found
    return out
