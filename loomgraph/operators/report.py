"""A plain HTML report of a graph: its sets, statistics and degree histograms."""

from __future__ import annotations

from html import escape

from loomgraph.graph import SOURCE, TARGET, Graph
from loomgraph.operators import statistics as st

NUMBERS = ("int", "bigint", "float", "double")


def _table(head: list[str], rows: list[tuple]) -> str:
    cells = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><tr>{''.join(f'<th>{escape(h)}</th>' for h in head)}</tr>{cells}</table>"


def text_histogram(rows: list[tuple], width: int = 40) -> str:
    """Bars of (lo, hi, n) as text."""
    top = max((n for *_, n in rows), default=0) or 1
    return "\n".join(f"[{lo:g}, {hi:g}) {n:>10} {'#' * round(width * n / top)}" for lo, hi, n in rows)


def html_report(g: Graph, bins: int = 16) -> str:
    """Counts, feature statistics and degrees; only aggregates of bounded size are collected."""
    parts = ["<h1>Graph</h1>", f"<pre>{escape(g.schema.described())}</pre>", "<h2>Sizes</h2>"]
    parts.append(_table(["kind", "name", "rows"], [tuple(r) for r in st.topology(g.nodes, g.edges).collect()]))
    for n, d in sorted(g.nodes.items()):
        numbers = [c for c, t in d.dtypes if t in NUMBERS]
        if numbers:
            rows = [tuple(r) for r in st.feature_statistics(d, numbers).collect()]
            parts += [f"<h2>{escape(n)}</h2>", _table(["feature", "rows", "low", "high", "missing"], rows)]
    for n, s in sorted(g.schema.edge_sets.items()):
        for end, of in ((SOURCE, s.source), (TARGET, s.target)):
            h = st.histogram(st.end_degrees(g.ids(of), g.edges[n].select(end), end), "degree", bins).orderBy("bin").collect()
            parts.append(f"<h3>{escape(n)}: {end} degree</h3><pre>{escape(text_histogram([(r['lo'], r['hi'], r['n']) for r in h]))}</pre>")
    return f"<!doctype html><meta charset='utf-8'><title>Graph</title>{''.join(parts)}"
