"""``python -m loomgraph validate|plan|schema PATH ...``: small tools over a graph directory."""

from __future__ import annotations

import argparse
import sys

from loomgraph.operators.sampling import hop_plan
from loomgraph.operators.validation import LEVELS, issues
from loomgraph.session import local_session
from loomgraph.sources.native import read_graph, read_schema


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("tool", choices=["validate", "plan", "schema"])
    p.add_argument("path")
    p.add_argument("--seed-set")
    p.add_argument("--hops", type=int, default=3)
    p.add_argument("--width", type=int, default=5)
    a = p.parse_args(argv)
    spark = local_session()
    if a.tool == "validate":
        found = [tuple(r) for r in issues(read_graph(spark, a.path)).collect()]
        for level, text in found:
            print(f"{level}: {text}")
        return int(any(level == LEVELS[-1] for level, _ in found))
    schema = read_schema(spark, a.path)
    print(schema.described() if a.tool == "schema" else hop_plan(schema, a.seed_set or next(iter(schema.node_sets)), a.hops, a.width).described())
    return 0


if __name__ == "__main__":
    sys.exit(main())
