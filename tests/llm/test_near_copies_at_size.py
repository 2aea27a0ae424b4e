"""Near copies of more text than their table of repeated shingles is made for, and what their steps leave on disk."""

import subprocess
import sys
from pathlib import Path

import numpy as np

from loomgraph.llm import simhash


def test_near_copies_of_more_text_than_the_table_is_made_for(spark, monkeypatch):
    """Beyond that no table is made; the classes that meet are found by their shingles, and the rows that stay are those of brute force."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 60 if n < 60 else 3000, rng.integers(1, 120))) for n in range(160)]
    for t in texts[:120]:
        w = t.split()
        w[rng.integers(len(w))] = "z"
        texts.append(" ".join(w))
    texts += [texts[3].upper(), "", None, " "]
    sets = [simhash.shingles(t) for t in texts]
    similar = [[j for j, b in enumerate(sets) if a.tobytes() == b.tobytes() or simhash.similarity(a, b) >= 0.8] for a in sets]
    group = list(range(len(sets)))
    while (new := [min(group[j] for j in [i, *similar[i]]) for i in range(len(sets))]) != group:
        group = new
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(simhash, "MOST_BITS", 0)
    monkeypatch.setattr(simhash, "repeated_shingles", None)
    met, links = [], simhash.missing_links
    monkeypatch.setattr(simhash, "missing_links", lambda sets, *a: met.extend(r["fp"] for r in sets.select("fp").collect()) or links(sets, *a))
    assert sorted(r["doc_id"] for r in simhash.drop_near_copies(docs).collect()) == [i for i, g in enumerate(group) if i == g]
    marks = [simhash._set_mark(s) for s in sets]
    assert {marks[i] for i, s in enumerate(similar) if {marks[j] for j in s} != {marks[i]}} <= set(met)
    assert len(set(met)) < len(set(marks)) - 20  # most others stay out
    assert simhash.drop_near_copies(docs.limit(0)).count() == 0


def test_near_copies_leave_no_shuffle_files(spark, tmp_path):
    """The steps' shuffle files go with each step; before, they stayed until the driver's garbage was collected."""
    code = f"""
import os, random
from pyspark.sql import SparkSession
from loomgraph.llm import simhash
spark = SparkSession.builder.master("local[2]").config("spark.local.dir", {str(tmp_path)!r}).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
rnd = random.Random(2)
texts = [" ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, 5) for _ in range(60)) for _ in range(400)]
texts += [t + " x" for t in texts[:200]]
out = simhash.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
left = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk({str(tmp_path)!r}) for f in names if f.startswith("shuffle_"))
assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
print("LEFT", left, out.count())
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(simhash.__file__).parents[2], timeout=600)
    left, kept = said.stdout.split("LEFT")[-1].split()
    assert (int(left), int(kept)) == (0, 400)
