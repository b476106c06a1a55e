"""Operator 12 against a plain tree, with odd rows and blocks of several sizes."""

import random
import zlib
from hashlib import sha256
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from pagemill.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def plain_tree(nodes):
    """The root, and of each node the runs on its way up with its place in each."""
    ways = [[] for _ in nodes]
    own = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, belongs = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k in range(len(run)):
                for i in own[at + k]:
                    ways[i].append((run, k))
            above.append(digest(*run))
            belongs.append([i for k in range(len(run)) for i in own[at + k]])
        nodes, own = above, belongs
    return nodes[0], ways


def plain(rows):
    key = lambda r: (r[1] is not None, (r[1] or "").encode())
    order = sorted(rows, key=lambda r: (*key(r), r[0] is not None, r[0] or 0, plain_leaf(r)))
    trees = [(list(own), plain_tree([plain_leaf(r) for r in own])) for own in (list(g) for _, g in groupby(order, key=key))]
    root, tops = plain_tree([t[0] for _, t in trees]) if trees else (None, [])
    out = []
    for (own, (subroot, ways)), top in zip(trees, tops):
        for r, way in zip(own, ways):
            way = way + top
            node = plain_leaf(r)
            proof = digest(*(h for run, k in way for i, h in enumerate(run) if i != k))
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            folded = plain_leaf((*r[:4], "".join(c.lower() if c.isascii() else c for c in r[4]))) if tampered else node
            for run, k in way:
                folded = digest(*run[:k], folded, *run[k + 1 :])
            out.append((r[0], node, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


def fixture():
    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "a", "b", "É", "z", None, ""]), r.choice(["en", None]), r.choice([1, None]), r.choice(["Some Text", "none", "", None, "É ß X"]), "clash") for i in range(700)]
    rows += [(1000 + i, f"own{i}", "en", 3, "Alone", "c") for i in range(300)]  # more sources than a run of runs
    rows += [(None, "a", None, None, None, "c")] * 3 + [(5000, "b", "en", 1, "Twice", "c")] * 20 + [(5000, "b", "en", 2, "other", "c")]
    return rows + [(6000, "long", "en", 1, "Word " * 50_000, "c"), (-5, "a", "x", -7, "Minus", "c")]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest(spark, levels, monkeypatch):
    monkeypatch.setattr(merkle, "SORTED_ROWS", 90)  # sources begin and end within and across partitions
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = merkle.manifest(docs, levels, **queries.tampered())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain(rows)


def test_one_row_and_none(spark):
    got = merkle.manifest(spark.createDataFrame([(1, None, None, None, None, "c")], SCHEMA)).collect()
    leaf = digest("1:1", "-", "-", "-", "-")
    assert [tuple(x) for x in got] == [(1, leaf, leaf, leaf, digest(), leaf, True)]
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_places_are_those_of_the_order(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SORTED_ROWS", 50)
    rows = spark.range(1000).select(F.when(F.col("id") < 700, "a").when(F.col("id") < 701, "b").otherwise("c").alias("g"), F.col("id").alias("v"))
    got = merkle.indexed(rows, "g", ["v"], 1000).collect()
    assert sorted((x.g, x.v, x.i) for x in got) == [("a", v, v) for v in range(700)] + [("b", 700, 0)] + [("c", v, v - 701) for v in range(701, 1000)]
