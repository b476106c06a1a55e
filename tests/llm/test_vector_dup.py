"""Operator 11 against brute force: vectors of near copies, exact copies, odd rows, and long runs of one key."""

import math

import numpy as np
import pytest

from pagemill.llm import vector_dup

SCHEMA = "vec_id long, embedding array<double>, label int, n_links string"


def plain(rows, cosine=0.98):
    """n_links and the least reachable vec_id of each row, by comparing all of a label."""
    usable = [bool(v) and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label, *_ in rows]
    near = [[] for _ in rows]
    for i, (_, v, label, *_) in enumerate(rows):
        for j, (_, w, other, *_) in enumerate(rows):
            if i != j and usable[i] and usable[j] and label == other and len(v) == len(w):
                v1, w1 = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
                if v1 @ w1 / math.sqrt((v1 @ v1) * (w1 @ w1)) >= cosine:
                    near[i].append(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            more = set(near[todo.pop()]) - seen
            seen |= more
            todo += more
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(names, default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] is not None and rows[i][0] == least))
    return sorted(out, key=str)


def fixture():
    r = np.random.default_rng(3)
    rows = []
    for k in range(12):
        base = r.standard_normal(16)
        for _ in range(int(r.integers(1, 30))):  # cosines on both sides of the limit
            rows.append((len(rows), (base + r.standard_normal(16) * 0.14).tolist(), int(k % 3), "clash"))
    rows += [(len(rows) + i, r.standard_normal(16).tolist(), int(i % 3), "clash") for i in range(150)]
    copy = rows[5][1]
    rows += [(1000 + i, copy, rows[5][2], "clash") for i in range(40)]
    rows += [(1100, copy, 99, "c"), (1101, (np.array(copy) * 7).tolist(), rows[5][2], "c"), (1102, copy, None, "c"), (1103, None, 0, "c"), (1104, [], 0, "c"), (1105, [0.0] * 16, 0, "c")]
    rows += [(1106, [None] + [1.0] * 15, 0, "c"), (1107, [float("nan")] * 16, 0, "c"), (1108, [float("inf")] * 16, 0, "c"), (1109, [1e200] * 16, 0, "c"), (1110, [1e-200] * 16, 0, "c"), (1111, [1.0] * 4, 0, "c")]
    return [*rows, (None, copy, rows[5][2], "c"), (1112, copy, rows[5][2], "c"), (1112, copy, rows[5][2], "c"), (None, [-1.0] * 16, 7, "c")]


@pytest.mark.parametrize("window", [1024, 24, 4])
def test_links_match_brute_force(spark, window):
    rows = fixture()
    got = vector_dup.links(spark.createDataFrame(rows, SCHEMA).repartition(5), window=window)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain(rows)


def test_one_key_for_all(spark):
    """A single run of near copies: more than a window holds, in parts that all meet."""
    r = np.random.default_rng(4)
    base = r.standard_normal(8)
    rows = [(i, (base + r.standard_normal(8) * 1e-3).tolist(), 1, "c") for i in range(90)]
    got = vector_dup.links(spark.createDataFrame(rows, SCHEMA), window=4).collect()
    assert {(x.n_links, x.component_id) for x in got} == {(89, 0)}


def test_empty(spark):
    assert vector_dup.links(spark.createDataFrame([], SCHEMA)).collect() == []


def test_passes_keep_the_chance_to_miss():
    for b in (0, 1, 5, 20, 40):
        t = vector_dup.passes(b, 0.98)
        assert (1 - (1 - math.acos(0.98) / math.pi) ** b) ** t <= 1e-6
