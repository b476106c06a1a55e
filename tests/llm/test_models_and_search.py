"""Operators 1, 3, 7, 10 and the pipeline against brute force, exact recursions or held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import components, near_dup, quality, queries, rules, topk, toxicity
from pagemill.llm.common import frequent_join, text_arrays
from pagemill.llm.labelled import sample
from tests.compare import connect, differences

DIR = "/root/testdata/sf0.001"


def plain_shingles(t):
    w = (t or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def plain_classes(rows):
    own = {i: plain_shingles(t) for i, t in rows}
    up = {i: i for i in own}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in own if own[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = own[a], own[b]
            both = sum((x & y).values())
            if both / (sum(x.values()) + sum(y.values()) - both) >= 0.8:
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in own}


def test_near_duplicates(spark):
    t = pq.read_table(f"{DIR}/documents.parquet").to_pydict()
    rows = list(zip(t["doc_id"], t["text"]))
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    for k in range(40):
        own = list(base)
        for _ in range(k % 8):
            own[r.randrange(150)] = f"x{k}"
        rows.append((5000 + k, " ".join(own)))
    rows += [(6000, None), (6001, ""), (6002, " \n"), (6003, "a b"), (6004, "a  b"), (6005, "a b c"), (6006, "z " * 4000), (6007, "z " * 4100)]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, class_id string")
    want = plain_classes(rows)
    got = {x.doc_id: x.class_id for x in near_dup.classes(docs).collect()}
    assert got == want
    assert near_dup.classes(docs.limit(0)).count() == 0
    again = near_dup.classes(spark.createDataFrame([(1, "q w e"), (1, "q w e"), (None, "q w e"), (2, "q w e")], "doc_id long, text string")).collect()
    assert sorted((x.doc_id or -1, x.class_id or -1) for x in again) == [(-1, -1), (1, 1), (1, 1), (2, 1)]


@pytest.mark.parametrize("cell", [4, 512])
def test_remaining_pairs_are_verified_in_full(spark, monkeypatch, cell):
    """From single members on, the full step finds the components of brute force, also as a grid."""
    monkeypatch.setattr(near_dup, "CELL", cell)
    rng, texts = np.random.default_rng(3), []
    for family in range(3):
        base = [f"w{x}" for x in rng.integers(0, 500, 200)]
        for _ in range(14):
            own = list(base)
            for k in rng.integers(0, 200, rng.integers(1, 4)):
                own[k] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = near_dup.signed(docs).withColumn("node", F.col("doc_id")).cache()
    members = reps.select(F.lit(0).cast("long").alias("grp"), "node", F.col("node").alias("component"), F.expr("node <> 0").alias("asks"), "words")
    cells = near_dup._dealt(members, len(texts)).join(reps.select("node", "sig"), "node")
    met = cells.groupBy("grp", "part", "team").applyInArrow(near_dup._meet, "grp long, part long, team long, node long, component long, partners array<long>")
    found = near_dup._links(met, reps, docs)
    i, j = np.triu_indices(len(texts), 1)
    fine = near_dup.overlap(pa.array([texts[k] for k in i]), pa.array([texts[k] for k in j])) >= 0.8
    want = set(zip(i[fine].tolist(), j[fine].tolist()))
    got = {(min(x.a, x.b), max(x.a, x.b)) for x in found.collect()}
    assert len(want) > 100 and got == want


def test_ids_on_several_texts(spark):
    """Texts are held apart where they share a doc_id, and no text is lost."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(0, a, 1), (1, a, 2), (1, b, 3), (2, c, 4), (3, b, 5), (3, c, 6), (3, c, 7), (None, a, 8), (None, a, 9), (4, "", 10), (4, None, 11), (4, "", 12), (5, " ", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
    got = sorted((x.doc_id, x.class_id) for x in near_dup.classes(docs).filter("doc_id is not null").collect())
    assert got == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 1), (3, 2), (3, 2), (4, 4), (4, 4), (4, 4), (5, 5)]
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter({(0, a): 1, (1, b): 1, (2, c): 1, (None, a): 2, (4, ""): 1, (4, None): 1, (5, " "): 1})
    assert near_dup.one_of_each(docs.limit(0)).count() == 0


def test_frequent_keys_are_joined_apart(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("k <> 7")
    want = sorted(tuple(r) for r in rows.join(keyed, "k", "left").collect() if r.k != 7)
    for how in ("left", "inner"):
        got = frequent_join(rows, keyed, ["k"], "n", 5000, how).collect()
        assert sorted(tuple(r) for r in got if r.k != 7) == want and len(got) == len(want) + (how == "left")


def test_forest():
    r = np.random.default_rng(5)
    a, b = r.integers(0, 300, 200), r.integers(0, 300, 200)
    up = {int(x): int(x) for x in np.concatenate([a, b])}
    for _ in range(300):
        for x, y in zip(a.tolist(), b.tolist()):
            up[x] = up[y] = min(up[x], up[y])
    node, root = components.forest(a, b)
    assert dict(zip(node.tolist(), root.tolist())) == {k: v for k, v in up.items() if k != v}


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        n = int(r.integers(5, 200))
        a, b = r.integers(0, 6, n), r.integers(0, 6, n)
        b = np.where(r.random(n) < 0.7, a, b)
        if not a.any() or not b.any():
            continue
        of = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        key = np.arange(n, dtype=np.uint64) * np.uint64(7919) + np.uint64(n)
        sig = near_dup.bag_min_hash(of, np.concatenate([key[a > 0], key[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 512)
        errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.1


@pytest.mark.parametrize("block", [4096, 2])
def test_top_k(spark, block):
    r = np.random.default_rng(2)
    x = np.round(r.standard_normal((300, 8)) / 4, 2)
    x[10], x[20] = x[30], x[30]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] + [0.1] * 7), (902, [float("nan")] + [0.1] * 7), (903, [float("inf")] * 8)]
    df = spark.createDataFrame([(*row, 1) for row in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = sorted(tuple(x) for x in topk.top_k(df, F.col("vec_id") % 100 == 0, query_block=block).collect())
    v = np.floor(x * 1024).astype(int)
    want = []
    for q in (0, 100, 200):
        s = v @ v[q]
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:10]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(order)]
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_search_with_large_components(spark):
    r = random.Random(3)
    rows = [(i, [float(r.randint(-9, 9)) for _ in range(6)]) for i in range(60)]
    rows[7], rows[20], rows[33] = (7, [70000.0, 1, 2, 3, 4, 5]), (20, [-(2.0**27), 1, 0, 0, 2, 3]), (33, [5000.0] * 6)
    rows = [(i, [*map(float, v)]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = []
    for i, q in rows[::10]:
        scores = sorted((-sum(int(a * 1024) * int(b * 1024) for a, b in zip(q, v)), j) for j, v in rows if j != i)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5, scale=1024).collect()
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == want


def test_attention_gradient():
    r = np.random.default_rng(0)
    m = quality.GatedAttention(3)
    bags = [r.standard_normal((n, quality.FEATURES)) for n in (1, 3, 5)]
    x, of, y = np.concatenate(bags), np.repeat([0, 1, 2], [1, 3, 5]), np.array([1.0, 0.0, 1.0])
    m.p = {k: r.standard_normal(v.shape) / 3 for k, v in m.p.items()}

    def plain(bag):
        """The score of one bag, passage by passage."""
        h = [np.tanh(v @ m.p["w"] + m.p["b"]) for v in bag]
        e = np.exp([np.tanh(u @ m.p["v"]) * (1 / (1 + np.exp(-(u @ m.p["u"])))) @ m.p["a"] for u in h])
        z = sum(a * u for a, u in zip(e / e.sum(), h))
        return float(1 / (1 + np.exp(-(z @ m.p["c"] + m.p["d"][0]))))

    assert np.allclose(m.score(x, of, 3)[0], [plain(np.clip(b, -8, 8)) for b in bags])
    loss = lambda: -np.mean([t * np.log(plain(b)) + (1 - t) * np.log(1 - plain(b)) for b, t in zip(bags, y)])
    grads = m.gradient(x, of, y)
    for k in m.p:
        for _ in range(3):
            at = tuple(r.integers(0, n) for n in m.p[k].shape)
            m.p[k][at] += 1e-5
            up = loss()
            m.p[k][at] -= 2e-5
            down = loss()
            m.p[k][at] += 1e-5
            assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-5


def test_windows_and_their_gradient():
    at, text = np.array([0, 1, 9, 0, 4]), np.array([0, 0, 0, 1, 1])
    found, y = np.arange(5)[:, None] % 3, np.array([1, 1, 1, 0, 0])
    w, marks, n = toxicity.windows(at, found, y, text)
    each = []
    for i in range(5):
        row = [(-1, 0)] * 5
        for j in range(5):
            if text[j] == text[i] and abs(at[j] - at[i]) <= 2:
                row[at[j] - at[i] + 2] = (int(found[j, 0]), int(y[j]))
        each.append(tuple(row))
    assert Counter(each) == {tuple(zip(a[:, 0].tolist(), b.tolist())): int(c) for a, b, c in zip(w, marks, n)}
    m, r = toxicity.ToxicSpans(), np.random.default_rng(1)
    p = {"w": r.standard_normal(3), "b": r.standard_normal(1), "e": r.standard_normal((2, 2))}

    def loss():
        total = 0.0
        for f, t, c in zip(w, marks, n):
            em = np.array([[0.0, p["b"][0] + (p["w"][k[0]] if k[0] >= 0 else 0)] for k in f])
            value = lambda s: sum(em[i, a] for i, a in enumerate(s)) + sum(p["e"][a, b] for a, b in zip(s, s[1:]))
            every = [[int(b) for b in f"{i:05b}"] for i in range(32)]
            total += c * (np.log(sum(np.exp(value(s)) for s in every)) - value(t.tolist()))
        return total / n.sum()

    grads = m.gradient(p, w, marks, n.astype(float))
    for k in p:
        for at_ in np.ndindex(p[k].shape):
            p[k][at_] += 1e-5
            up = loss()
            p[k][at_] -= 2e-5
            down = loss()
            p[k][at_] += 1e-5
            assert abs((up - down) / 2e-5 - grads[k][at_]) < 1e-5


def test_sample_counts_rows(spark):
    docs = spark.createDataFrame([(1, f"t{i:03d}") for i in range(500)] + [(2, "same"), (3, "same"), (4, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 5)] + [(None, 1)], "doc_id long, quality int")
    got = sample(docs, labels, "quality", 1, 7, 10).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "t000"), (2, "same"), (4, "")]


def plain_thresholds(rows):
    """kept of op 6, from measures by row: (lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    def values(r):
        w, lines = max(r[2], 1), max(r[5], 1)
        return 1000 * r[4] // w, 1000 * r[6] // lines, 1000 * r[7] // w, 1000 * r[3] // w

    def floor(v):
        low = max(v.bit_length() - 1 - 4, 0) if v else 0
        return v >> low << low

    def quartile(vs, percent):
        vs = sorted(map(floor, vs))
        return next(v for i, v in enumerate(vs, 1) if i * 100 >= len(vs) * percent)

    groups = {}
    for r in rows:
        for key in ((0, r[0], r[1]), (1, r[0], None), (2, None, None)):
            groups.setdefault(key, []).append(values(r))
    margins = ((150, None), (300, None), (250, None), (2000, 1500))
    out = []
    for r in rows:
        own = next(g for g in (groups[0, r[0], r[1]], groups[1, r[0], None], groups[2, None, None]) if len(g) >= 200 or g is groups[2, None, None])
        fine = not (r[2] < 50 or 100 * r[7] > 50 * r[2])
        for i, (up, down) in enumerate(margins):
            q1, q3 = quartile([g[i] for g in own], 25), quartile([g[i] for g in own], 75)
            v = values(r)[i]
            fine &= v <= q3 + 3 * (q3 - q1) + up and (down is None or v >= q1 - 3 * (q3 - q1) - down)
        out.append(fine)
    return out


def test_rules_against_plain_thresholds(spark):
    docs = spark.read.parquet(f"{DIR.replace('0.001', '0.01')}/documents.parquet")
    got = rules.judge(docs, ["doc_id"]).collect()
    rows = [(r["doc.lang"], r["doc.source"], r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in got]
    assert [r.kept for r in got] == plain_thresholds(rows)
    assert 0 < sum(r.kept for r in got) < sum(not r.base_failed for r in got) <= len(got)


def test_marginals_are_exact():
    r = np.random.default_rng(0)
    m = toxicity.ToxicSpans()
    m.bias, m.edges = -1.3, r.standard_normal((2, 2))
    for n in (1, 2, 7, 30):
        at = np.sort(r.choice(n, max(1, n // 3), replace=False))
        s = r.standard_normal(len(at)) * 2
        em = np.zeros((n, 2))
        em[:, 1] = m.bias
        em[at, 1] = s
        f, b = np.zeros((n, 2)), np.ones((n, 2))
        before = np.array([1.0, 0.0])
        for t in range(n):
            before = (before @ np.exp(m.edges)) * np.exp(em[t])
            f[t] = before
        for t in range(n - 2, -1, -1):
            b[t] = np.exp(m.edges) @ (np.exp(em[t + 1]) * b[t + 1])
        want = (f * b)[:, 1] / (f * b).sum(1)
        # two texts, the same one twice, to see that they don't mix
        got = m.marginals(np.tile(at, 2), np.tile(s, 2), np.repeat([0, 1], len(at)), np.array([n, n]))
        assert np.allclose(got, np.tile(want[at], 2))


def labelled(spark, n=400):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(20, 300))]
        words = ["".join(chr(97 + int(c)) for c in w[1:]) + "o" for w in words]
        toxic, bad = int(r.random() < 0.3), int(r.random() < 0.3)
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(["Zurgh!", "zurghing", "BLORK", "Élkkrr,"])
        if bad:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words), "clash"))
        labels.append((i, 1 - bad, toxic))
    rows += [(n, None, ""), (n + 1, "", ""), (n + 2, "zurgh " * 30000, "")]
    labels += [(n, None, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.filter("toxic is not null and doc_id is not null").collect()}
    model = toxicity.fit(docs, labels)
    got = {r["doc.doc_id"]: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert np.mean([(got[i].score >= 0.5) == bool(truth[i].toxic) for i in truth]) > 0.97
    assert got[400].score == got[401].score < 0.5 and got[400].spans == [] and got[402].score > 0.9
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in truth:
        for s in got[i].spans:
            assert texts[i][s.start : s.end].lower()[:4] in ("zurg", "blor", "élkk")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert np.mean([(got[i].score >= 0.7) == bool(truth[i].quality) for i in truth]) > 0.97
    assert all(0 <= r.score <= 1 and abs(sum(r.attention) - 1) < 1e-6 for r in got.values())
    none = labels.limit(0)
    assert quality.score(docs, quality.fit(docs, none)).select("score").distinct().count() == 1
    assert toxicity.score(docs, toxicity.fit(docs, none), ["doc_id"]).select("score").distinct().count() == 1
    assert quality.score(docs.limit(0), model).count() == 0


def test_scores_ignore_slices():
    texts = ["a zurgh b " * 50, "", "x " * 500]
    one = quality.encode(*text_arrays(pa.array(texts)))
    each = np.concatenate([quality.encode(*text_arrays(pa.array([t])))[0] for t in texts])
    assert np.allclose(one[0], each)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("n_words", F.lit("extra"))
    at = docs
    kept = [set(r.doc_id for r in docs.collect())]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, DIR).cache()
        assert at.columns == docs.columns
        kept.append({r.doc_id for r in at.collect()})
        assert kept[-1] <= kept[-2] and len(kept[-1]) > 60
    text = {r.doc_id: r.text for r in docs.collect()}
    classes = plain_classes([(i, text[i]) for i in kept[2]])
    assert kept[3] == {i for i in kept[2] if classes[i] == i}
    packed = corpus_pipeline.STAGES[-1][1](spark, at, DIR)
    assert {r.doc_id for r in packed.collect()} == kept[3]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, DIR), connect(DIR), queries.ORACLES[name]) == ""


def test_bounds_leave_most_exact_vectors_unread(spark):
    """Bounds hold every score, and only rows that may be among the best go on."""
    r = np.random.default_rng(8)
    x = np.floor(r.standard_normal((4000, 16)) * 300).astype(np.int64)
    q = x[:20]
    block = topk.Approximation.of(x)
    near, half = block.bounds(q)
    assert (np.abs(near - q @ x.T) <= half[:, None]).all()
    found = list(topk.candidates(block, np.arange(4000), np.arange(4000), q, np.arange(20), 10))
    kept = {i: set() for i in range(20)}
    for i, rows, _, lower, upper in found:
        assert (lower <= upper).all()
        for a, b in zip(i.tolist(), rows.tolist()):
            kept[a].add(b)
    for i in range(20):
        scores = x @ q[i]
        best = [j for j in np.lexsort((np.arange(4000), -scores)) if j != i][:10]
        assert set(best) <= kept[i] and len(kept[i]) < 400
