"""Near duplicates by BagMinHash signatures, bands and verified multiset overlap.

A text is the multiset of its shingles of SHINGLE words (words: runs without ASCII white space; a
shorter text is one shingle). A signature of SIZE components estimates the weighted Jaccard
similarity without bias: every shingle's weights, cut into dyadic intervals, carry Poisson processes
of points; a point belongs to a component and to a unit of its interval, which is found by halving
the interval; points above the shingle's weight are discarded, and each component keeps its
earliest point. Generation stops where no component can still get an earlier one.

1. Texts with equal words become one member, whatever their number.
2. BANDS bands of ROWS components deal members into buckets. Each bucket has a leader, chosen by
   hash, so that the leaders of a member's buckets differ. Of the leaders whose signatures agree with
   a member's in PLAUSIBLE of the components or more, the LEADERS likeliest are verified on the whole
   texts, and verified links make components.
3. What is left is done in full. Buckets that hold several components are gathered by the largest
   component in each, so that the many buckets of one large cluster become one group, in which a
   member stands once. In a group, each block of members meets each block of askers, which are those
   outside that component, and all plausible pairs of different components are verified where they
   meet, without a row for a pair. Blocks hold about CELL members and CELL_WORDS words.

A link of similarity 0.8 shares no band with probability 3e-6, and agrees in less than PLAUSIBLE with
5e-7. Nothing else is dropped. What grows with a cluster is the number of members times that of those
which step 2 didn't link to it. A bucket's or text's share of all rows doesn't decide the size of a
task: frequent keys are joined apart (common.frequent_join).

A document is a distinct pair of doc_id and text: a doc_id that stands on several texts is as many
documents, each in the class of its own text. Words are equal if 64-bit hashes are, texts if two are,
and the overlap is that of 64-bit hashes of shingles. Texts without words (null, empty, blank) are
each a class of their own. Rows that repeat a doc_id and its text share a class like any copies. A
null doc_id has a null class. An empty table has no classes; columns beside doc_id and text are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, discard, frequent_join, mix, ship, slices, small_side, span_hashes, text_arrays, tidy, word_spans
from pagemill.llm.components import components, merged

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
SIZE = BANDS * ROWS
PLAUSIBLE = 0.6
LEADERS = 3
#: Members and words of a block, as far as single texts allow.
CELL, CELL_WORDS = 512, 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(buf: np.ndarray, offsets: np.ndarray, width: int = SHINGLE):
    """Texts, hashes and counts of the distinct shingles of each text, in order; words of each text;
    two hashes of each text's words."""
    n = len(offsets) - 1
    starts, lens, text = word_spans(buf, offsets)
    words = np.bincount(text, minlength=n)
    h = span_hashes(buf, starts, lens)
    first = np.cumsum(words) - words
    windows = np.where(words > 0, np.maximum(1, words - width + 1), 0)
    of = np.repeat(np.arange(n), windows)
    at = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + first[of]
    s = np.zeros(len(of), np.uint64)
    last = (first + words)[of]
    for k in range(width):
        there = at + k < last
        s[there] += mix(h[at[there] + k] + np.uint64((k + 1) * int(_GOLDEN) % (1 << 64)))
    s = mix(s)
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    keys = np.zeros((n, 2), np.uint64)
    if len(h):
        place = (np.arange(len(h)) - first[text]).astype(np.uint64)
        some = words > 0
        for c in range(2):
            keys[some, c] = np.add.reduceat(mix((h ^ np.uint64(c)) + mix(place * _GOLDEN + np.uint64(c + 5))), first[some])
    return of[at], s[at], np.diff(np.append(at, len(s))), words, keys


def bag_min_hash(of: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """The earliest point of each of `size` components of n bags of (shingle, integer weight)."""
    best = np.full(n * size, np.iinfo(np.int64).max)
    runs, low = [], 0  # low: where an interval begins; intervals are (0, 1], (1, 2], (2, 4], ...
    own = np.arange(len(of))
    while len(own):
        runs.append((own, np.full(len(own), low)))
        low = max(1, 2 * low)
        own = own[weight[own] > low]
    if not runs:
        return best.reshape(n, size)
    who, low = (np.concatenate(x) for x in zip(*runs))
    length = np.maximum(low, 1)
    base = mix(shingle[who] ^ mix(low.astype(np.uint64) + np.uint64(17)))
    text, room = of[who], weight[who] - low  # units of the interval that the weight covers
    x, t, ahead = np.zeros(len(who), np.int64), 0, 1
    bits = np.uint64(40)
    while len(text):
        r = mix(base[:, None] + np.arange(t + 1, t + ahead + 1, dtype=np.uint64) * _GOLDEN)
        u = (mix(r + _GOLDEN) >> np.uint64(11)).astype(np.float64) + 1
        # Whole numbers, whose sums don't depend on how many are drawn at once.
        step = np.floor(-np.log(u * 2.0**-53) / length[:, None] * 2.0**40).astype(np.int64)
        points = x[:, None] + (np.cumsum(step, 1) if ahead > 1 else step)
        component = ((r & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        # Halving the interval (its length is a power of two) log2(length) times by one bit each.
        unit = (r >> bits).astype(np.int64) & (length - 1)[:, None]
        fine = unit < room[:, None]
        np.minimum.at(best, (text[:, None] * size + component)[fine], points[fine])
        x, t = points[:, -1], t + ahead
        worst = best.reshape(n, size).max(1)
        on = x < worst[text]
        text, room, length, base, x = text[on], room[on], length[on], base[on], x[on]
        ahead = int(min(32, max(1, 60_000 // max(len(text), 1))))
    return best.reshape(n, size)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text as it is), k0, k1 (hashes of the text's words), words, sig (binary,
    two bytes a component) of rows of doc_id and text."""

    def run(batches):
        for part in slices(batches):
            of, s, w, words, keys = shingles(*text_arrays(part.column("text")))
            sig = (mix(bag_min_hash(of, s, w, part.num_rows).view(np.uint64)) >> np.uint64(48)).astype("<u2")
            sigs = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(np.arange(0, 2 * SIZE * len(sig) + 1, 2 * SIZE, np.int32)), pa.py_buffer(sig.tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), *(pa.array(keys[:, c].view(np.int64)) for c in range(2)), pa.array(words, pa.int64()), sigs], ["doc_id", "t", "k0", "k1", "words", "sig"])

    return docs.withColumn("t", F.xxhash64("text")).mapInArrow(run, "doc_id long, t long, k0 long, k1 long, words long, sig binary")


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SIZE)


def buckets(sig: Column) -> Column:
    """The buckets of a signature, one for each band."""
    return F.array(*(F.xxhash64(F.lit(i), F.substring(sig, 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)))


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The weighted Jaccard similarity of shingles of each pair of texts."""
    n, key, weight = len(a), [], []
    total = np.zeros(n)
    for texts in (a, b):
        of, s, w, _, _ = shingles(*text_arrays(texts))
        key.append(mix(s ^ mix(of.astype(np.uint64) + _GOLDEN)))
        weight.append(w)
        total += np.bincount(of, w, minlength=n)
        last = of
    _, i, j = np.intersect1d(*key, assume_unique=True, return_indices=True)
    both = np.bincount(last[j], np.minimum(weight[0][i], weight[1][j]), minlength=n)
    return both / np.maximum(total - both, 1)


def _asked_leaders(shared: DataFrame, sigs: DataFrame) -> DataFrame:
    """node, lead, words: of each member the LEADERS leaders of its buckets that are likeliest to be alike."""

    def run(batches):
        for part in batches:
            agree = (signatures(part.column("sig")) == signatures(part.column("lead_sig"))).mean(1)
            fine = pa.array(agree >= PLAUSIBLE)
            yield pa.RecordBatch.from_arrays([*(part.column(c).filter(fine) for c in ("node", "lead", "words")), pa.array(agree).filter(fine)], ["node", "lead", "words", "agree"])

    pairs = shared.filter("node <> lead").select("node", "lead", "words").distinct()
    own = sigs.select("node", "sig")
    pairs = pairs.join(own, "node").join(own.toDF("lead", "lead_sig"), "lead")
    likely = pairs.mapInArrow(run, "node long, lead long, words long, agree double")
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("agree"), "lead"))  # at most BANDS rows
    return likely.withColumn("rank", best).filter(F.col("rank") <= LEADERS).select("node", "lead", "words")


def _dealt(members: DataFrame, total: int) -> DataFrame:
    """grp, part, team, node, component, asks, asked, words, from members (grp, node, component, asks,
    words; a row for each grp and node): a row for each cell that a member stands in."""
    sizes = members.groupBy("grp").agg(
        F.count("*").alias("n"),
        F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("words") / CELL_WORDS)).alias("parts"),
        F.greatest(F.ceil(F.count_if("asks") / CELL), F.ceil(F.sum(F.when(F.col("asks"), F.col("words"))) / CELL_WORDS)).alias("teams"),
    )
    own = frequent_join(members, sizes, ["grp"], "n", total, "inner")
    own = own.withColumn("p", F.expr("pmod(xxhash64(node, grp), parts)")).withColumn("t", F.expr("pmod(xxhash64(grp, node), teams)"))
    cell = "named_struct('part', {}, 'team', {}, 'asks', {}, 'asked', {})"
    asked = f"transform(sequence(0L, teams - 1), i -> {cell.format('p', 'i', 'asks AND i = t', 'true')})"
    asking = f"transform(filter(sequence(0L, parts - 1), i -> i <> p), i -> {cell.format('i', 't', 'true', 'false')})"
    return own.select("grp", "node", "component", "words", F.expr(f"inline(CASE WHEN asks THEN concat({asked}, {asking}) ELSE {asked} END)"))


def _meet(t: pa.Table) -> pa.Table:
    """The members of a cell that have plausible pairs; partners: of an asker, those it asks."""
    sig, (node, component, words) = signatures(t.column("sig")), (t.column(c).to_numpy() for c in ("node", "component", "words"))
    asks, asked = (t.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "asked"))
    asking, other = np.flatnonzero(asks), np.flatnonzero(asked)
    size = np.maximum(words - SHINGLE + 1, 1)  # shingles of each text
    theirs = np.ascontiguousarray(sig[other].T)
    out: dict[int, list[int]] = {}
    for first in range(0, len(asking), 64):
        own = asking[first : first + 64]
        near = np.zeros((len(own), len(other)), np.uint8)
        for c in range(SIZE):
            near += theirs[c] == sig[own, c, None]
        fine = (near >= PLAUSIBLE * SIZE) & (component[other] != component[own, None])
        # Texts of too different sizes can't overlap enough.
        fine &= np.minimum(size[other], size[own, None]) >= SIMILARITY * np.maximum(size[other], size[own, None])
        # Two askers of one cell would ask each other.
        fine &= ~asks[other] | (node[other] > node[own, None])
        for i, row in zip(own.tolist(), fine):
            there = other[row]
            if len(there):
                out[i] = node[there].tolist()  # also where an empty list stands since i was asked
                for j in there.tolist():
                    out.setdefault(j, [])
    own = sorted(out)
    return pa.table({**{c: t.column(c).take(pa.array(own, pa.int64())) for c in _CELL_COLUMNS}, "partners": pa.array([out[i] for i in own], pa.list_(pa.int64()))})


_CELL_COLUMNS = ("grp", "part", "team", "node", "component")


def _verify(t: pa.Table) -> pa.Table:
    """Of each asker of a cell, one partner of each component that it overlaps with enough."""
    _, at = np.unique(t.column("node").to_numpy(), return_index=True)  # a text may stand on several rows
    t = t.take(pa.array(at))
    node, component = t.column("node").to_numpy(), t.column("component").to_numpy()
    of, s, w, _, _ = shingles(*text_arrays(t.column("text")))
    at = np.searchsorted(of, np.arange(len(node) + 1))
    total = np.bincount(of, w, minlength=len(node))
    names, s = np.unique(s, return_inverse=True)
    weight = np.zeros(len(names), w.dtype)
    a, b = [], []
    for i, partners in enumerate(t.column("partners").to_pylist()):
        if not partners:
            continue
        mine = slice(at[i], at[i + 1])
        weight[s[mine]] = w[mine]
        j = np.searchsorted(node, np.array(partners))
        span = at[j + 1] - at[j]
        firsts = np.cumsum(span) - span
        rows = np.arange(int(span.sum())) + np.repeat(at[j] - firsts, span)
        both = np.add.reduceat(np.minimum(weight[s[rows]], w[rows]), firsts)
        weight[s[mine]] = 0
        found = j[both >= SIMILARITY * (total[i] + total[j] - both)]
        for k in found[np.unique(component[found], return_index=True)[1]].tolist():
            a.append(int(node[i]))
            b.append(int(node[k]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _links(met: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Verified links (a, b) of cells with partners; texts are joined to the members that stand in
    one. Each text is found by its doc_id and hash among all rows."""
    asked = small_side(checkpoint(met.select("node").distinct()))
    keys = small_side(checkpoint(reps.select("node", "doc_id", "t").join(asked, "node")))
    texts = docs.withColumn("t", F.xxhash64("text")).join(keys, ["doc_id", "t"]).select("node", "text")
    # MERGE: AQE splits a text that stands in very many cells.
    return met.hint("merge").join(texts, "node").groupBy("grp", "part", "team").applyInArrow(_verify, "a long, b long")


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), class_id, kept (whether no document of the class has a lesser
    doc_id, or the same one and a lesser t): a row for each row of docs whose doc_id isn't null."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    every = checkpoint(signed(docs).withColumn("row", F.monotonically_increasing_id()))
    least = every.filter("words > 0").groupBy("k0", "k1").agg(F.min(F.struct("doc_id", "t", "row", "words", "sig")).alias("r"), F.count("*").alias("rows"))
    reps = checkpoint(least.select(F.col("r.row").alias("node"), "k0", "k1", "r.doc_id", "r.t", "r.words", "r.sig", "rows"))
    members = reps.count()
    entries = reps.select("node", "words", F.explode(buckets(F.col("sig"))).alias("bucket"))
    lead = F.min(F.col("node").bitwiseXOR(F.xxhash64("bucket")))  # another order of the members in each bucket
    heads = entries.groupBy("bucket").agg(F.count("*").alias("n"), lead.alias("lead")).filter("n > 1").select("bucket", "n", F.col("lead").bitwiseXOR(F.xxhash64("bucket")).alias("lead"))
    shared = checkpoint(frequent_join(entries, heads, ["bucket"], "n", members, "inner"))
    # First links: a group for each leader, who is asked by the others.
    tidy(spark)
    asked = checkpoint(_asked_leaders(shared, reps))
    first = asked.select(F.col("lead").alias("grp"), "node", F.col("node").alias("component"), F.lit(True).alias("asks"), "words")
    sizes = first.groupBy("grp").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("words") / CELL_WORDS)).alias("parts"))
    askers = frequent_join(first, sizes, ["grp"], "n", members, "inner")
    askers = askers.select("grp", F.expr("pmod(xxhash64(node, grp), parts)").alias("part"), F.lit(0).cast("long").alias("team"), "node", "component", F.array("grp").alias("partners"))
    leads = sizes.select("grp", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.lit(0).cast("long").alias("team"), F.col("grp").alias("node"), F.col("grp").alias("component"), F.expr("cast(array() as array<long>)").alias("partners"))
    links = _links(checkpoint(askers.unionByName(leads)), reps, docs)
    tidy(spark)
    labels = checkpoint(components(links))
    discard(asked)
    tidy(spark)
    # All others: buckets with several components, gathered by the largest of each.
    own = shared.join(small_side(labels), "node", "left")
    own = own.select("bucket", "node", "words", "n", F.coalesce("component", "node").alias("component"))
    kinds = own.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    top = kinds.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("kinds"), F.sum("c").alias("n")).filter("kinds > 1").select("bucket", "n", F.col("top.component").alias("grp"))
    mixed = frequent_join(own.drop("n"), top, ["bucket"], "n", members, "inner")
    mixed = checkpoint(mixed.groupBy("grp", "node").agg(F.first("component").alias("component"), F.first("words").alias("words")).withColumn("asks", F.expr("component <> grp")))
    cells = _dealt(mixed, members).join(reps.select("node", "sig"), "node")
    met = checkpoint(cells.groupBy("grp", "part", "team").applyInArrow(_meet, "grp long, part long, team long, node long, component long, partners array<long>"))
    discard(shared, mixed)
    tidy(spark)
    labels = checkpoint(merged(labels, checkpoint(_links(met, reps, docs))))
    tidy(spark)
    # A class's least document, and with it every row.
    of = reps.select("node", "k0", "k1", "rows", F.struct("doc_id", "t").alias("doc")).join(small_side(labels), "node", "left")
    of = checkpoint(of.select("k0", "k1", "rows", "doc", F.coalesce("component", "node").alias("component")))
    least = of.groupBy("component").agg(F.min("doc").alias("least"), F.count("*").alias("n"))
    texts = frequent_join(of, least, ["component"], "n", members, "inner").select("k0", "k1", "rows", "least")
    rows = every.filter("words > 0").select("k0", "k1", "doc_id", "t")
    rows = frequent_join(rows, texts, ["k0", "k1"], "rows", members, "inner").select("doc_id", "t", F.col("least.doc_id").alias("class_id"), (F.struct("doc_id", "t") == F.col("least")).alias("kept"))
    return rows.unionAll(every.filter("words = 0").select("doc_id", "t", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept")))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: the least doc_id of the document's class; a row for each row of docs."""
    none = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return labelled(docs).select("doc_id", "class_id").unionAll(none)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The least document of each class, by doc_id and then by the text's hash; of rows that repeat a
    doc_id and its text one stays. Rows with a null doc_id all stay."""
    found = labelled(docs).groupBy("doc_id", "t").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    found = checkpoint(found.filter("NOT kept OR n > 1"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    rows = rows.join(small_side(found), ["doc_id", "t"], "left")
    once = rows.filter("kept is null")
    if not found.filter("kept").isEmpty():
        once = once.unionByName(rows.filter("kept").dropDuplicates(["doc_id", "t"]))
    return once.select("doc.*")
