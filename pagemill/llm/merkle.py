"""A Merkle manifest of a table: a tree for each source, and a tree of the sources' roots.

H is the lowercase hex sha256 of its inputs, one after the other. A row's leaf is H of its fields, each
`-` if null, else its UTF-8 byte count, `:` and its value. Leaves of a source stand by doc_id; while
several nodes remain, every FANOUT that follow each other (the last run may be shorter, even one) become
their H. A source's last node is its subroot; subroots by source make the tree of the whole in the same way.

Superblocks: the nodes of a source are dealt to blocks of FANOUT^LEVELS by their index. A block holds whole
runs, so one task collapses LEVELS levels of it to its root; the roots of a source are dealt and collapsed
again until one is left. On the way back each block gets the siblings of its root on all higher levels (its
upper proof), finds the lower ones from its own nodes, and joins both for each of its nodes. Blocks have
at most 4096 rows and their upper proofs are a few KB, however large a source is.

Indices come without a window over a source: rows are sorted by range, and only the first source of a
partition may have begun in an earlier one, so one offset a partition is broadcast.

Null doc_ids stand first; rows of equal doc_id stand by their leaves; rows that repeat everything are leaves
of their own. A null source is a source, the first one. A null value is `-`, an empty text `0:`. An empty
table gives no rows; columns beside the named fields are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import checkpoint, frequent_join, quoted, ship

FANOUT, LEVELS = 16, 3
BLOCK = FANOUT**LEVELS
#: Rows of a sorted partition, about.
SORTED_ROWS = 1 << 17
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def H(text: str) -> str:  # noqa: N802
    return sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def collapse(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and what they become, level by level."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([H("".join(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """What stands before and after node i in its run, and so on for the node above it, up to the last level
    but one."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % FANOUT
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + FANOUT])))
        i //= FANOUT
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = H(before + node + after)
    return node


def height(n: int) -> int:
    """The levels that n nodes take to become one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def indexed(rows: DataFrame, tree: str, order: list, total: int) -> DataFrame:
    """rows, a checkpoint, with i: a row's place in its tree by that order, from 0."""
    by = [tree, *order]
    dealt = rows.repartitionByRange(max(1, -(-total // SORTED_ROWS)), *by).sortWithinPartitions(*by)
    dealt = checkpoint(dealt.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    # A partition holds the rows of a tree side by side; only its first tree may have begun in an earlier one.
    spans = dealt.groupBy("part", tree).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    span = F.struct(F.col(tree).alias("tree"), "n")
    ends = spans.groupBy("part").agg(F.min_by(span, "low").alias("first"), F.max_by(span, "low").alias("last"), F.min("low").alias("low"))
    tails = ends.select("part", F.col("last.tree").alias(tree), F.col("last.n").alias("n"), F.lit(False).alias("begins"), "low")
    heads = ends.select("part", F.col("first.tree").alias(tree), F.lit(0).alias("n"), F.lit(True).alias("begins"), "low")
    before = Window.partitionBy(tree).orderBy("part").rangeBetween(Window.unboundedPreceding, -1)  # two rows a partition
    carried = tails.unionByName(heads).withColumn("carried", F.coalesce(F.sum("n").over(before), F.lit(0))).filter("begins").select(tree, "low", "carried")
    known = spans.join(F.broadcast(carried), [tree, "low"], "left").select("part", tree, (F.coalesce("carried", F.lit(0)) - F.col("low")).alias("shift"), "n")
    return frequent_join(dealt, known, ["part", tree], "n", total, "inner").withColumn("i", F.col("at") + F.col("shift")).drop("part", "at", "shift")


_NODES = "g string, i long, digest string"


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The root of each block of nodes (g, i, digest, n): g, i, digest."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        n = t.column("n")[0].as_py()
        own = collapse(t.column("digest").to_pylist(), min(levels, height(n)))
        return pa.table({"g": t.column("g").slice(0, 1), "i": pa.array([t.column("i")[0].as_py() // FANOUT**levels]), "digest": own[-1][:1]})

    return nodes.withColumn("block", F.expr(f"i DIV {FANOUT**levels}")).groupBy("g", "block").applyInArrow(run, _NODES)


def _sized(nodes: DataFrame) -> DataFrame:
    """Adds n, the nodes of each g; a frequent g is joined apart."""
    sizes = nodes.groupBy("g").agg(F.count("*").alias("n"))
    return frequent_join(nodes, sizes, ["g"], "n", nodes.count(), "inner")


def _paths(nodes: DataFrame, above: DataFrame | None, levels: int) -> DataFrame:
    """g, i, n, path of each node (g, i, digest, n), from the paths of blocks' roots (g, i, path); where `above`
    is null, each g is one block and its root has no path."""
    blocks = nodes.withColumn("block", F.expr(f"i DIV {FANOUT**levels}"))

    def run(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        path = up.column("path")[0].as_py() if up.num_rows else []
        own = collapse(t.column("digest").to_pylist(), min(levels, height(t.column("n")[0].as_py())))
        whole = [[{"before": b, "after": a} for b, a in siblings(own, k)] + path for k in range(t.num_rows)]
        return pa.table({"g": t.column("g"), "i": t.column("i"), "path": pa.array(whole, _PATH)})

    schema = "g string, i long, path array<struct<before:string,after:string>>"
    if above is None:
        return blocks.groupBy("g", "block").applyInArrow(lambda t: run(t, pa.table({})), schema)
    return blocks.groupBy("g", "block").cogroup(above.withColumnRenamed("i", "block").groupBy("g", "block")).applyInArrow(run, schema)


_PATH = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


class Tree:
    """The rounds of a forest (every g is a tree): each collapses blocks of the round below to their roots."""

    def __init__(self, nodes: DataFrame, levels: int):
        """nodes: g, i, digest."""
        self.levels, self.rounds = levels, [checkpoint(_sized(nodes))]
        while not self.rounds[-1].filter("n > 1").isEmpty():
            self.rounds.append(checkpoint(_sized(checkpoint(_roots(self.rounds[-1], levels)))))

    @property
    def roots(self) -> DataFrame:
        """g, digest."""
        return self.rounds[-1].select("g", "digest")

    def block_paths(self, above: DataFrame | None) -> DataFrame | None:
        """g, i, path of the root of each block of the lowest round: its siblings, level by level, and then the
        path of its tree's root in `above` (g, path). Null stands for no paths."""
        path = None if above is None else above.select("g", F.lit(0).cast("long").alias("i"), "path")
        for nodes in self.rounds[:0:-1]:
            path = checkpoint(_paths(nodes, path, self.levels))
        return path


def manifest(docs: DataFrame, levels: int = LEVELS, changed: Column | None = None, change: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row. Where `changed` holds,
    folded_root is folded from the leaf of the row with its fields replaced as `change` says, else from the leaf
    itself; verified tells whether it is the root."""
    ship(docs.sparkSession)
    kinds = {c: "long" if c in ("doc_id", "n_chars") else "string" for c in FIELDS}
    rows = docs.select(*(quoted(c).cast(kind).alias(c) for c, kind in kinds.items()))
    own = {c: F.col(c) for c in FIELDS}
    other = F.lit(None).cast("string") if changed is None else F.when(changed, leaf(list((own | (change or {})).values())))
    # Null sources first, others bytewise.
    g = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    leaves = checkpoint(rows.select(g.alias("g"), "doc_id", leaf(list(own.values())).alias("digest"), other.alias("other"), F.monotonically_increasing_id().alias("tie")))
    placed = checkpoint(indexed(leaves, "g", [F.col("doc_id").asc_nulls_first(), "digest", "tie"], leaves.count()).drop("n", "tie"))
    low = Tree(placed.select("g", "i", "digest"), levels)
    subroots = checkpoint(low.roots.select(F.lit("").alias("all"), F.col("g").alias("name"), "digest"))
    named = checkpoint(indexed(subroots, "all", ["name"], subroots.count()))
    high = Tree(named.select(F.col("all").alias("g"), "i", "digest"), levels)
    top = high.roots.first()
    root = F.lit(top["digest"] if top else None).cast("string")
    to_top = _paths(high.rounds[0], high.block_paths(None), levels).select("i", "path")
    paths = low.block_paths(named.select(F.col("name").alias("g"), "i").join(to_top, "i").select("g", "path")).withColumnRenamed("i", "block")

    def run(t: pa.Table, up: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        upper = [(x["before"], x["after"]) for x in up.column("path")[0].as_py()]
        total = height(t.column("n")[0].as_py())
        digests = t.column("digest").to_pylist()
        nodes = collapse(digests, min(levels, total))
        above = "".join(b + a for b, a in upper)
        subroot = fold(nodes[-1][0], upper[: total - min(levels, total)])
        proof, folded = [], []
        for k, (digest, changed) in enumerate(zip(digests, t.column("other").to_pylist())):
            path = siblings(nodes, k)
            proof.append(H("".join(b + a for b, a in path) + above))
            folded.append(fold(changed or digest, path + upper))
        return pa.table({"doc_id": t.column("doc_id"), "leaf": t.column("digest"), "subroot": [subroot] * t.num_rows, "proof_sha256": proof, "folded_root": folded})

    sized = frequent_join(placed, low.rounds[0].groupBy("g").agg(F.first("n").alias("n")), ["g"], "n", leaves.count(), "inner")
    blocks = sized.withColumn("block", F.expr(f"i DIV {FANOUT**levels}")).groupBy("g", "block")
    out = blocks.cogroup(paths.groupBy("g", "block")).applyInArrow(run, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
