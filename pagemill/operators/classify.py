"""Classification of pages: scopes with forward fill, sectors, titles, target candidates, anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import count_markers, fold, keyword_hits, with_folded
from pagemill.operators.keys import group_key
from pagemill.operators.ordered import NO_BLOCK

Vocabulary = dict[str, list[str]]


def ranked_hits(folded: Column, loosened: Column, vocabulary: Vocabulary) -> Column:
    """Names with a hit, most hits first, ties by name in falling order."""
    each = [F.struct(F.size(keyword_hits(folded, loosened, words)).alias("n"), F.lit(name).alias("name")) for name, words in vocabulary.items()]
    return F.transform(F.sort_array(F.filter(F.array(*each), lambda x: x["n"] > 0), asc=False), lambda x: x["name"])


#: Pages that one task puts in order.
PAGES_A_TASK = 1 << 20


def scope_ranges(pages: DataFrame, document: str, page: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """document, page, scopes: a page's own, else the first scope of the last page before it that has any.
    Pages are reduced to their scopes before they are put in order, and shuffled once. A document's pages
    are dealt to blocks by page number, and what a block hands on is filled in first, so no task holds a
    whole document. A null document is one; a null page number comes first."""
    folded = with_folded(pages.select(document, page, text), text, "_folded", "_loosened")
    own = folded.select(document, page, ranked_hits(F.col("_folded"), F.col("_loosened"), vocabulary).alias("_own"), F.coalesce(F.expr(f"{page} DIV {PAGES_A_TASK}"), F.lit(NO_BLOCK)).alias("_block"), group_key([document]).alias("_g"))
    own = own.repartition("_g", "_block")  # what both sides of the join below read
    top = F.get("_own", F.lit(0))
    ends = own.groupBy("_g", "_block").agg(F.max_by(top, F.when(top.isNotNull(), F.coalesce(F.col(page), F.lit(NO_BLOCK)))).alias("_end"))
    earlier = Window.partitionBy("_g").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    within = Window.partitionBy("_g", "_block").orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    filled = own.withColumn("_filled", F.last(top, ignorenulls=True).over(within)).join(ends, ["_g", "_block"])
    last = F.coalesce("_filled", "_before")
    scopes = F.when(F.size("_own") > 0, F.col("_own")).when(last.isNotNull(), F.array(last)).otherwise(F.array().cast("array<string>"))
    return filled.select(document, page, scopes.alias("scopes"))


def sector(pages: DataFrame, document: str, text: str, vocabulary: Vocabulary) -> DataFrame:
    """document, sector, n_hits: the sector with most distinct keywords anywhere in the document,
    the first one on ties. Pages are reduced to flags before the shuffle."""
    folded = with_folded(pages.select(document, text), text)
    flags = [F.max(F.size(keyword_hits(F.col("folded"), F.col("loosened"), [w])) > 0).cast("int").alias(f"f{i}_{j}") for i, words in enumerate(vocabulary.values()) for j, w in enumerate(words)]
    got = folded.groupBy(document).agg(*flags)
    each = [F.struct(sum((F.col(f"f{i}_{j}") for j in range(len(words))), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, words) in enumerate(vocabulary.items())]
    best = F.array_max(F.array(*each))
    return got.select(document, best["name"].alias("sector"), best["n"].alias("n_hits"))


def corrected_sector(explicit: Column, hits: dict[str, Column], least: int = 3) -> Column:
    """An explicit sector, unless another one has `least` hits or more and more than all others."""
    out = explicit
    for name, n in hits.items():
        others = [c for k, c in hits.items() if k != name]
        most = F.greatest(*others) if len(others) > 1 else others[0]
        out = F.when((n >= least) & (n > most), F.lit(name)).otherwise(out)
    return out


def titles(folded: Column, loosened: Column, patterns: Vocabulary) -> Column:
    """Targets of which a title pattern (a regular expression) stands in the text, in their order."""
    tests = []
    for k, ps in patterns.items():
        found = F.lit(False)
        for p in ps:  # each a literal, which is compiled once
            found = found | folded.rlike(p) | loosened.rlike(p)
        tests.append(F.when(found, F.lit(k)))
    return F.array_compact(F.array(*tests))


def target_candidates(folded: Column, loosened: Column, titles: Vocabulary, anchors: Vocabulary) -> Column:
    """Targets with a title, or with two anchors or more (a keyword listed twice counts twice)."""
    hits = lambda words: F.size(keyword_hits(folded, loosened, words))
    tests = [F.when((hits(titles[k]) > 0) | (hits(anchors[k]) >= 2), F.lit(k)) for k in titles]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def distinct_anchors(folded: Column, loosened: Column, anchors: Vocabulary) -> Column:
    return F.sort_array(F.array_distinct(keyword_hits(folded, loosened, [w for words in anchors.values() for w in words])))


def matched_rules(folded: Column, rules: dict[str, tuple[int | None, int, list[str]]]) -> Column:
    """Names of the rules (window, least hits, markers) whose markers the first `window` characters
    hold often enough, in their order."""
    tests = [F.when(count_markers(folded, markers, window) >= least, F.lit(name)) for name, (window, least, markers) in rules.items()]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def canonical(value: Column, names: dict[str, list[str]], default: str) -> Column:
    """The name that has the folded value among its aliases, else default."""
    out = F.lit(default)
    for name, aliases in names.items():
        out = F.when(fold(value).isin(name, *aliases), F.lit(name)).otherwise(out)
    return out
