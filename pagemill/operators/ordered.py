"""Pages in order: what stands before and after a page of the same document.

Pages of a document are dealt to blocks by page number, and only the blocks' ends meet in one place,
so a document of any length is spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.keys import group_key

#: Page numbers of a block.
BLOCK_PAGES = 1 << 20
#: The block of pages without a number, before all others.
NO_BLOCK = -(1 << 62)


def with_neighbours(pages: DataFrame, document: str, page: str, columns: list[str], block_pages: int = BLOCK_PAGES) -> DataFrame:
    """Adds previous_<c> and next_<c>: the values of the pages before and after, in the order of page
    numbers, which needn't be without gaps; null at a document's ends. A null document is one, a null number comes
    first."""
    rows = pages.withColumn("_block", F.coalesce(F.expr(f"{page} DIV {block_pages}"), F.lit(NO_BLOCK))).withColumn("_g", group_key([document]))
    own, at = F.struct(*columns), F.coalesce(F.col(page), F.lit(NO_BLOCK))
    ends = rows.groupBy("_g", "_block").agg(F.min_by(own, at).alias("_first"), F.max_by(own, at).alias("_last"))
    blocks = Window.partitionBy("_g").orderBy("_block")
    ends = ends.select("_g", "_block", F.lag("_last").over(blocks).alias("_earlier"), F.lead("_first").over(blocks).alias("_later"))
    within = Window.partitionBy("_g", "_block").orderBy(page)
    rows = rows.join(ends, ["_g", "_block"])
    before, after = F.coalesce(F.lag(own).over(within), F.col("_earlier")), F.coalesce(F.lead(own).over(within), F.col("_later"))
    rows = rows.withColumn("_p", before).withColumn("_n", after)
    for c in columns:
        rows = rows.withColumn(f"previous_{c}", F.col(f"_p.{c}")).withColumn(f"next_{c}", F.col(f"_n.{c}"))
    return rows.drop("_g", "_block", "_earlier", "_later", "_p", "_n")
