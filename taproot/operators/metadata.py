"""Title and other data about a document, from the items of its first pages.

Items have ``document_id, node_id, ord, page_no, text, parent_ref, line_heights`` and a box ``l, t, r, b``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How near (points) the text under a label must begin, and the page that has the title.
NEAR, TITLE_PAGE = 6.0, 2


def titles(items: DataFrame, title_page: int = TITLE_PAGE) -> DataFrame:
    """``document_id, title``: the item of the title page whose first line is highest.

    Of equally high ones that with the smallest ``t`` counts, then the first.  Without line heights the first item counts; a
    document without a title page has no row.
    """
    high = F.coalesce(F.get("line_heights", F.lit(0)), F.lit(0.0))
    rows = items.where(F.col("page_no") == title_page).select("document_id", "text", "ord", high.alias("high"), F.when(high > 0, F.col("t")).otherwise(0.0).alias("low"))
    return rows.groupBy("document_id").agg(F.min(F.struct((-F.col("high")).alias("h"), "low", "ord", "text")).alias("x")).select("document_id", F.col("x.text").alias("title"))


def fields(items: DataFrame, labels: dict[str, tuple[str, int, int]]) -> DataFrame:
    """``document_id, field, ref``: what each field of ``labels`` (its label, first and last page) refers to.

    The first item of these pages that holds the label, in capitals or not, decides.  The first item right below it, at the
    same left edge, is what is referred to: itself if both have the same parent, else its parent.  Without such an item it is
    the labelled item itself.  Fields that aren't found have no row.
    """
    wanted = F.array(*[F.struct(F.lit(k).alias("field"), F.lit(label.lower()).alias("label"), F.lit(a).alias("low"), F.lit(z).alias("high")) for k, (label, a, z) in labels.items()])
    rows = items.select("document_id", "node_id", "ord", "text", "parent_ref", "l", "t", "b", F.explode(F.filter(wanted, lambda x: (F.col("page_no") >= x["low"]) & (F.col("page_no") <= x["high"]))).alias("w"))
    rows = rows.select("document_id", "w.field", "w.label", "node_id", "ord", "text", "parent_ref", "l", "t", "b")
    held = rows.where(F.lower("text").contains(F.col("label"))).groupBy("document_id", "field").agg(F.min(F.struct("ord", "node_id", "parent_ref", "l", "b")).alias("h"))
    near = rows.join(held, ["document_id", "field"]).where((F.abs(F.col("h.b") - F.col("t")) < NEAR) & (F.abs(F.col("h.l") - F.col("l")) < NEAR) & F.col("parent_ref").isNotNull() & F.col("h.parent_ref").isNotNull())
    ref = F.when(F.col("parent_ref") == F.col("h.parent_ref"), F.col("node_id")).otherwise(F.col("parent_ref"))
    found = near.groupBy("document_id", "field").agg(F.min(F.struct("ord", ref.alias("ref"))).alias("n"))
    return held.join(found, ["document_id", "field"], "left").select("document_id", "field", F.coalesce("n.ref", "h.node_id").alias("ref"))
