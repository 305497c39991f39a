"""Repair of parsed page items: reading order, broken paragraphs, regions, page furniture and tables.

Items have ``document_id, ord, page_no, label, text, parent_ref`` and a box ``l, t, r, b`` with the origin at the bottom
left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.functions.text import SPACE
from taproot.operators.construct import CAPTION
from taproot.plans.lineage import stored

# Sizes in points and words that decide on page structure.
RULE_HEIGHT, RULE_SHARE, BOX_WIDTH, BOX_HEIGHT, PAGE_SHARE = 3.0, 0.6, 40.0, 20.0, 0.95
PADDING, ROW_GAP, PICTURE_HEIGHT, PICTURE_PAGES, CELL_SHARE = 2.0, 2.0, 15.0, 3, 0.8
LINE_GAP, LINE_GAP_SHARE, LINE_OVERLAP = 4.0, 0.35, 0.3
#: Rows that are broadcast, at most.
SENT = 50_000
# How an entry of a bibliography begins, and what a hyphen before isn't one of a broken word.
CITATION = r"^[A-ZÄÖÜ][a-zäöüß]+(?:-[A-ZÄÖÜ][a-zäöüß]+)?\s+[A-Z]{1,3}[,.]"
CONNECTIVES = ("und", "oder", "bzw", "sowie", "beziehungsweise", "and", "or")


def bottom_left(box: Column, height: Column) -> Column:
    """A box of either origin with its origin at the bottom left."""
    top = F.upper(F.coalesce(box["coord_origin"], F.lit(""))) == "TOPLEFT"
    return F.struct(box["l"].alias("l"), F.when(top, height - box["t"]).otherwise(box["t"]).alias("t"), box["r"].alias("r"), F.when(top, height - box["b"]).otherwise(box["b"]).alias("b"))


def structure(shapes: DataFrame, pages: DataFrame) -> DataFrame:
    """Dividers (tops of wide rules, from the top) and boxes of each page, from drawn shapes with l, t, r, b."""
    rows = shapes.join(pages, ["document_id", "page_no"])
    w, h = F.col("r") - F.col("l"), F.col("t") - F.col("b")
    rule = (h <= RULE_HEIGHT) & (w >= RULE_SHARE * F.col("width"))
    box = (w >= BOX_WIDTH) & (h >= BOX_HEIGHT) & ~((w >= PAGE_SHARE * F.col("width")) & (h >= PAGE_SHARE * F.col("height")))
    return rows.groupBy("document_id", "page_no").agg(
        F.sort_array(F.collect_set(F.when(rule, F.col("t"))), False).alias("dividers"), F.collect_list(F.when(box, F.struct("l", "t", "r", "b"))).alias("boxes")
    )


def sized(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Sizes of all pages of the items.  One that isn't known is what the items of the document span with equal margins."""
    span = items.groupBy("document_id").agg((F.min("l") + F.max("r")).alias("_w"), F.abs(F.min("b") + F.max("t")).alias("_h"))
    rows = items.select("document_id", "page_no").distinct().join(pages.select("document_id", "page_no", "width", "height"), ["document_id", "page_no"], "left").join(span, "document_id", "left")
    return rows.select("document_id", "page_no", F.coalesce("width", "_w").alias("width"), F.coalesce("height", "_h").alias("height"))


def placed(items: DataFrame, pages: DataFrame, shapes: DataFrame, bare: DataFrame | None = None) -> DataFrame:
    """Items with their ``block`` (dividers above), ``column`` (0 left, 1 right of the middle) and repaired ``place``.

    ``last_block`` is the greatest block of the page, ``_p`` its :func:`page_key`, by which the rows lie.  The place orders by page and block and keeps the given order inside; of equal ``ord`` the lesser ``node_id``, if
    there is one, comes first.  Every item is kept: a page without a size gets that of :func:`sized`, an item without a
    page is in block 0 and column 0.  ``bare`` are the items without what places don't need, if they are at hand.  Items
    that have ``_p`` and lie by it are shuffled no more.
    """
    bare = items if bare is None else bare
    pages = sized(bare, pages)
    # Everything is joined and counted by document and page, so that the items are shuffled once.
    at = ["document_id", "_p"]
    known = pages.where("page_no is not null").join(structure(shapes, pages), ["document_id", "page_no"], "left").select("document_id", page_key(), "width", "height", "dividers", "boxes").dropDuplicates(at)
    # Places count within a page, from where the pages before it end; so no window runs over a document's items.
    before = F.sum("_n").over(Window.partitionBy("document_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = bare.groupBy("document_id", page_key()).agg(F.count("*").alias("_n")).select(*at, F.coalesce(before, F.lit(0)).alias("_before"))
    block = F.size(F.filter(F.coalesce("dividers", F.array().cast("array<double>")), lambda d: F.col("t") < d))
    column = F.when(F.col("width").isNull() | ((F.col("l") + F.col("r")) / 2 < F.col("width") / 2), 0).otherwise(1)
    rows = (items if "_p" in items.columns else items.withColumn("_p", page_key())).join(starts.join(known, at, "left"), at).withColumns({"block": block, "column": column})
    page, order = Window.partitionBy(*at), ["block", "ord", *[c for c in ("node_id",) if c in items.columns]]
    own = F.row_number().over(page.orderBy(*order))
    return rows.withColumns({"place": (F.col("_before") + own).cast("int"), "last_block": F.max("block").over(page)}).drop("_before")


def page_key() -> Column:
    """The page of an item, one without a page before all others."""
    return F.coalesce("page_no", F.lit(-(2**31))).alias("_p")


def unfinished(text: Column) -> Column:
    """Whether a text breaks off: no final mark or address at its end, but a comma, a hyphen or a word in small letters."""
    t = F.regexp_replace(text, f"[{SPACE}]+$", "")
    final = t.rlike(r'[.!?:;)\]"”’»]$') | t.rlike(r"[^\s@]+@[^\s@]+\.[A-Za-z]{2,}[.,;:]?$")
    return (t != "") & ~final & (t.rlike(r"[,\-\u00ad]$") | F.regexp_extract(t, f"([^{SPACE}]+)$", 1).rlike(r"^\p{Ll}"))


def resumes(text: Column) -> Column:
    """Whether a text goes on with another: it begins with a letter and is no caption, numbered entry or citation."""
    t = F.regexp_replace(text, f"^[{SPACE}]+", "")
    bare = F.regexp_replace(t, r"^[(\[]+", "")
    return ~t.rlike(f"(?iU){CAPTION}") & ~bare.rlike(r"^\d+[\s.)]") & ~bare.rlike(CITATION) & bare.rlike(r"^\p{L}")


def join_continuation(head: Column, tail: Column) -> Column:
    """Two parts of one paragraph: soft hyphens go, hyphens join unless a connective follows, else a space."""
    follower = F.lower(F.regexp_extract(tail, r"^\s*(\p{L}+)", 1))
    h, t = F.rtrim(head), F.ltrim(tail)
    return (
        F.when(h.endswith("­"), F.concat(F.regexp_replace(h, "­$", ""), t))
        .when(h.endswith("-") & ~follower.isin(*CONNECTIVES), F.concat(F.regexp_replace(h, "-$", ""), t)).otherwise(F.concat(h, F.lit(" "), t))
    )


def stitch(rows: DataFrame) -> DataFrame:
    """Paragraphs that run over columns or pages put together; other items stay as they are.

    A part continues the one before it (of running text) if that one breaks off at the foot of its column and this one
    goes on at the head of a later column or page.  ``provenance`` has the page and box of every part.
    """
    running = F.col("label").isin("text", "list_item", "footnote") & ~F.coalesce(F.col("parent_ref").contains("pictures"), F.lit(False))
    rows, bare = _bare(rows, running=running)
    column = Window.partitionBy("document_id", "_p", "block", "column")
    bare = bare.withColumns({"_foot": F.min(F.when(F.col("running"), F.col("b"))).over(column), "_head": F.max(F.when(F.col("running"), F.col("t"))).over(column)})
    # The item before the first of a page is the last of the page before; that takes one row a page.
    seen = F.struct("page_no", "block", "column", "b", "_foot", "breaks")
    bare = stored(bare)
    ends = bare.groupBy("document_id", "_p").agg(F.max_by(seen, "place").alias("_end"))
    ends = ends.select("document_id", "_p", F.lag("_end").over(Window.partitionBy("document_id").orderBy("_p")).alias("_end"))
    page = Window.partitionBy("document_id", "_p").orderBy("place")
    bare = bare.join(ends, ["document_id", "_p"]).withColumn("_was", F.coalesce(F.lag(seen).over(page), "_end"))
    was = lambda c: F.col("_was")[c]
    later = (F.col("page_no") > was("page_no")) | ((F.col("page_no") == was("page_no")) & (F.col("block") == was("block")) & (F.col("column") > was("column")))
    return _joined(rows, bare, later & (was("b") == was("_foot")) & (F.col("t") == F.col("_head")) & was("breaks") & F.col("resumes"))


def _bare(rows: DataFrame, **more: Column) -> tuple[DataFrame, DataFrame]:
    """Placed rows, written once, and what decides on them without their texts."""
    rows = stored(rows.withColumns({"_p": page_key(), "breaks": unfinished(F.coalesce("text", F.lit(""))), "resumes": resumes(F.coalesce("text", F.lit("")))} | more))
    return rows, rows.select("document_id", "place", "_p", "page_no", "block", "column", "l", "t", "r", "b", "breaks", "resumes", *more)


def _joined(rows: DataFrame, bare: DataFrame, goes_on: Column) -> DataFrame:
    """Rows that go on with the one before them, put together with it, over pages if need be.

    Where islands begin is found without texts; only those of more than one row are gathered.
    """
    bare = stored(bare.select("document_id", "place", "_p", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("place")).alias("_start")))
    open_ = bare.groupBy("document_id", "_p").agg(F.max("_start").alias("_open"))
    carried = F.last("_open", True).over(Window.partitionBy("document_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    page = Window.partitionBy("document_id", "_p").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bare = bare.join(open_.select("document_id", "_p", carried.alias("_carried")), ["document_id", "_p"]).select("document_id", "place", F.coalesce(F.last("_start", True).over(page), "_carried").alias("_first"))
    later = stored(bare.where("place <> _first"))
    # Rows of islands of several: their later parts, and the first that those name.  Few enough of them are sent to all tasks.
    several = later.unionByName(later.select("document_id", F.col("_first").alias("place"), "_first").distinct())
    if later.limit(SENT + 1).count() <= SENT:
        several = F.broadcast(several)
    made = _whole(rows.join(several, ["document_id", "place"]).groupBy("document_id", "_first").agg(_parts()))
    alone = rows.join(several, ["document_id", "place"], "left_anti")
    own = F.array(F.struct("page_no", "l", "t", "r", "b")).alias("provenance")
    return made.unionByName(alone.select("document_id", "place", "ord", "page_no", "label", F.coalesce("text", F.lit("")).alias("text"), F.lit(1).alias("parts"), own))


def _parts() -> Column:
    """Aggregate: the rows of an island in their order."""
    return F.array_sort(F.collect_list(F.struct("place", "ord", "page_no", "label", "text", "l", "t", "r", "b"))).alias("p")


def _whole(islands: DataFrame) -> DataFrame:
    """Islands with their parts ``p`` as one row each."""
    texts = F.transform("p", lambda x: F.coalesce(x["text"], F.lit("")))
    whole = F.aggregate(F.slice(texts, 2, F.size(texts)), texts[0], join_continuation)
    box = lambda x: F.struct(x["page_no"].alias("page_no"), x["l"].alias("l"), x["t"].alias("t"), x["r"].alias("r"), x["b"].alias("b"))
    head = F.col("p")[0]
    return islands.select("document_id", *[head[c].alias(c) for c in ("place", "ord", "page_no", "label")], whole.alias("text"), F.size("p").alias("parts"), F.transform("p", box).alias("provenance"))


def line_fragments(rows: DataFrame) -> DataFrame:
    """Lines of one block put together where pages are read line by line: in figures, sidebars and the front matter.

    Placed rows with ``region``.  A line goes on with the one before it on its page if both are of one such region, that
    one breaks off, this one resumes, it lies right below, and the two overlap.  Other rows stay as they are.

    Nothing goes on over a page, and placed rows lie by page already; so they are neither written nor shuffled here.
    """
    page, by_line = ["document_id", "_p"], F.col("region").isin("figure", "sidebar", "front_matter")
    text = F.coalesce("text", F.lit(""))
    rows = rows.select(*page, "place", "ord", "page_no", "label", "text", "l", "t", "r", "b", "region", F.when(by_line, unfinished(text)).alias("breaks"), F.when(by_line, resumes(text)).alias("resumes"))
    order = Window.partitionBy(*page).orderBy("place")
    was = lambda c: F.lag(c).over(order)
    gap = was("b") - F.col("t")
    lower = F.least(was("t") - was("b"), F.col("t") - F.col("b"))
    shared, narrow = F.least(was("r"), F.col("r")) - F.greatest(was("l"), F.col("l")), F.least(was("r") - was("l"), F.col("r") - F.col("l"))
    near = (gap >= 0) & (gap <= F.greatest(F.lit(LINE_GAP), LINE_GAP_SHARE * lower)) & (narrow > 0) & (shared / narrow > LINE_OVERLAP)
    goes_on = (F.col("region") == was("region")) & by_line & near & was("breaks") & F.col("resumes")
    rows = rows.withColumn("_start", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("place")))
    first = F.last("_start", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _whole(rows.withColumn("_first", first).groupBy(*page, "_first").agg(_parts()))


def regions(rows: DataFrame, title_page: int = 2) -> DataFrame:
    """Region of each placed item: figure, sidebar (in a box), front_matter or body, the first that holds."""
    inside = F.exists(F.coalesce("boxes", F.array().cast("array<struct<l:double,t:double,r:double,b:double>>")), lambda x: (F.col("l") >= x["l"] - PADDING) & (F.col("r") <= x["r"] + PADDING) & (F.col("t") <= x["t"] + PADDING) & (F.col("b") >= x["b"] - PADDING))
    n = F.size(F.coalesce("dividers", F.array().cast("array<double>")))
    front = (F.col("page_no") == title_page) & (n >= 2) & (F.col("block") == n - 1) & (F.col("last_block") == n)
    region = F.when(F.coalesce(F.col("parent_ref").contains("pictures"), F.lit(False)), "figure").when(inside, "sidebar").when(front, "front_matter").otherwise("body")
    return rows.withColumn("region", region)


def decorative(pictures: DataFrame) -> DataFrame:
    """Pictures that are none: flat ones, and those at one place of three pages or more."""
    spot = [F.bround(F.col(c) / 5).cast("long").alias(c) for c in ("l", "t", "r", "b")]
    often = pictures.select("document_id", "page_no", *spot).groupBy("document_id", "l", "t", "r", "b").agg(F.countDistinct("page_no").alias("n")).where(F.col("n") >= PICTURE_PAGES)
    keyed = pictures.select("*", F.struct("document_id", *spot).alias("_k"))
    hit = keyed.join(often.select(F.struct("document_id", "l", "t", "r", "b").alias("_k")), "_k", "left_semi")
    return pictures.where(F.col("t") - F.col("b") < PICTURE_HEIGHT).unionByName(hit.drop("_k")).distinct()


def cells_in(items: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells of which more than four fifths lie in an item: an equi-join by page with a test of areas."""
    c = cells.select("document_id", "page_no", *[F.col(x).alias(f"c_{x}") for x in ("text", "l", "t", "r", "b")])
    rows = items.join(c, ["document_id", "page_no"])
    w = F.least("r", "c_r") - F.greatest("l", "c_l")
    h = F.least("t", "c_t") - F.greatest("b", "c_b")
    area = (F.col("c_r") - F.col("c_l")) * (F.col("c_t") - F.col("c_b"))
    return rows.where((w > 0) & (h > 0) & (w * h > CELL_SHARE * area))


def rows_of_text(cells: DataFrame) -> DataFrame:
    """Printed rows of each item: a new one where centres are more than two points apart."""
    middle = (F.col("c_t") + F.col("c_b")) / 2
    order = Window.partitionBy("document_id", "ord").orderBy(middle)
    return cells.withColumn("_new", F.when(F.coalesce(middle - F.lag(middle).over(order) > ROW_GAP, F.lit(True)), 1).otherwise(0)).groupBy("document_id", "ord").agg(F.sum("_new").alias("rows"))


def line_heights(items: DataFrame, cells: DataFrame) -> DataFrame:
    """``document_id, ord, line_heights`` (to a tenth) of the items that have lines; ``cells`` are lines.

    Lines count whose text stands in the item.  Fonts whose boxes are far too flat, less than half the pitch of the printed
    rows, get the pitch.
    """
    inside = cells_in(items, cells)
    rows = rows_of_text(inside)
    height = F.col("c_t") - F.col("c_b")
    found = inside.where(F.col("text").contains(F.col("c_text"))).groupBy("document_id", "ord").agg(F.array_sort(F.collect_list(F.struct((-F.col("c_t")).alias("o"), "c_l", height.alias("h")))).alias("x"), F.max(F.abs(F.col("t") - F.col("b"))).alias("high"))
    h, pitch = F.transform("x", lambda x: x["h"]), F.col("high") / F.col("rows")
    fixed = F.when(F.array_max(h) < 0.5 * pitch, F.transform(h, lambda _: pitch)).otherwise(h)
    return found.join(rows, ["document_id", "ord"]).select("document_id", "ord", F.transform(fixed, lambda x: F.round(x, 1)).alias("line_heights"))


def font_key(cells: DataFrame) -> DataFrame:
    """Most frequent font of each item, of equal ones the first met; cells have ``document_id, ord, cell_no, font_key``."""
    counted = cells.where("font_key is not null").groupBy("document_id", "ord", "font_key").agg(F.count("*").alias("n"), F.min("cell_no").alias("first"))
    return counted.groupBy("document_id", "ord").agg(F.max(F.struct("n", -F.col("first"), "font_key")).alias("m")).select("document_id", "ord", F.col("m.font_key").alias("font_key"))
