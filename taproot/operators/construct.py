"""Document graphs from parsed items: parents, captions, mentions, media, edges and the whole pipeline.

Texts have ``document_id, node_id, seq, text, level, level_label, region, grouped, parent_ref, page_no`` and, for media, a
box ``l, t, r, b`` from the bottom left with its ``block`` and ``column``.  Media have ``document_id, node_id, kind`` (image
or table), ``seq, page_no``, the same box, block and column, and ``content`` (what a table holds, else null).
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.functions.text import n_chars, n_words, strip, token_count
from taproot.operators import graph
from taproot.plans.grouping import by_document
from taproot.plans.lineage import stored

#: Places of a document that are walked in one go.
BLOCK = 20_000
ASIDES = ("sidebar", "figure")
ROOT = "#/document-root"

# What a caption begins with, how far it may lie from its medium (points, above or below and beside), and
# the words that name media in captions, in the order in which they are tried.
CAPTION = r"^[\s▶▪●•·‣→>»|–—-]*(Tab|Abb|Table|Figure|Fig)\.?\s*\d+"
CAPTION_DISTANCE, CAPTION_SIDE = 50.0, 12.0
CAPTION_RULES = ("Figure", "Fig.", "Table", "Abbildung", "Tabelle", "Abb.", "Tab.", "Abb", "Tab", "Abb .", "Tab .", "Abb ", "Tab ")
# What joins the labels of a figure, and the tokens that a label has at most.
LABEL_GAP, LABEL_TOKENS = " · ", 8

_NAMED = r"(?iU)\b(figure|fig|table|abbildung|tabelle|abb|tab)\s*\.?\s*(\d+)"


def is_caption(text: Column) -> Column:
    return text.rlike(f"(?iU){CAPTION}")


# --- parents of texts ---------------------------------------------------------


def parents(texts: DataFrame) -> DataFrame:
    """``document_id, node_id, parent_id`` of each text, by the rules in turn.

    Without the columns region, grouped or parent_ref all texts are of the body, ungrouped and without a given parent.

    A grouped text hangs from what introduces its group: the nearest text before the first of its group (same parent_ref
    and region) that may hold it.  An ungrouped one with a parent_ref other than #/body hangs from that.  The others, and
    groups that open their region, hang from the nearest text before them that has a lower level and may hold them; else
    from the first text of level 0 but themselves.  A text may hold those of its own region, one of the body also those of
    sidebars and figures.  A null level is deeper than all others.

    A document is walked in blocks of ``BLOCK`` places, side by side.  A block leaves the stack of rising levels of each region
    and the last text of each; what all blocks before it left is put together first, which is as small as the levels in use.
    So no pairs are made and no document is one task.  An empty table gives an empty table.
    """
    for name, value in (("region", "body"), ("grouped", False), ("parent_ref", "#/body")):
        if name not in texts.columns:
            texts = texts.withColumn(name, F.lit(value))
    key = F.struct("seq", "node_id")
    tops = texts.where("level = 0").groupBy("document_id").agg(F.min(key).alias("top"))
    others = texts.where("level = 0").select("document_id", key.alias("k")).join(tops, "document_id").where(F.col("k") > F.col("top"))
    tops = tops.join(others.groupBy("document_id").agg(F.min("k").alias("next")), "document_id", "left").select("document_id", F.col("top.node_id").alias("top"), F.col("next.node_id").alias("next"))
    rows = stored(texts.select(
        "document_id", "node_id", F.coalesce("seq", F.lit(-1)).cast("long").alias("seq"), F.coalesce(F.col("level").cast("double"), F.lit(math.inf)).alias("level"),
        F.coalesce("region", F.lit("body")).alias("region"), F.coalesce("grouped", F.lit(False)).alias("grouped"), F.coalesce("parent_ref", F.lit("#/body")).alias("ref"),
    ).withColumn("block", F.floor(F.col("seq") / BLOCK)))
    by_block = ["document_id", "block"]
    left = rows.select(*by_block, "seq", "node_id", "level", "region").repartition(*by_block).sortWithinPartitions(*by_block, "seq", "node_id").mapInPandas(_summaries, f"document_id string, block long, {_STATE}")
    start = by_document(left, _incoming, f"document_id string, block long, {_STATE}")
    blank = {c: F.lit(None).cast(kind) for c, kind in dict(start.dtypes).items() if c in ("stack", "last")}
    fed = rows.withColumns(blank).withColumn("fed", F.lit(1)).unionByName(start.withColumn("fed", F.lit(0)), allowMissingColumns=True)
    walked = fed.repartition(*by_block).sortWithinPartitions(*by_block, "fed", "seq", "node_id").mapInPandas(_walk, "document_id string, node_id string, seq long, region string, grouped boolean, ref string, near string, before string")
    walked = stored(walked)
    opened = walked.where("grouped").groupBy("document_id", "ref", "region").agg(F.min(F.struct("seq", "node_id", "before"))["before"].alias("intro")).where("intro is not null")
    found = walked.where("grouped").join(opened, ["document_id", "ref", "region"], "left").unionByName(walked.where("not grouped").withColumn("intro", F.lit(None).cast("string")))
    given = F.when(F.col("grouped"), F.col("intro")).when(F.col("ref") != "#/body", F.col("ref"))
    first = F.when(F.col("top") != F.col("node_id"), F.col("top")).otherwise(F.col("next"))
    return found.join(tops, "document_id", "left").select("document_id", "node_id", F.coalesce(given, "near", first).alias("parent_id"))


_STATE = "stack array<struct<region:string,level:double,seq:long,node:string>>, last array<struct<region:string,level:double,seq:long,node:string>>"
Entry = tuple[float, int, str]


def _push(stack: list[Entry], entry: Entry) -> None:
    """Put an entry on a stack of rising levels."""
    del stack[bisect_left(stack, entry[0], key=lambda x: x[0]) :]
    stack.append(entry)


def _flat(of: dict[str, list[Entry]]) -> list[dict]:
    return [{"region": region, "level": e[0], "seq": e[1], "node": e[2]} for region, own in of.items() for e in own]


def _deep(rows: Any) -> dict[str, list[Entry]]:
    out: dict[str, list[Entry]] = {}
    for x in rows:
        out.setdefault(x["region"], []).append((x["level"], x["seq"], x["node"]))
    return out


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each block leaves: its stacks and last texts by region."""
    at, stacks, last = None, {}, {}
    columns = ["document_id", "block", "stack", "last"]
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if (r.document_id, r.block) != at:
                if at:
                    out.append((*at, _flat(stacks), _flat(last)))
                at, stacks, last = (r.document_id, r.block), {}, {}
            entry = (r.level, r.seq, r.node_id)
            _push(stacks.setdefault(r.region, []), entry)
            last[r.region] = [entry]
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame([(*at, _flat(stacks), _flat(last))] if at else [], columns=columns)


def _incoming(document: str, blocks: list[Any]) -> list[tuple]:
    """What lies before each block of a document but the first."""
    stacks: dict[str, list[Entry]] = {}
    last: dict[str, list[Entry]] = {}
    out = []
    for r in sorted(blocks, key=lambda x: x.block):
        if stacks:
            out.append((document, r.block, _flat(stacks), _flat(last)))
        for region, own in _deep(r.stack).items():
            for entry in own:
                _push(stacks.setdefault(region, []), entry)
        last |= _deep(r.last)
    return out


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each text the nearest one before it of a lower level, and the nearest at all, of those that may hold it."""
    at, stacks, last = None, {}, {}
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if (r.document_id, r.block) != at:
                at, stacks, last = (r.document_id, r.block), {}, {}
            if not r.fed:
                stacks, last = _deep(r.stack), _deep(r.last)
                continue
            homes = (r.region, "body") if r.region in ASIDES else (r.region,)
            lower = [own[i - 1] for h in homes if (own := stacks.get(h)) and (i := bisect_left(own, r.level, key=lambda x: x[0]))]
            near = max(lower, key=lambda x: x[1:])[2] if lower else None
            before = max((last[h][0] for h in homes if h in last), key=lambda x: x[1:], default=(0, 0, None))[2]
            out.append((r.document_id, r.node_id, r.seq, r.region, r.grouped, r.ref, near, before))
            entry = (r.level, r.seq, r.node_id)
            _push(stacks.setdefault(r.region, []), entry)
            last[r.region] = [entry]
        yield pd.DataFrame(out, columns=["document_id", "node_id", "seq", "region", "grouped", "ref", "near", "before"])


# --- media --------------------------------------------------------------------


def captions(media: DataFrame, texts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``document_id, media_id, node_id, at, text``: the captions of each medium.

    Linked ones (``links``: document_id, media_id, node_id, at) come first.  A medium without any takes the caption-like
    text of its page that is nearest: above or below it within reach, or close beside it; of equally near ones the first.
    """
    named = texts.select("document_id", "node_id", "text", "seq")
    own = texts.limit(0).select("document_id", F.lit("").alias("media_id"), "node_id", F.lit(0).alias("at"), "text")
    if links is not None:
        own = links.join(named.drop("seq"), ["document_id", "node_id"]).select("document_id", "media_id", "node_id", F.col("at").cast("int").alias("at"), "text")
    bare = media.select("document_id", F.col("node_id").alias("media_id"), "page_no", "l", "t", "r", "b")
    if links is not None:
        bare = bare.join(own.select("document_id", "media_id").distinct(), ["document_id", "media_id"], "left_anti")
    like = texts.where(is_caption(F.col("text"))).select("document_id", "page_no", "node_id", "seq", "text", *[F.col(c).alias(f"c_{c}") for c in "ltrb"])
    across = F.greatest(F.col("l") - F.col("c_r"), F.col("c_l") - F.col("r"), F.lit(0.0))
    down = F.greatest(F.col("b") - F.col("c_t"), F.col("c_b") - F.col("t"), F.lit(0.0))
    near = bare.join(like, ["document_id", "page_no"]).where(((across == 0) & (down <= CAPTION_DISTANCE)) | ((down == 0) & (across <= CAPTION_SIDE)))
    found = near.groupBy("document_id", "media_id").agg(F.min(F.struct((across + down).alias("gap"), "seq", "node_id", "text")).alias("c"))
    return own.unionByName(found.select("document_id", "media_id", "c.node_id", F.lit(0).alias("at"), "c.text"))


def named_media(text: Column) -> Column:
    """Which media a text names: array of ``base`` (small letters) and ``number`` (digits as printed)."""
    words = F.regexp_extract_all(text, F.lit(_NAMED), F.lit(1))
    numbers = F.regexp_extract_all(text, F.lit(_NAMED), F.lit(2))
    return F.array_distinct(F.zip_with(words, numbers, lambda w, n: F.struct(F.lower(w).alias("base"), n.alias("number"))))


def mentions(media_captions: DataFrame, texts: DataFrame) -> DataFrame:
    """``document_id, media_id, node_id, rule``: the texts that name a medium as its caption does.

    Rules are tried in order; each that stands in the caption, with a number after it, is a name to look for.  All names of
    all texts are found in one pass and joined; captions of the medium itself don't count.
    """
    whole = media_captions.groupBy("document_id", "media_id").agg(F.array_sort(F.collect_list(F.struct("at", "node_id", "text"))).alias("c"))
    whole = whole.select("document_id", "media_id", F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("caption"), F.transform("c", lambda x: x["node_id"]).alias("own"))
    tried = []
    for i, rule in enumerate(CAPTION_RULES):
        base = rule.strip().rstrip(".").strip()
        number = F.regexp_extract("caption", rf"(?iU)\b{base}\s*\.?\s*(\d+)", 1)
        tried.append(F.when(F.col("caption").contains(rule) & (number != ""), F.struct(F.lit(i).alias("rule"), F.lit(base.lower()).alias("base"), number.alias("number"))))
    names = whole.select("document_id", "media_id", "own", F.explode(F.filter(F.array(*tried), lambda x: x.isNotNull())).alias("n")).select("document_id", "media_id", "own", "n.*")
    said = texts.select("document_id", "node_id", F.explode(named_media(F.col("text"))).alias("n")).select("document_id", "node_id", "n.*")
    return names.join(said, ["document_id", "base", "number"]).where(~F.array_contains("own", F.col("node_id"))).select("document_id", "media_id", "node_id", "rule")


def reading_key(page_no: Column, block: Column, column: Column, top: Column) -> Column:
    return F.struct(page_no.alias("p"), block.alias("k"), column.alias("c"), (-top).alias("t"))


def place_media(media: DataFrame, texts: DataFrame, media_captions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Media with ``parent_id, level, level_label``, and the references to them (``document_id, media_id, node_id``).

    The first rule whose first mention has a parent decides: the medium gets that parent and the mention's level, and all
    mentions by that rule are references.  Others hang one level below the nearest heading before them in reading order,
    asides aside; they are Unreferenced Image.  Where there is no such heading parent and level stay open (level 1000).
    """
    place = texts.select("document_id", "node_id", "seq", "level", "level_label", "parent_id")
    found = mentions(media_captions, texts).join(place, ["document_id", "node_id"])
    first = found.groupBy("document_id", "media_id", "rule").agg(F.min(F.struct("seq", "node_id", "level", "level_label", "parent_id")).alias("f"))
    chosen = first.where(F.col("f.parent_id").isNotNull()).groupBy("document_id", "media_id").agg(F.min(F.struct("rule", "f")).alias("x"))
    chosen = chosen.select("document_id", "media_id", "x.rule", F.col("x.f.parent_id").alias("m_parent"), F.col("x.f.level").alias("m_level"), F.col("x.f.level_label").alias("m_label"))
    references = found.join(chosen.select("document_id", "media_id", "rule"), ["document_id", "media_id", "rule"]).select("document_id", "media_id", "node_id").distinct()
    key = reading_key(F.col("page_no"), F.col("block"), F.col("column"), F.col("t"))
    heads = texts.where(graph.is_heading(F.col("level_label")) & ~F.coalesce(F.col("region").isin(*ASIDES), F.lit(False))).select(
        "document_id", key.alias("k"), F.lit(1).alias("kind"), F.struct("node_id", "level").alias("head"), F.lit(None).cast("string").alias("media_id")
    )
    rows = media.select("document_id", key.alias("k"), F.lit(0).alias("kind"), F.lit(None).cast(heads.schema["head"].dataType).alias("head"), F.col("node_id").alias("media_id"))
    # Of equal places the heading comes later, so that only headings truly before a medium count.
    before = Window.partitionBy("document_id").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = heads.unionByName(rows).withColumn("near", F.last("head", True).over(before)).where("media_id is not null").select("document_id", "media_id", "near")
    out = media.withColumnRenamed("node_id", "media_id").join(chosen, ["document_id", "media_id"], "left").join(near, ["document_id", "media_id"], "left")
    named = F.col("rule").isNotNull()
    placed = {
        "parent_id": F.when(named, F.col("m_parent")).otherwise(F.col("near.node_id")),
        "level": F.when(named, F.col("m_level")).otherwise(F.coalesce(F.col("near.level") + 1, F.lit(1000))).cast("int"),
        "level_label": F.when(named, F.col("m_label")).when(F.col("near").isNotNull(), "Unreferenced Image").otherwise(""),
    }
    return out.withColumns(placed).drop("rule", "m_parent", "m_level", "m_label", "near").withColumnRenamed("media_id", "node_id"), references


def absorb(media: DataFrame, texts: DataFrame, media_captions: DataFrame, most: int = LABEL_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Media with their ``text`` (captions, content, labels printed inside), and the texts that stay nodes.

    A text of a figure that hangs from a medium is part of its text, unless it is a caption; it stops being a node if it
    has at most ``most`` tokens and nothing hangs from it.
    """
    taken = media_captions.select("document_id", "node_id").distinct()
    owners = media.select("document_id", F.col("node_id").alias("parent_id"))
    inside = texts.where("region = 'figure'").join(owners, ["document_id", "parent_id"], "left_semi").join(taken, ["document_id", "node_id"], "left_anti")
    bare = strip(F.col("text"))
    labels = inside.where(bare != "").groupBy("document_id", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "node_id", bare.alias("x")))).alias("c"))
    labels = labels.select("document_id", "node_id", F.array_join(F.transform("c", lambda x: x["x"]), LABEL_GAP).alias("labels"))
    holding = texts.select("document_id", F.col("parent_id").alias("node_id")).where("node_id is not null").distinct()
    gone = inside.where(token_count(n_words(F.col("text")), n_chars(F.col("text"))) <= most).join(holding, ["document_id", "node_id"], "left_anti").select("document_id", "node_id")
    named = media_captions.groupBy("document_id", F.col("media_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("c"))
    named = named.select("document_id", "node_id", F.array_join(F.transform("c", lambda x: x["text"]), " ").alias("caption"))
    out = media.join(named, ["document_id", "node_id"], "left").join(labels, ["document_id", "node_id"], "left")
    parts = F.filter(F.array(*[F.coalesce(c, F.lit("")) for c in ("caption", "content", "labels")]), lambda x: x != "")
    return out.withColumn("text", strip(F.array_join(parts, "\n"))).drop("labels"), texts.join(gone, ["document_id", "node_id"], "left_anti")


# --- edges and the whole ------------------------------------------------------


def edges(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """One edge to each node but the root, with its relation and structural weight.

    A node whose parent is missing, unknown or itself hangs from the root.
    """
    p = nodes.select("document_id", F.col("node_id").alias("parent_id"), F.col("level_label").alias("p_label"))
    rows = nodes.join(roots, "document_id").where("node_id <> root_id").join(p, ["document_id", "parent_id"], "left")
    known = F.col("p_label").isNotNull() & (F.col("parent_id") != F.col("node_id"))
    relation = graph.edge_relation(F.col("p_label"), F.col("level_label"), F.col("kind"), F.col("grouped"), F.col("level_label") == "Unreferenced Image")
    relation = F.when(known, relation).otherwise("root")
    return rows.select(
        "document_id", F.when(known, F.col("parent_id")).otherwise(F.col("root_id")).alias("parent_id"), F.col("node_id").alias("child_id"),
        graph.lookup(relation, graph.STRUCTURAL_WEIGHTS, graph.STRUCTURAL_WEIGHTS["text"]).alias("weight"), relation.alias("relation"),
    )


def reference_edges(references: DataFrame) -> DataFrame:
    return references.select("document_id", F.col("node_id").alias("parent_id"), F.col("media_id").alias("child_id"), F.lit(graph.STRUCTURAL_WEIGHTS["reference"]).alias("weight"), F.lit("reference").alias("relation"))


def build(texts: DataFrame, media: DataFrame, titles: DataFrame, links: DataFrame | None = None) -> dict[str, DataFrame]:
    """The graph of every document: ``nodes``, ``edges`` (the tree), ``references`` and ``roots``.

    ``titles`` have ``document_id, title``.  Every node of a document reaches its root; a document without a title node gets
    a synthetic root.  Texts lose NUL characters.
    """
    texts = stored(texts)
    texts = stored(texts.join(parents(texts), ["document_id", "node_id"]).withColumn("text", F.translate(F.coalesce("text", F.lit("")), "\x00", "")))
    media = stored(media)
    found = stored(captions(media, texts, links))
    placed, references = place_media(media, texts, found)
    placed, texts = absorb(stored(placed), texts, found)
    columns = ["document_id", "node_id", "parent_id", "text", "seq", "level", "level_label", "kind", "grouped", "page_no"]
    nodes = texts.withColumn("kind", F.lit("text")).select(*columns).unionByName(placed.withColumn("grouped", F.lit(False)).select(*columns))
    roots = stored(graph.root_ids(texts, titles))
    top = roots.where(F.col("root_id") == ROOT).join(titles.groupBy("document_id").agg(F.max("title").alias("title")), "document_id", "left")
    made = top.select(
        "document_id", F.col("root_id").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.coalesce("title", F.lit("")).alias("text"), F.lit(-1).alias("seq"), F.lit(-1).alias("level"),
        F.lit("Root").alias("level_label"), F.lit("root").alias("kind"), F.lit(False).alias("grouped"), F.lit(0).alias("page_no"),
    )
    nodes = stored(nodes.unionByName(made))
    tree = stored(edges(nodes, roots))
    return {"nodes": nodes, "edges": tree.unionByName(graph.connect(nodes, tree, roots)), "references": reference_edges(references), "roots": roots}
