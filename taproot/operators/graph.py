"""Document graphs as tables: nodes and edges, relations, roots and connectivity.

Nodes have ``document_id, node_id, text, seq, level, level_label, kind, grouped, page_no``; edges have ``document_id,
parent_id, child_id, weight, relation``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproot.functions.text import strip
from taproot.operators.current import current_rows
from taproot.operators.hierarchy import hierarchy
from taproot.plans.lineage import cut, stored

# Relations of the structure with their weights, and labels of nodes that head a section.
STRUCTURAL_WEIGHTS = {"section": 1.0, "text": 0.8, "list_item": 0.6, "media": 0.9, "unreferenced_media": 0.3, "reference": 0.7, "root": 0.1}
HEADINGS = ("Title", "Heading", "Root")

# How much a parent supplies by the relation of the edge.
SUPPLY_PRIORS = {
    "reference": 1.0, "unreferenced_media": 1.0, "heading_list": 0.8, "section": 0.75, "text_list": 0.67,
    "media_table": 0.6, "root": 0.6, "heading_text": 0.5, "media_figure": 0.5, "text_text": 0.4,
}

_REACHED = ["document_id", "node_id", "ancestor_id", "distance"]
#: Pairs that one output batch may hold, and edges that a task walks.
_BATCH, _EDGES_A_TASK = 100_000, 20_000


def lookup(key: Column, values: dict[str, float], default: float) -> Column:
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def nodes(snippets: DataFrame) -> DataFrame:
    """Nodes of snippets that may be delivered more than once; NUL characters are taken out and texts stripped."""
    rows = current_rows(snippets, ["document_id", "snippet_id"], ["extracted_at"], ["text", "sequence_no", "level", "level_label", "label", "snippet_type", "page_no"])
    return rows.select(
        "document_id", F.col("snippet_id").alias("node_id"), strip(F.translate(F.coalesce("text", F.lit("")), "\x00", "")).alias("text"),
        F.col("sequence_no").alias("seq"), "level", "level_label", F.col("snippet_type").alias("kind"), (F.col("label") == "list_item").alias("grouped"), "page_no",
    )


def edges(rows: DataFrame) -> DataFrame:
    """Distinct edges; repeated ones keep the greatest weight, one without a weight gets that of its relation."""
    return rows.groupBy("document_id", "parent_id", "child_id").agg(F.max("weight").alias("w"), F.max("relation").alias("relation")).select(
        "document_id", "parent_id", "child_id", F.coalesce("w", lookup(F.col("relation"), STRUCTURAL_WEIGHTS, STRUCTURAL_WEIGHTS["text"])).alias("weight"), "relation"
    )


def is_heading(level_label: Column) -> Column:
    return F.coalesce(level_label.isin(*HEADINGS), F.lit(False))


def contexts(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Edges with both ends: columns of the parent with p_, of the child with c_.  Edges without an end are left out."""
    def side(prefix: str, key: str) -> DataFrame:
        return node_rows.select("document_id", F.col("node_id").alias(key), *[F.col(c).alias(prefix + c) for c in node_rows.columns if c not in ("document_id", "node_id")])

    return edge_rows.join(side("p_", "parent_id"), ["document_id", "parent_id"]).join(side("c_", "child_id"), ["document_id", "child_id"])


def edge_relation(p_label: Column, c_label: Column, c_kind: Column, c_grouped: Column, unreferenced: Column) -> Column:
    """Relation of an edge as the structure gives it."""
    return (
        F.when(c_kind.isin("image", "table"), F.when(unreferenced, "unreferenced_media").otherwise("media"))
        .when(c_grouped, "list_item").when(is_heading(p_label) & is_heading(c_label), "section").otherwise("text")
    )


def supply_relation(context: DataFrame) -> Column:
    """Finer relation of an edge of :func:`contexts`, on which supply is measured."""
    p, c = is_heading(context["p_level_label"]), is_heading(context["c_level_label"])
    return (
        F.when(context["relation"].isin("reference", "unreferenced_media", "root"), context["relation"])
        .when(context["c_kind"] == "table", "media_table").when(context["c_kind"] == "image", "media_figure")
        .when(p & c, "section").when(context["c_grouped"] & p, "heading_list").when(context["c_grouped"], "text_list")
        .when(p, "heading_text").otherwise("text_text")
    )


def best_parents(edge_rows: DataFrame) -> DataFrame:
    """One parent for each child: the strongest edge, of equal ones the greatest parent id."""
    return edge_rows.groupBy("document_id", "child_id").agg(F.max(F.struct("weight", "parent_id")).alias("b")).select("document_id", F.col("child_id").alias("node_id"), F.col("b.parent_id"), F.col("b.weight"))


def root_ids(node_rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Root of each document: the first node that reads like its title, else the first Title, else a synthetic one."""
    named = titles.select("document_id", F.lower(strip(F.col("title"))).alias("title")).groupBy("document_id").agg(F.max("title").alias("title"))
    rows = node_rows.join(named, "document_id", "left")
    key = F.struct("seq", "node_id")
    found = rows.groupBy("document_id").agg(F.min(F.when(F.lower(strip(F.col("text"))) == F.col("title"), key)).alias("a"), F.min(F.when(F.col("level_label") == "Title", key)).alias("b"))
    return found.select("document_id", F.coalesce("a.node_id", "b.node_id", F.lit("#/document-root")).alias("root_id"))


def connect(node_rows: DataFrame, edge_rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges that tie every component without the root to it, at its node of least (level, seq)."""
    parents = node_rows.select("document_id", "node_id").join(best_parents(edge_rows), ["document_id", "node_id"], "left")
    tree = hierarchy(parents, "document_id", "node_id", "parent_id", paths=False)
    part = tree.select(F.col("group").alias("document_id"), F.col("node").alias("node_id"), F.coalesce("root", "cycle").alias("part"))
    rows = part.join(node_rows.select("document_id", "node_id", "level", "seq"), ["document_id", "node_id"])
    heads = rows.groupBy("document_id", "part").agg(F.min(F.struct("level", "seq", "node_id")).alias("head"), F.collect_set(F.when(F.col("node_id") == F.col("part"), F.col("node_id"))).alias("_"))
    own = rows.join(roots, "document_id").where("node_id = root_id").select("document_id", F.col("part"))
    loose = heads.join(own, ["document_id", "part"], "left_anti").join(roots, "document_id")
    return loose.select("document_id", F.col("root_id").alias("parent_id"), F.col("head.node_id").alias("child_id"), F.lit(STRUCTURAL_WEIGHTS["root"]).alias("weight"), F.lit("root").alias("relation")).where("parent_id <> child_id")


def _climbed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the nodes of each document reach; rows ``document_id, node_id, ancestor_id`` come by document."""
    at, above, out = None, {}, []

    def walks() -> Iterator[tuple]:
        for node, near in above.items():
            seen, line, distance = {node}, near, 1
            while line:
                line = [x for x in dict.fromkeys(line) if x not in seen]
                seen.update(line)
                yield from ((at, node, x, distance) for x in line)
                # Documents without an id aren't one document.
                line, distance = [y for x in line for y in above.get(x, ())] if at is not None else [], distance + 1

    for batch in chain(batches, [None]):
        for document, node, up in zip(*(batch[c] for c in batch.columns)) if batch is not None else [(object(), None, None)]:
            if document != at:
                for row in walks():
                    out.append(row)
                    if len(out) == _BATCH:
                        yield pd.DataFrame(out, columns=_REACHED)
                        out = []
                at, above = document, {}
            above.setdefault(node, []).append(up)
    yield pd.DataFrame(out, columns=_REACHED)


def ancestors_of(edge_rows: DataFrame, local_limit: int = 50_000) -> DataFrame:
    """``document_id, node_id, ancestor_id, distance``: every node reachable upwards over edges of any kind, by the shortest way.

    References may give a node several parents and may close circles; a node is never its own ancestor.  Documents of at most
    ``local_limit`` edges are walked in memory, many to a task.  In larger ones each round goes one edge up from what the last
    one found, so there are as many rounds as the longest of the shortest ways.
    """
    up = stored(edge_rows.where("parent_id <> child_id").select("document_id", F.col("child_id").alias("node_id"), F.col("parent_id").alias("ancestor_id")).distinct())
    large = cut(up.groupBy("document_id").agg(F.count("*").alias("n")).where(F.col("n") > local_limit).select("document_id"))
    n_large = large.count()
    small = up if not n_large else up.join(large, "document_id", "left_anti")
    parts = max(1, math.ceil(up.count() / _EDGES_A_TASK))
    out = stored(small.repartition(parts, "document_id").sortWithinPartitions("document_id").mapInPandas(_climbed, "document_id string, node_id string, ancestor_id string, distance int"))
    return out if not n_large else out.unionByName(_by_rounds(stored(up.join(large, "document_id", "left_semi"))))


def _by_rounds(up: DataFrame) -> DataFrame:
    step = up.select("document_id", F.col("node_id").alias("ancestor_id"), F.col("ancestor_id").alias("next"))
    found = last = stored(up.withColumn("distance", F.lit(1)))
    while True:
        far = last.join(step, ["document_id", "ancestor_id"]).where("next <> node_id").groupBy("document_id", "node_id", F.col("next").alias("ancestor_id")).agg((F.max("distance") + 1).alias("distance"))
        last = stored(far.join(found.drop("distance"), ["document_id", "node_id", "ancestor_id"], "left_anti"))
        if not last.limit(1).count():
            return found
        found = found.unionByName(last)


def from_texts(texts: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Nodes from bare texts (``document_id, node_id, text``), for measures that need nothing else; ends of edges that have no
    text get an empty one."""
    ends = edge_rows.select("document_id", F.explode(F.array("parent_id", "child_id")).alias("node_id")).distinct().join(texts, ["document_id", "node_id"], "left_anti").withColumn("text", F.lit(""))
    rows = texts.select("document_id", "node_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(ends)
    blank = {"seq": F.lit(0), "level": F.lit(0), "level_label": F.lit("Body"), "kind": F.lit("text"), "grouped": F.lit(False), "page_no": F.lit(0)}
    return rows.withColumns(blank)


def relation_of(edge_rows: DataFrame, document_id: str, parent_id: str, child_id: str) -> str | None:
    """Relation of one edge, None if there is no such edge."""
    row = edge_rows.where((F.col("document_id") == document_id) & (F.col("parent_id") == parent_id) & (F.col("child_id") == child_id)).select("relation").first()
    return row and row.relation


def page_of(pages: DataFrame, document_id: str, page_no: int) -> tuple[float, float] | None:
    """Width and height of one page, None if it isn't known."""
    row = pages.where((F.col("document_id") == document_id) & (F.col("page_no") == page_no)).select("width", "height").first()
    return row and (row.width, row.height)
