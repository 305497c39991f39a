"""Graphs in and out: one JSON object a document, GEXF, and rows for a property graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.functions.ids import snippet_id as graph_id

#: Version of the JSON form; older ones lack pages or relations and load with defaults.
SCHEMA_VERSION = 4
GRAPH_JSON = """document_id string, schema_version int, filename string, title string, root_id string,
  snippets array<struct<node_id:string,text:string,seq:int,level:int,level_label:string,kind:string,grouped:boolean,page_no:int>>,
  edges array<struct<parent_id:string,child_id:string,weight:double,relation:string>>,
  pages array<struct<page_no:int,width:double,height:double>>"""


def read_graphs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables ``nodes``, ``edges`` and ``pages`` of graphs saved as JSON, one object a line."""
    rows = spark.read.schema(GRAPH_JSON).json(path)
    return {
        "nodes": rows.select("document_id", F.inline("snippets")), "edges": rows.select("document_id", F.inline("edges")),
        "pages": rows.select("document_id", F.inline_outer("pages")).where("page_no is not null"),
    }


def require_relations(edge_rows: DataFrame) -> DataFrame:
    """Edges, if they say how they came about; weights can't be worked out anew without."""
    if edge_rows.where("relation is null").limit(1).count():
        raise ValueError("the graph has edges without a relation")
    return edge_rows


def write_graphs(meta: DataFrame, node_rows: DataFrame, edge_rows: DataFrame, pages: DataFrame, path: str) -> None:
    """One JSON object a document (``meta``: document_id, filename, title, root_id), as :func:`read_graphs` takes it."""
    n = node_rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id", "text", "level", "level_label", "kind", "grouped", "page_no"))).alias("snippets"))
    e = edge_rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("parent_id", "child_id", "weight", "relation"))).alias("edges"))
    p = pages.groupBy("document_id").agg(F.array_sort(F.collect_set(F.struct("page_no", "width", "height"))).alias("pages"))
    meta.withColumn("schema_version", F.lit(SCHEMA_VERSION)).join(n, "document_id", "left").join(e, "document_id", "left").join(p, "document_id", "left").write.mode("overwrite").json(path)


def gexf(node_rows: DataFrame, edge_rows: DataFrame, roots: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """``document_id, no, line``: each document's graph as GEXF in lines, in order of ``no``; no document is gathered.

    Nodes carry label, level and kind.  A synthetic root (one of ``roots`` that is no node) reads like its document's title.
    Of two edges between the same nodes that of the tree counts.
    """
    columns = ["document_id", "node_id", "text", "seq", "level", "level_label", "kind"]
    nodes = node_rows.select(*columns)
    if roots is not None:
        loose = roots.join(nodes.select("document_id", F.col("node_id").alias("root_id")), ["document_id", "root_id"], "left_anti")
        loose = loose.withColumn("title", F.lit("")) if titles is None else loose.join(titles.groupBy("document_id").agg(F.max("title").alias("title")), "document_id", "left")
        nodes = nodes.unionByName(loose.select("document_id", F.col("root_id").alias("node_id"), F.coalesce("title", F.lit("")).alias("text"), F.lit(-1).alias("seq"), F.lit(-1).alias("level"), F.lit("Root").alias("level_label"), F.lit("root").alias("kind")))

    def quoted(c: Column) -> Column:
        s = F.coalesce(c.cast("string"), F.lit(""))
        for x, y in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
            s = F.replace(s, F.lit(x), F.lit(y))
        return F.concat(F.lit('"'), F.regexp_replace(s, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), F.lit('"'))

    attributes = F.concat(*[F.concat(F.lit(f'<attvalue for="{i}" value='), quoted(F.col(c)), F.lit("/>")) for i, c in enumerate(("level_label", "level", "kind"))])
    node = F.concat(F.lit("<node id="), quoted(F.col("node_id")), F.lit(" label="), quoted(F.col("text")), F.lit("><attvalues>"), attributes, F.lit("</attvalues></node>"))
    best = F.max(F.struct((F.col("relation") != "reference").alias("tree"), "weight")).alias("b")
    links = edge_rows.withColumn("relation", F.coalesce("relation", F.lit("text"))).groupBy("document_id", "parent_id", "child_id").agg(best)
    kind = F.when(F.col("b.tree"), "hierarchy").otherwise("reference")
    edge = F.concat(
        F.lit("<edge id="), quoted(F.concat_ws(">", "parent_id", "child_id")), F.lit(" source="), quoted(F.col("parent_id")), F.lit(" target="), quoted(F.col("child_id")), F.lit(" weight="), quoted(F.col("b.weight")),
        F.lit("><attvalues><attvalue for=\"0\" value="), quoted(kind), F.lit("/></attvalues></edge>"),
    )
    head = '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed"><attributes class="node"><attribute id="0" title="level_label" type="string"/><attribute id="1" title="level" type="integer"/><attribute id="2" title="kind" type="string"/></attributes><attributes class="edge"><attribute id="0" title="edge_type" type="string"/></attributes><nodes>'
    frame = nodes.select("document_id").distinct().select("document_id", F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.lit(line).alias("line")) for k, line in ((0, head), (2, "</nodes><edges>"), (4, "</edges></graph></gexf>"))])).alias("f")).select("document_id", "f.part", F.lit("").alias("o"), "f.line")
    rows = frame.unionByName(nodes.select("document_id", F.lit(1).alias("part"), F.concat(F.format_string("%010d", F.coalesce("seq", F.lit(0)) + 1), "node_id").alias("o"), node.alias("line")))
    rows = rows.unionByName(links.select("document_id", F.lit(3).alias("part"), F.concat_ws(">", "parent_id", "child_id").alias("o"), edge.alias("line")))
    return rows.select("document_id", F.concat(F.col("part").cast("string"), "o").alias("no"), "line")


def write_gexf(lines: DataFrame, path: str) -> None:
    """Lines of :func:`gexf` as text files, a folder a document."""
    lines.repartition("document_id").sortWithinPartitions("document_id", "no").select("document_id", "line").write.mode("overwrite").partitionBy("document_id").text(path)


# Characters of a text that a property graph shows, and its unique keys.
PREVIEW = 100
CONSTRAINTS = {"Snippet": "snippet_id", "Document": "document_id"}


def property_graph(meta: DataFrame, node_rows: DataFrame, edge_rows: DataFrame, roots: DataFrame) -> dict[str, DataFrame]:
    """Nodes and relationships with unique keys (``CONSTRAINTS``), for an idempotent upsert.

    Snippets have their global ``snippet_id``, a ``preview`` of the text and the ``pages`` of their ``provenance``, or their
    own page; a ``bbox`` and ``charspan`` are spread over plain columns.
    """
    own = graph_id(F.col("document_id"), F.col("node_id")).alias("snippet_id")
    pages = F.array(F.col("page_no"))
    if "provenance" in node_rows.columns:
        pages = F.when(F.size("provenance") > 0, F.array_sort(F.array_distinct(F.transform("provenance", lambda p: p["page_no"])))).otherwise(pages)
    flat = []
    if "bbox" in node_rows.columns:
        flat += [F.col("bbox")[c].alias(f"bbox_{c}") for c in "ltrb"] + [F.col("bbox")["coord_origin"].alias("bbox_origin")]
    if "charspan" in node_rows.columns:
        flat += [F.get("charspan", F.lit(i)).alias(f"charspan_{end}") for i, end in enumerate(("start", "end"))]
    kept = [c for c in node_rows.columns if c not in ("bbox", "charspan", "provenance", "text")]
    one = node_rows.dropDuplicates(["document_id", "node_id"])
    links = edge_rows.select("document_id", F.col("parent_id").alias("source"), F.col("child_id").alias("target"), F.when(F.col("relation") == "reference", "REFERENCES").otherwise("HAS_CHILD").alias("kind"), "weight")
    top = roots.select("document_id", F.col("document_id").alias("source"), F.col("root_id").alias("target"), F.lit("HAS_ROOT").alias("kind"), F.lit(None).cast("double").alias("weight"))
    return {
        "documents": meta.dropDuplicates(["document_id"]),
        "snippets": one.select(own, *kept, F.substring(F.coalesce("text", F.lit("")), 1, PREVIEW).alias("preview"), pages.alias("pages"), *flat),
        "relationships": links.unionByName(top).dropDuplicates(["document_id", "source", "target", "kind"]),
    }


def upsert(rows: DataFrame, connect: Callable[[], Callable[[list[dict]], None]], batch: int = 1000) -> None:
    """Send rows in batches to a store; ``connect`` makes a writer in each task.  Keys make a repeated task harmless."""

    def send(part: Iterator) -> None:
        write, held = connect(), []
        for row in part:
            held.append(row.asDict(recursive=True))
            if len(held) >= batch:
                write(held)
                held = []
        if held:
            write(held)

    rows.foreachPartition(send)
