"""Parsed documents as JSON, one object a document, as the public docling format has them: items, tables, cells, pages.

Parsing PDF files itself isn't part of this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.functions.ids import document_name
from taproot.operators.hierarchy import hierarchy
from taproot.operators.media_tables import markdown

_REF = "struct<`$ref`:string>"
_PROV = "array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>,charspan:array<int>>>"
_ITEM = f"self_ref:string,parent:{_REF},children:array<{_REF}>,content_layer:string,label:string,prov:{_PROV}"
_CELLS = "struct<num_rows:int,num_cols:int,table_cells:array<struct<start_row_offset_idx:int,start_col_offset_idx:int,text:string,column_header:boolean>>>"
PARSED_JSON = f"""name string, body struct<self_ref:string,children:array<{_REF}>>, groups array<struct<{_ITEM},name:string>>,
  texts array<struct<{_ITEM},orig:string,text:string,level:int>>, pictures array<struct<{_ITEM},captions:array<{_REF}>>>,
  tables array<struct<{_ITEM},captions:array<{_REF}>,data:{_CELLS}>>, pages map<string,struct<page_no:int,size:struct<width:double,height:double>>>"""


def is_furniture(layer: Column) -> Column:
    return F.coalesce(layer == "furniture", F.lit(False))


def is_kind(ref: Column, kind: str) -> Column:
    """Whether a reference names one of the texts, pictures, tables or groups."""
    return F.coalesce(ref.startswith(f"#/{kind}/"), F.lit(False))


def read_parsed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables ``items``, ``captions``, ``tables``, ``cells``, ``pages`` of all parsed documents under ``path``.

    A document is named by its file.  Items have ``document_id, node_id, kind`` (text, image, table or group)``, ord`` (place
    among its kind)``, label, furniture, text, orig, parent_ref, place`` (among its parent's children) ``, level, prov``.  A
    file that isn't such a document gives nothing.
    """
    rows = spark.read.schema(PARSED_JSON).option("multiLine", True).json(path).withColumn("document_id", document_name(F.input_file_name()))
    parts = []
    for field, kind in (("texts", "text"), ("pictures", "image"), ("tables", "table"), ("groups", "group")):
        own = rows.select("document_id", F.posexplode(field).alias("ord", "x"))
        text, orig, level = (F.col(f"x.{c}") if kind == "text" else F.lit(None) for c in ("text", "orig", "level"))
        parts.append(own.select(
            "document_id", F.col("x.self_ref").alias("node_id"), F.lit(kind).alias("kind"), "ord", F.col("x.label").alias("label"), is_furniture(F.col("x.content_layer")).alias("furniture"),
            text.cast("string").alias("text"), orig.cast("string").alias("orig"), F.col("x.parent.$ref").alias("parent_ref"), level.cast("int").alias("level"), F.col("x.prov").alias("prov"),
        ))
    items = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    held = [rows.select("document_id", F.posexplode("body.children").alias("place", "c"))] + [
        rows.select("document_id", F.explode(f).alias("x")).select("document_id", F.posexplode("x.children").alias("place", "c")) for f in ("groups", "texts", "pictures", "tables")
    ]
    placed = held[0]
    for part in held[1:]:
        placed = placed.unionByName(part)
    placed = placed.groupBy("document_id", F.col("c.$ref").alias("node_id")).agg(F.min("place").alias("place"))
    tables = rows.select("document_id", F.posexplode("tables").alias("seq", "x"))
    links = rows.select("document_id", F.explode(F.concat(F.coalesce(F.transform("pictures", lambda x: F.struct(x["self_ref"].alias("m"), x["captions"].alias("c"))), F.array()), F.coalesce(F.transform("tables", lambda x: F.struct(x["self_ref"].alias("m"), x["captions"].alias("c"))), F.array()))).alias("y"))
    return {
        "items": items.join(placed, ["document_id", "node_id"], "left"),
        "captions": links.select("document_id", F.col("y.m").alias("media_id"), F.posexplode("y.c").alias("at", "c")).select("document_id", "media_id", F.col("c.$ref").alias("node_id"), "at"),
        "tables": tables.select("document_id", F.col("x.self_ref").alias("node_id"), "seq", F.col("x.data.num_rows").alias("n_rows"), F.col("x.data.num_cols").alias("n_cols"), F.transform("x.prov", lambda p: F.struct(p["page_no"].alias("page_no"), *[p["bbox"][c].alias(c) for c in "ltrb"])).alias("prov")),
        "cells": tables.select("document_id", F.col("x.self_ref").alias("node_id"), F.explode("x.data.table_cells").alias("c")).select("document_id", "node_id", F.col("c.start_row_offset_idx").alias("row"), F.col("c.start_col_offset_idx").alias("col"), "c.text", F.col("c.column_header").alias("header")),
        "pages": rows.select("document_id", F.explode(F.map_values("pages")).alias("p")).select("document_id", "p.page_no", F.col("p.size.width").alias("width"), F.col("p.size.height").alias("height")),
    }


def serialized(parsed: dict[str, DataFrame]) -> DataFrame:
    """``document_id, node_id, depth, way, label, text``: the items of every document in reading order, furniture left out.

    Pictures read as their captions, tables as Markdown; what lies in a group is one deeper.  ``way`` orders them: it has
    the place of each item on the path, so no document is gathered.  What lies under furniture or is named by nothing stays out.
    """
    items = parsed["items"].select("document_id", "node_id", "kind", "label", "furniture", "text", F.when(F.col("parent_ref") != "#/body", F.col("parent_ref")).alias("parent"), "place")
    tree = hierarchy(items, "document_id", "node_id", "parent").where("path is not null").select(F.col("group").alias("document_id"), F.col("node").alias("node_id"), "depth", F.posexplode("path").alias("far", "at_id"))
    spots = items.select("document_id", F.col("node_id").alias("at_id"), F.col("furniture").alias("hidden"), F.format_string("%08d", "place").alias("spot"), F.col("place").isNull().alias("loose"))
    ways = tree.join(spots, ["document_id", "at_id"]).groupBy("document_id", "node_id").agg(F.max("depth").alias("depth"), F.max("hidden").alias("hidden"), F.max("loose").alias("loose"), F.array_sort(F.collect_list(F.struct("far", "spot"))).alias("w"))
    texts = items.where("kind = 'text'").select("document_id", "node_id", F.col("text").alias("t"))
    named = parsed["captions"].join(texts, ["document_id", "node_id"]).groupBy("document_id", F.col("media_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("at", "t"))).alias("c"))
    named = named.select("document_id", "node_id", F.array_join(F.transform("c", lambda x: x["t"]), "").alias("caption"))
    rows = items.join(ways.where("not hidden and not loose"), ["document_id", "node_id"]).join(named, ["document_id", "node_id"], "left").join(markdown(parsed["cells"]), ["document_id", "node_id"], "left")
    text = F.when(F.col("kind") == "image", F.coalesce("caption", F.lit(""))).when(F.col("kind") == "table", F.coalesce("content", F.lit(""))).otherwise(F.coalesce("text", F.lit("")))
    return rows.where("kind <> 'group'").select("document_id", "node_id", "depth", F.array_join(F.transform("w", lambda x: x["spot"]), "/").alias("way"), "label", text.alias("text"))


_META = "struct<headings:array<string>,doc_items:array<struct<prov:" + _PROV + ">>>"


def chunk_provenance(meta: Column) -> Column:
    """Page, box and span of everything that a chunk's JSON ``meta`` lists; empty without any."""
    items = F.filter(F.coalesce(F.from_json(meta, _META)["doc_items"], F.array().cast(f"array<struct<prov:{_PROV}>>")), lambda x: x["prov"].isNotNull())
    return F.transform(F.flatten(F.transform(items, lambda x: x["prov"])), lambda p: F.struct(p["page_no"].alias("page_no"), p["bbox"].alias("bbox"), F.when(F.size(p["charspan"]) == 2, p["charspan"]).alias("charspan")))


def chunk_headings(meta: Column) -> Column:
    return F.coalesce(F.from_json(meta, _META)["headings"], F.array().cast("array<string>"))


def write_snippets(node_rows: DataFrame, path: str) -> None:
    """Nodes as JSON lines."""
    node_rows.write.mode("overwrite").json(path)


def write_chunks(chunk_rows: DataFrame, path: str) -> None:
    """Chunks as JSON lines, a folder for each variant."""
    chunk_rows.write.mode("overwrite").partitionBy("variant").json(path)
