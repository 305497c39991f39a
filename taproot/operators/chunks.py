"""Flat chunks of a document's reading order under a budget of tokens."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taproot.functions.ids import chunk_id
from taproot.operators.retrieval import crumbs, with_texts
from taproot.functions.text import token_count

#: Namespace of chunk ids; a parameter.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "taproot")


def baseline_chunks(tree_rows: DataFrame, max_tokens: int = 512, merge_peers: bool = True, namespace: uuid.UUID = NAMESPACE) -> DataFrame:
    """``document_id, chunk_id, variant, chunk_index, text, node_ids, page_no, pages`` of both variants.

    Nodes under the same headings share chunks of at most ``max_tokens``; one that alone has more keeps a chunk of its own.
    Without ``merge_peers`` each node is a chunk.  The enriched variant opens with the line of headings.  The nodes under a
    heading pass in order and only the size of the open chunk is held; what is gathered is one chunk.
    """
    link = F.col("chain")[0]
    rows = tree_rows.where(link["unit"] & ~link["heading"]).select("document_id", "node_id", "seq", crumbs(F.col("chain")).alias("crumb_ids"), token_count(link["words"], link["chars"]).alias("n"))
    rows = rows.withColumn("path", F.array_join("crumb_ids", "\n")).repartition("document_id", "path").sortWithinPartitions("document_id", "path", "seq", "node_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, no = None, 0, 0
        for batch in batches:
            out = []
            for key, n in zip(zip(batch["document_id"], batch["path"]), batch["n"].tolist()):
                if key != at:
                    at, held, no = key, 0, 0
                if held and (not merge_peers or held + n > max_tokens):
                    held, no = 0, no + 1
                held += n
                out.append(no)
            yield batch.drop(columns="n").assign(no=out)

    kinds = dict(rows.dtypes)
    placed = rows.mapInPandas(fold, ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns if c != "n") + ", no long")
    chunks = placed.groupBy("document_id", "path", "no").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("m"), F.first("crumb_ids").alias("crumb_ids"))
    chunks = chunks.withColumn("chunk_index", F.row_number().over(Window.partitionBy("document_id").orderBy("m")) - 1)
    units = chunks.select("document_id", F.col("m")[0]["node_id"].alias("unit_id"), "chunk_index", F.transform("m", lambda x: x["node_id"]).alias("member_ids"), "crumb_ids")
    full = with_texts(units, tree_rows, "\n")
    path = F.array_join("breadcrumb", " > ")
    rich = F.when(path == "", F.col("text")).otherwise(F.concat_ws("\n", path, F.col("text")))
    both = F.explode(F.array(F.struct(F.lit("baseline").alias("variant"), F.col("text")), F.struct(F.lit("enriched").alias("variant"), rich.alias("text"))))
    out = full.select("document_id", "chunk_index", F.col("member_ids").alias("node_ids"), "page_no", "pages", both.alias("v"))
    return out.select("document_id", chunk_id(namespace, F.col("document_id"), F.col("v.variant"), F.col("chunk_index")).alias("chunk_id"), "v.variant", "chunk_index", "v.text", "node_ids", "page_no", "pages")
