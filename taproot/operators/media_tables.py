"""Tables that run on over a page break, and their text.

Tables have ``document_id, node_id, seq, n_rows, n_cols`` and ``prov``, an array of ``page_no, l, t, r, b`` (from the bottom
left); cells have ``document_id, node_id, row, col, text, header``; pages ``document_id, page_no, height``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.functions.text import SPACE, strip

# Where a table must break off and resume (shares of the page height), how many row labels both halves must
# share and what part of the fewer, and how far their widths may differ (points).
BREAK, RESUME, SHARED, SHARED_PART, WIDTH = 0.35, 0.6, 2, 0.6, 5.0


def joined_tables(tables: DataFrame, cells: DataFrame, pages: DataFrame) -> DataFrame:
    """``document_id, node_id, head_id, row_shift``: which table each one is part of, and after how many of its rows.

    A table goes on with the one before it if that one ends low on a page and this one begins high on the next, and both
    have the same row labels; or the same shape, without a header row here.  Labels and rows of all parts count.  The tables
    of a document pass in order; what is held is the labels of one table.
    """
    label = F.regexp_replace(strip(F.coalesce("text", F.lit(""))), f"[{SPACE}]+", " ")
    stub = cells.where("col = 0").select("document_id", "node_id", label.alias("x")).where("x <> ''").groupBy("document_id", "node_id").agg(F.collect_set("x").alias("stub"))
    header = cells.where("row = 0").groupBy("document_id", "node_id").agg(F.max("header").alias("header"))
    first, last = F.col("prov")[0], F.element_at("prov", -1)
    rows = tables.where(F.size("prov") > 0).select("document_id", "node_id", "seq", "n_rows", "n_cols", *[first[c].alias(f"f_{c}") for c in ("page_no", "l", "t", "r")], *[last[c].alias(f"z_{c}") for c in ("page_no", "l", "b", "r")])
    for side in "fz":
        rows = rows.join(pages.select("document_id", F.col("page_no").alias(f"{side}_page_no"), F.col("height").alias(f"{side}_height")), ["document_id", f"{side}_page_no"], "left")
    rows = rows.join(stub, ["document_id", "node_id"], "left").join(header, ["document_id", "node_id"], "left").repartition("document_id").sortWithinPartitions("document_id", "seq", "node_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head: dict | None = None
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                labels = set(r["stub"]) if r["stub"] is not None else set()
                if head and head["document_id"] == r["document_id"] and r["f_page_no"] == head["z_page_no"] + 1 and head["z_b"] <= BREAK * head["z_height"] and r["f_t"] >= RESUME * r["f_height"]:
                    both = labels & head["labels"]
                    repeats = len(both) >= SHARED and len(both) >= SHARED_PART * min(len(labels), len(head["labels"]))
                    alike = r["n_cols"] == head["n_cols"] and abs((head["z_r"] - head["z_l"]) - (r["f_r"] - r["f_l"])) <= WIDTH and not r["header"]
                    if repeats or alike:
                        out.append((r["document_id"], r["node_id"], head["node_id"], head["n_rows"]))
                        head |= {"labels": head["labels"] | labels, "n_rows": head["n_rows"] + r["n_rows"], "n_cols": max(head["n_cols"], r["n_cols"])}
                        head |= {k: r[k] for k in ("z_page_no", "z_l", "z_b", "z_r", "z_height")}
                        continue
                head = r | {"labels": labels}
                out.append((r["document_id"], r["node_id"], r["node_id"], 0))
            yield pd.DataFrame(out, columns=["document_id", "node_id", "head_id", "row_shift"])

    return rows.mapInPandas(walk, "document_id string, node_id string, head_id string, row_shift long")


def whole_cells(cells: DataFrame, joined: DataFrame) -> DataFrame:
    """Cells of whole tables: rows of continuations follow those of their head, their header is none."""
    rows = cells.join(joined, ["document_id", "node_id"])
    return rows.select("document_id", F.col("head_id").alias("node_id"), (F.col("row") + F.col("row_shift")).cast("int").alias("row"), "col", "text", (F.col("header") & (F.col("row_shift") == 0)).alias("header"))


def markdown(cells: DataFrame) -> DataFrame:
    """``document_id, node_id, content``: each table as rows of Markdown, the first row as its head."""
    text = F.regexp_replace(strip(F.coalesce("text", F.lit(""))), r"[\r\n]+|\|", " ")
    wide = cells.groupBy("document_id", "node_id").agg((F.max("col") + 1).alias("n"))
    lines = cells.groupBy("document_id", "node_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", text))).alias("m")).join(wide, ["document_id", "node_id"])
    full = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    line: Column = F.concat(F.lit("| "), F.array_join(full, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.expr("repeat(' --- |', n)"))
    first = F.row_number().over(Window.partitionBy("document_id", "node_id").orderBy("row")) == 1
    made = lines.select("document_id", "node_id", "row", F.when(first, F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("line"))
    return made.groupBy("document_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("x")).select("document_id", "node_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("content"))
