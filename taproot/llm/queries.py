"""Queries over the test tables for the text operators, and the same in SQL where SQL can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproot.llm.bpe import encode
from taproot.llm.langid import languages
from taproot.llm.langid import learn as learn_languages
from taproot.llm.packing import fill, pack
from taproot.llm.scans import learn as learn_lines
from taproot.llm.scans import repaired, running_headers
from taproot.llm.sentences import learn, sentences
from taproot.llm.stuffing import stuffing
from taproot.llm.termweight import LATIN_6, log_entropy
from taproot.operators.current import current_rows
from taproot.operators.current import newest as newest_of
from taproot.plans.lineage import cut
from taproot.sources.tables import table


def _current(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, folder, "snippet_nodes"), ["document_id", "snippet_id"], ["extracted_at"], list(columns))


def _language_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Current text nodes and chunks: unit_table, document_id, unit_id, the label's language and the stretches."""
    codes = F.broadcast(table(spark, folder, "language_codes").select(F.col("code").alias("lang"), F.col("lang").alias("labelled")))
    nodes = table(spark, folder, "snippet_nodes").select("document_id", F.col("snippet_id").alias("unit_id"), F.col("extracted_at").alias("at"), "lang", F.when(F.col("label") == "text", F.col("text")).alias("text"))
    # An enriched chunk starts with a line of titles, which isn't part of its text; line breaks of it stay out with it.
    body = F.when(F.col("variant") == "enriched", F.regexp_replace("text", r"\A[^\r\n]*(\r\n|\r|\n|\z)", "")).otherwise(F.col("text"))
    chunks = table(spark, folder, "chunks").select("document_id", F.col("chunk_id").alias("unit_id"), F.col("loaded_at").alias("at"), "lang", body.alias("text"))
    units = nodes.withColumn("unit_table", F.lit("snippet_nodes")).unionByName(chunks.withColumn("unit_table", F.lit("chunks"))).join(codes, "lang", "left")
    model, marks = learn_languages(units.withColumn("taught", F.when(F.col("unit_table") == "snippet_nodes", F.col("labelled"))), "text", "taught")
    # Every delivered row is judged before its newest state is chosen, so that texts are read once and never shuffled.
    found = cut(languages(units, ["unit_table", "document_id", "unit_id", "at", "labelled"], "text", model, marks))
    return current_rows(found, ["unit_table", "document_id", "unit_id"], ["at"], ["labelled", "stretches"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of texts whose label is missing or wrong, or that mix languages."""
    units = _language_stretches(spark, folder).withColumn("langs", F.expr("array_distinct(transform(stretches, x -> x.lang))")).where(F.size("langs") > 0)
    case = F.col("labelled").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("labelled"))
    return units.where(case).select("unit_table", "document_id", "unit_id", F.explode("langs").alias("lang"))


def p1_stretches(spark: SparkSession, folder: str) -> DataFrame:
    """Every stretch of one language of every text node and chunk, with its confidence."""
    units = _language_stretches(spark, folder).select("unit_table", "document_id", "unit_id", F.posexplode("stretches").alias("stretch_no", "s"))
    return units.select("unit_table", "document_id", "unit_id", "stretch_no", "s.start_at", "s.end_at", "s.lang", F.round("s.confidence", 4).alias("confidence"))


def _scans(spark: SparkSession, folder: str) -> DataFrame:
    """Scanned documents with their titles: the newest of documents_meta and that of the first title node."""
    meta = table(spark, folder, "documents_meta").groupBy("document_id").agg(newest_of("document_type", "ingested_at").alias("kind"), newest_of("title", "ingested_at").alias("named"))
    first = table(spark, folder, "graph_snippets").where("label = 'title' and text is not null").groupBy("document_id").agg(F.min(F.struct("sequence_no", "text"))["text"].alias("heading"))
    return meta.where("kind = 'scan'").join(first, "document_id", "left").select("document_id", F.array("named", "heading").alias("titles"))


def _repaired(texts: DataFrame, scans: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of scanned documents repaired, with a model of all texts and the running headers of each document."""
    model = learn_lines(texts, "text")
    scanned = texts.join(scans, "document_id")
    headed = scanned.join(running_headers(scanned, "document_id", "text", model), "document_id", "left")
    return repaired(headed, keys, "text", "titles", model, "running")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of noise in the texts of scanned documents."""
    snippets = table(spark, folder, "graph_snippets").select("document_id", "snippet_id", "text").where("text is not null").distinct()
    return _repaired(snippets, _scans(spark, folder), ["snippet_id"]).select("snippet_id", F.explode("kinds").alias("kind")).distinct()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Current texts of scanned documents as continuous paragraphs."""
    found = _repaired(_current(spark, folder, "text"), _scans(spark, folder), ["document_id", "snippet_id"])
    return found.select("document_id", "snippet_id", F.array_join("kinds", ",").alias("kinds"), "repaired")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of six or more Latin letters that mark a document: in four or more of its nodes, in at most three documents.

    Both factors of the log-entropy weight over nodes decide: a local weight of ln(1 + 4) or more, and an entropy of no
    more than that of a term of three documents.
    """
    nodes = _current(spark, folder, "text")
    scored = log_entropy(nodes, "document_id", "text", pattern=LATIN_6, presence=True)
    size = F.broadcast(nodes.agg(F.countDistinct("document_id").alias("size")))
    widest = F.log(F.lit(3.0)) / F.log(F.greatest(F.col("size"), F.lit(2)).cast("double"))
    return scored.crossJoin(size).where((F.col("local") >= F.log(F.lit(5.0)) - 1e-9) & (F.col("entropy") <= widest + 1e-9)).select("document_id", "term")


def p4_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of every document with its log-entropy weight."""
    scored = log_entropy(_current(spark, folder, "text"), "document_id", "text")
    return scored.select("document_id", "term", "tf", F.col("n_records").alias("n_documents"), F.round("score", 6).alias("score"))


def _running(nodes: DataFrame) -> DataFrame:
    """Rows of running text."""
    return nodes.where("label in ('text', 'list_item')")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Where each sentence but the first of a text starts, in documents that aren't scans."""
    nodes = table(spark, folder, "snippet_nodes")
    model = learn(_running(nodes), "text")
    # Every delivered row is split before its newest state is chosen, so that no text goes through the shuffle.
    running = F.when(F.col("label").isin("text", "list_item"), F.col("text")).alias("text")
    split = sentences(nodes.select("document_id", "snippet_id", "extracted_at", running), ["document_id", "snippet_id", "extracted_at"], "text", model)
    starts = split.withColumn("starts", F.expr("transform(slice(spans, 2, greatest(size(spans) - 1, 0)), x -> x.start_at)"))
    newest = current_rows(starts, ["document_id", "snippet_id"], ["extracted_at"], ["starts"])
    meta = table(spark, folder, "documents_meta").groupBy("document_id").agg(newest_of("document_type", "ingested_at").alias("kind"))
    scans = meta.where("kind = 'scan'").select("document_id")
    return newest.join(scans, "document_id", "left_anti").select("document_id", "snippet_id", F.explode("starts").alias("start_at"))


def p5_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Every sentence of the current running texts with its position."""
    nodes = _running(_current(spark, folder, "label", "text"))
    model = learn(nodes, "text")
    split = sentences(nodes.withColumn("body", F.col("text")), ["document_id", "snippet_id", "body"], "text", model)
    each = split.select("document_id", "snippet_id", "body", F.posexplode("spans").alias("sentence_no", "s"))
    return each.select("document_id", "snippet_id", "sentence_no", "s.start_at", "s.end_at", F.expr("substring(body, s.start_at + 1, s.end_at - s.start_at)").alias("sentence"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode(table(spark, folder, "documents"), "doc_id", "text", name="byte_bpe_50k")


def _packed(spark: SparkSession, folder: str) -> list[tuple[int, int, DataFrame]]:
    """Capacity id, capacity and packing of each row of pack_capacity (a table of a fixed few rows)."""
    documents = table(spark, folder, "documents")
    counted: dict[str, DataFrame] = {}
    out = []
    for row in table(spark, folder, "pack_capacity").orderBy("capacity_id").collect():
        if row.tokenizer not in counted:
            # Written once, so that not every capacity has the texts encoded again.
            counted[row.tokenizer] = cut(encode(documents, "doc_id", "text", name=row.tokenizer, ids=None, count="n_tokens"))
        out.append((row.capacity_id, row.capacity, pack(counted[row.tokenizer], "doc_id", "n_tokens", row.capacity)))
    return out


def p7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in containers of each capacity."""
    parts = [
        packed.select(F.lit(no).alias("capacity_id"), F.col("container").alias("container_id"), "doc_id", "piece", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))
        for no, _, packed in _packed(spark, folder)
    ]
    none = spark.createDataFrame([], "capacity_id int, container_id string, doc_id long, piece int, start_token long, n_tokens long")
    return reduce(DataFrame.unionByName, parts) if parts else none


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How well the containers of each capacity are filled."""
    parts = [fill(packed, capacity).select(F.lit(no).alias("capacity_id"), F.lit(capacity).alias("capacity"), "containers", "tokens", "least", F.round("unused", 6).alias("unused"), "fullest") for no, capacity, packed in _packed(spark, folder)]
    none = spark.createDataFrame([], "capacity_id int, capacity int, containers long, tokens long, least long, unused double, fullest long")
    return reduce(DataFrame.unionByName, parts) if parts else none


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that consist of repeated keywords, links or product tags for more than half of their characters."""
    return stuffing(table(spark, folder, "documents"), "doc_id", "text").where("stuffed").select("doc_id")


def p8_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Share of stuffing of every page, and the shape of lines that holds most of it."""
    return stuffing(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", F.round("share", 6).alias("share"), "shape", "stuffed")


QUERIES = {
    "p1_found": p1_found, "p1_stretches": p1_stretches, "p3_found": p3_found, "p3_repaired": p3_repaired, "p4_found": p4_found, "p4_scores": p4_scores, "p5_found": p5_found, "p5_sentences": p5_sentences, "p6_ids": p6_ids, "p7_packing": p7_packing, "p7_fill": p7_fill,
    "p8_found": p8_found, "p8_shapes": p8_shapes,
}

_CURRENT = "(SELECT * FROM snippet_nodes QUALIFY row_number() OVER (PARTITION BY document_id, snippet_id ORDER BY extracted_at DESC) = 1)"

SQL = {
    "p4_found": f"""
WITH terms AS (
  SELECT DISTINCT document_id, snippet_id, lower(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÖØ-öø-ÿ]{{6,}}'))) AS term FROM {_CURRENT}),
counted AS (SELECT document_id, term, count(*) AS n, count(*) OVER (PARTITION BY term) AS n_documents FROM terms GROUP BY 1, 2)
SELECT document_id, term FROM counted WHERE n >= 4 AND n_documents <= 3""",
    "p4_scores": rf"""
WITH nodes AS {_CURRENT},
terms AS (SELECT document_id, lower(unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+'))) AS term FROM nodes),
counted AS (SELECT document_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
spread AS (SELECT term, sum(tf) AS gf, sum(tf * ln(tf)) AS h, count(*) AS n_documents FROM counted GROUP BY 1)
SELECT document_id, term, tf, n_documents,
       round(ln(1 + tf) * (1 - greatest(0, (ln(gf) - h / gf) / ln((SELECT count(DISTINCT document_id) FROM nodes)))), 6) AS score
FROM counted JOIN spread USING (term)""",
}
