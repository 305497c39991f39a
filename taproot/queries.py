"""Queries over the test tables for the core operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taproot.functions.ids import snippet_id
from taproot.functions.text import cosine, n_chars, n_words, strip, token_count
from taproot.operators import chunks, construct, graph, layout, levels, metadata, reports, retrieval, weights
from taproot.sources import graphs, parsed
from taproot.operators.current import current_rows, newest
from taproot.operators.hierarchy import descendants, hierarchy, looped_descendants
from taproot.plans.lineage import shuffles_removed, stored
from taproot.sources.tables import table


def _links(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "snippet_nodes")
    return nodes.groupBy("document_id", "snippet_id").agg(newest("parent_id", "extracted_at").alias("parent_id"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes that reach no root, with the least node of the cycle in which their way ends."""
    tree = hierarchy(_links(spark, folder), "document_id", "snippet_id", "parent_id", paths=False, only_cycles=True)
    return tree.where("cycle is not null").select(F.col("group").alias("document_id"), F.col("node").alias("snippet_id"), F.col("cycle").alias("cycle_id"))


def p2_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Path, depth, root and size of the subtree of every node."""
    tree = hierarchy(_links(spark, folder), "document_id", "snippet_id", "parent_id")
    return tree.select(
        F.col("group").alias("document_id"), F.col("node").alias("snippet_id"), F.col("root").alias("root_id"), "depth", "subtree", F.col("cycle").alias("cycle_id"),
        F.array_join("path", " > ").alias("path"),
    )


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a node and one of its descendants, those on and below cycles too."""
    tree = hierarchy(_links(spark, folder), "document_id", "snippet_id", "parent_id")
    return descendants(tree).unionByName(looped_descendants(tree)).select(F.col("group").alias("document_id"), F.col("ancestor").alias("ancestor_id"), F.col("node").alias("snippet_id"), "distance")


# --- graphs -------------------------------------------------------------------


def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.nodes(table(spark, folder, "graph_snippets"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edges(table(spark, folder, "edges"))


def _both(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return _nodes(spark, folder), _edges(spark, folder)


def _tree(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.tree(*_both(spark, folder))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def current_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return current_rows(table(spark, folder, "snippet_nodes"), ["document_id", "snippet_id"], ["extracted_at"], ["label", "sequence_no", "text"])


def snippet_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "graph_snippets").select("document_id", "local_ref", snippet_id(F.col("document_id"), F.col("local_ref")).alias("node_id")).distinct()


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_edges(spark, folder), "weight")


def supply_relations(spark: SparkSession, folder: str) -> DataFrame:
    context = graph.contexts(*_both(spark, folder))
    return context.select("document_id", "parent_id", "child_id", graph.supply_relation(context).alias("supply_relation"))


def resolved_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Parents by level alone."""
    items = current_rows(table(spark, folder, "snippet_nodes"), ["document_id", "snippet_id"], ["extracted_at"], ["sequence_no", "level"])
    return construct.parents(items.select("document_id", F.col("snippet_id").alias("node_id"), F.col("sequence_no").alias("seq"), "level"))


def ruled_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Parents by all rules: groups, given parents, levels and regions."""
    return construct.parents(_items(spark, folder))


def document_roots(spark: SparkSession, folder: str) -> DataFrame:
    return graph.root_ids(_nodes(spark, folder), table(spark, folder, "documents_meta"))


def media_mentions(spark: SparkSession, folder: str) -> DataFrame:
    rows = _nodes(spark, folder).select("document_id", "node_id", F.explode(construct.named_media(F.col("text"))).alias("m"))
    return rows.select("document_id", "node_id", "m.base", "m.number")


def component_edges(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    return graph.connect(n, e, graph.root_ids(n, table(spark, folder, "documents_meta")))


def edge_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    """What each node reaches upwards over all edges, with an edge more that makes nodes reach by several ways."""
    return graph.ancestors_of(_crossed(spark, folder))


def _crossed(spark: SparkSession, folder: str) -> DataFrame:
    """The tree and, as references, an edge from each list item's text to the next node."""
    n, e = _both(spark, folder)
    order = Window.partitionBy("document_id").orderBy("seq", "node_id")
    ahead = n.withColumn("next", F.lead("node_id").over(order)).where("grouped and next is not null")
    return e.unionByName(ahead.select("document_id", F.col("node_id").alias("parent_id"), F.col("next").alias("child_id"), F.lit(0.7).alias("weight"), F.lit("reference").alias("relation")))


def counterfactual_parents(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    return weights.counterfactual_parents(n, e, graph.ancestors_of(e)).select("document_id", "parent_id", "child_id", "control")


# --- parsed items ---------------------------------------------------------------


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """Current texts as parsed items: lists are groups under what the delivered parent names, figure texts hang from a
    picture of their page, boxes count from the bottom left."""
    rows, _ = _boxed(spark, folder, "level", "level_label", "is_grouped", "parent_id", "font_key", "line_heights")
    up, grouped, region = strip(F.coalesce("parent_id", F.lit(""))), F.coalesce("is_grouped", F.lit(False)), F.coalesce("region", F.lit("body"))
    ref = F.when(grouped, F.concat(F.lit("#/groups/"), up)).when(region == "figure", F.concat(F.lit("#/pictures/"), F.col("page_no").cast("string"))).otherwise(F.lit("#/body"))
    return rows.select(
        "document_id", "node_id", F.col("ord").alias("seq"), "page_no", "label", "text", "l", "t", "r", "b", "level", "level_label", grouped.alias("grouped"), region.alias("region"), ref.alias("parent_ref"),
        F.lit(0).alias("block"), F.lit(0).alias("column"), "font_key", "line_heights",
    )


def _media(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pictures that figure texts stand in, and the texts with a caption below each, which the test data lack.

    A caption has the number of its page, so that texts name some of them.
    """
    figures = items.where("region = 'figure' and page_no is not null")
    pictures = figures.groupBy("document_id", "page_no").agg(F.min("l").alias("l"), F.max("t").alias("t"), F.max("r").alias("r"), F.min("b").alias("b"), F.max("seq").cast("int").alias("seq"))
    pictures = pictures.select("document_id", F.concat(F.lit("#/pictures/"), F.col("page_no").cast("string")).alias("node_id"), F.lit("image").alias("kind"), "seq", "page_no", "l", "t", "r", "b", F.lit(0).alias("block"), F.lit(0).alias("column"), F.lit(None).cast("string").alias("content"))
    notes = pictures.select(
        "document_id", F.concat(F.lit("#/captions/"), F.col("page_no").cast("string")).alias("node_id"), "seq", "page_no", F.lit("caption").alias("label"), F.concat(F.lit("Fig. "), F.col("page_no").cast("string")).alias("text"),
        "l", (F.col("b") - 10).alias("t"), "r", (F.col("b") - 20).alias("b"), F.lit(1000).alias("level"), F.lit("Body").alias("level_label"), F.lit(False).alias("grouped"), F.lit("figure").alias("region"),
        F.col("node_id").alias("parent_ref"), "block", "column",
    )
    return pictures, items.drop("font_key", "line_heights").unionByName(notes)


def _graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    pictures, texts = _media(_items(spark, folder))
    meta = table(spark, folder, "documents_meta").groupBy("document_id").agg(newest("title", "ingested_at").alias("title"))
    return construct.build(texts, pictures, meta)


def _parented(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    pictures, texts = _media(stored(_items(spark, folder)))
    return stored(pictures), stored(texts.join(construct.parents(texts), ["document_id", "node_id"]))


def media_captions(spark: SparkSession, folder: str) -> DataFrame:
    """Captions found by where they stand."""
    pictures, texts = _media(_items(spark, folder))
    return construct.captions(pictures, texts).select("document_id", "media_id", "node_id", "text")


def media_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Parents and levels of media, by their first mention or the heading before them."""
    pictures, texts = _parented(spark, folder)
    placed, _ = construct.place_media(pictures, texts, construct.captions(pictures, texts))
    return placed.select("document_id", "node_id", "parent_id", "level", "level_label")


def media_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of media with the labels printed in them."""
    pictures, texts = _parented(spark, folder)
    return construct.absorb(pictures, texts, construct.captions(pictures, texts))[0].select("document_id", "node_id", "caption", "text")


def built_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """How many nodes of each kind and label the graphs of all documents have."""
    return _graph(spark, folder)["nodes"].groupBy("document_id", "kind", "level_label").agg(F.count("*").alias("n"))


def built_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The trees of all documents."""
    return _rounded(_graph(spark, folder)["edges"], "weight")


def reference_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _graph(spark, folder)["references"]


def document_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles by the height of print on the first page."""
    return metadata.titles(_items(spark, folder).withColumnRenamed("seq", "ord"), title_page=1)


def document_fields(spark: SparkSession, folder: str) -> DataFrame:
    """What stands under headings that name therapy and control."""
    items = _items(spark, folder).withColumnRenamed("seq", "ord")
    return metadata.fields(items, {"therapy": ("treat", 1, 2), "control": ("monitor", 1, 3), "none": ("xyzzy", 1, 9)})


# --- weights ------------------------------------------------------------------


def structural_weights(spark: SparkSession, folder: str) -> DataFrame:
    return weights.structural(_edges(spark, folder))


def idf_terms(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(weights.idf(_nodes(spark, folder)), "idf")


def bm25_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(weights.bm25(*_both(spark, folder)), "weight")


def bm25_symmetric(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(weights.bm25(*_both(spark, folder), scoring="symmetric_max"), "weight")


def embedding_cosines(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of each vector with the one before it of the same label."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, folder, "embeddings").withColumns({"before": F.lag("vec_id").over(order), "other": F.lag("embedding").over(order)})
    return rows.where("before is not null").select("vec_id", "before", F.round(cosine(F.col("embedding"), F.col("other")), 5).alias("weight"))


def reference_needs(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(weights.reference_need(_nodes(spark, folder)), "need")


def syntactic_needs(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(weights.syntactic_need(graph.contexts(*_both(spark, folder))), "need")


def antecedent_coverage(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    return _rounded(weights.coverage(n, e, weights.idf(n)), "coverage")


def complementarity(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    return _rounded(weights.complementarity(n, e, weights.idf(n)), "complementarity")


def supply_components(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    return _rounded(weights.supply(n, e, weights.idf(n)), "coverage", "complementarity", "measured", "supply")


def recentred_complementarity(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    terms = weights.idf(n)
    stand_ins = weights.controls(n, e, retrieval.ancestors(retrieval.tree(n, e)))
    return _rounded(weights.recentred(lambda rows: weights.complementarity(n, rows, terms), e, stand_ins, "complementarity"), "complementarity")


def evidence_weights(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    return _rounded(weights.evidence(n, e, weights.idf(n)), "need", "supply", "confidence", "weight")


def product_weights(spark: SparkSession, folder: str) -> DataFrame:
    config = weights.WeightConfig("need_supply", composition="product")
    return _rounded(weights.compute(config, *_both(spark, folder)), "weight")


def combined_weights(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    return _rounded(weights.combine(e, weights.bm25(n, e), "mean"), "weight")


def blended_needs(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(weights.need(*_both(spark, folder), weights.NeedConfig("blend")), "need")


def inverted_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(weights.compute("inverted_similarity", *_both(spark, folder)), "weight")


def reweighed_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of saved graphs weighed anew: structural weight times similarity."""
    return _rounded(weights.reweigh(weights.WeightConfig("similarity", combination="multiply"), *_both(spark, folder)), "weight")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """A vector for each node: the embedding whose vec_id is its sequence number."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))
    return _nodes(spark, folder).select("document_id", "node_id", F.col("seq").cast("long").alias("seq")).join(vectors, "seq").select("document_id", "node_id", "vector")


def semantic_weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = weights.compute(weights.WeightConfig("similarity", backend="embedding"), *_both(spark, folder), weights.Inputs(vectors=_vectors(spark, folder)))
    return rows.withColumn("weight", F.round("weight", 5))


def blended_similarity(spark: SparkSession, folder: str) -> DataFrame:
    rows = weights.compute(weights.WeightConfig("similarity", backend="blend", alpha=0.25), *_both(spark, folder), weights.Inputs(vectors=_vectors(spark, folder)))
    return rows.withColumn("weight", F.round("weight", 5))


# --- retrieval ----------------------------------------------------------------


def node_tokens(spark: SparkSession, folder: str) -> DataFrame:
    n = _nodes(spark, folder)
    return n.select("document_id", "node_id", token_count(n_words(F.col("text")), n_chars(F.col("text"))).alias("tokens"))


def tree_parents(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(graph.best_parents(_edges(spark, folder)), "weight")


def tree_ancestors(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(retrieval.ancestors(_tree(spark, folder)), "cumulative")


def _merged(strategy: str, **settings):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        units = retrieval.merge_units(_tree(spark, folder), retrieval.MergePolicy(strategy=strategy, **settings))
        return units.select("document_id", "unit_id", "text", F.array_join("member_ids", ",").alias("members"), F.array_join("breadcrumb", " > ").alias("breadcrumb"), "token_count", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"), F.size("merged").alias("links"))

    query.__name__ = f"merge_{strategy}"
    return query


def merge_means(spark: SparkSession, folder: str) -> DataFrame:
    """Mean size of the units at a range of thresholds."""
    return _rounded(retrieval.means_at(_tree(spark, folder), [0.0, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], retrieval.MergePolicy()), "mean_tokens")


def merge_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """Threshold of the weights that brings the units nearest to twice the size that they have unmerged."""
    n, e = _both(spark, folder)
    rows = retrieval.tree(n, e)
    bare = retrieval.mean_unit_tokens(retrieval.merge_units(rows, retrieval.MergePolicy(strategy="none"))).first().mean_tokens
    c = retrieval.calibrate(rows, e, max(1.0, 2 * bare))
    return spark.createDataFrame([(c.min_weight, c.target, c.achieved, c.evaluated, c.exhaustive)], "min_weight double, target double, achieved double, evaluated int, exhaustive boolean")


def _expanded(mode: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        n, e = _both(spark, folder)
        words = n.select("document_id", "node_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("w"))
        asked = {"insulin": ["insulin", "insulintherapie", "insuline"], "control": ["control", "kontrolle", "contrôle"]}
        hit = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.size(F.array_intersect("w", F.array(*map(F.lit, terms)))).alias("n")) for q, terms in asked.items()])).alias("h")
        hits = words.select("document_id", "node_id", F.size("w").alias("size"), hit).where("h.n > 0").select(F.col("h.q").alias("query_id"), "document_id", "node_id", F.round(F.col("h.n") / F.col("size"), 6).alias("score"))
        # The saved edges have no references; those that make lists stand in for them.
        references = e.where("relation = 'list_item'")
        got = retrieval.expand(hits, retrieval.tree(n, e), retrieval.ExpansionPolicy(mode=mode), references)
        return got.select("query_id", "document_id", "unit_id", "score", "reason", F.array_join("member_ids", ",").alias("members"), F.array_join("absorbed_ids", ",").alias("absorbed"), "added_tokens", "token_count", "text", F.array_join("breadcrumb", " > ").alias("breadcrumb"))

    query.__name__ = f"expand_{mode}"
    return query


# --- reports ------------------------------------------------------------------


def relation_mix(spark: SparkSession, folder: str) -> DataFrame:
    return reports.relation_mix(*_both(spark, folder))


def graph_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reports.summary(_tree(spark, folder))


def graph_checks(spark: SparkSession, folder: str) -> DataFrame:
    return reports.checks(_tree(spark, folder), _edges(spark, folder))


def metric_agreement(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    return reports.agreement({"structural": weights.structural(e), "bm25": weights.bm25(n, e)})


def metric_spread(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    return reports.spread({"structural": weights.structural(e), "bm25": weights.bm25(n, e), "uniform": weights.uniform(e)})


def document_languages(spark: SparkSession, folder: str) -> DataFrame:
    return reports.document_languages(_nodes(spark, folder))


def relation_mix_by_language(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    return reports.relation_mix_by_language(n, e, reports.document_languages(n))


def prior_report(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    return reports.prior_report(n, e, weights.idf(n))


def evidence_report(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    return reports.evidence_report(n, e, weights.idf(n))


def merge_costs(spark: SparkSession, folder: str) -> DataFrame:
    """What each metric costs when its threshold is set to the middle between nothing and everything merged."""
    with shuffles_removed(spark):
        n, e = _nodes(spark, folder), stored(_edges(spark, folder))
        return reports.merge_costs(n, e, {"uniform": weights.uniform(e), "structural": weights.structural(e), "bm25": weights.bm25(n, e)})


def graph_outline(spark: SparkSession, folder: str) -> DataFrame:
    return reports.outline(_tree(spark, folder))


def repeated_texts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.repeated_texts(_nodes(spark, folder))


def chunk_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return reports.chunk_sizes(table(spark, folder, "chunks"))


def fragmentation(spark: SparkSession, folder: str) -> DataFrame:
    return reports.fragmentation(_nodes(spark, folder))


def edge_cards(spark: SparkSession, folder: str) -> DataFrame:
    return reports.edge_cards(*_both(spark, folder), 80)


def strongest_edges(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    return reports.strongest(n, e, {"structural": weights.structural(e), "bm25": weights.bm25(n, e).withColumn("weight", F.round("weight", 9))})


def edge_sample(spark: SparkSession, folder: str) -> DataFrame:
    context = graph.contexts(*_both(spark, folder))
    return reports.stratified_sample(context.select("document_id", "parent_id", "child_id", graph.supply_relation(context).alias("cell")), 20)


# --- pages and levels -----------------------------------------------------------


def _boxed(spark: SparkSession, folder: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Current text items with their boxes from the bottom left, and the pages.

    Without a height a box from the top left is measured down from the top edge, which keeps the order on its page.
    """
    pages = table(spark, folder, "page_geometry").groupBy("document_id", "page_no").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    rows = current_rows(table(spark, folder, "snippet_nodes"), ["document_id", "snippet_id"], ["extracted_at"], ["sequence_no", "label", "page_no", "text", "bbox", "region", *more])
    # By the key that places are found by, so that what is placed need not be shuffled again.
    heights = pages.where("page_no is not null").select("document_id", layout.page_key(), F.col("height").alias("_h"))
    rows = rows.withColumn("_p", layout.page_key()).join(heights, ["document_id", "_p"], "left").where("bbox is not null")
    box = layout.bottom_left(F.col("bbox"), F.coalesce("_h", F.lit(0.0)))
    parent = F.when(F.col("region") == "figure", "#/pictures/0").otherwise("#/body")
    items = rows.withColumn("box", box).select("document_id", F.col("snippet_id").alias("node_id"), F.col("sequence_no").alias("ord"), "page_no", "label", "text", parent.alias("parent_ref"), "box.l", "box.t", "box.r", "box.b", "region", "_p", *more)
    return items, pages


def _shapes(items: DataFrame) -> DataFrame:
    """Drawn shapes, which the test data lack: a rule above and below each title, a box around each text of a sidebar."""
    titles = items.where("label = 'title'")
    rules = [titles.select("document_id", "page_no", F.lit(0.0).alias("l"), y.alias("t"), F.lit(2000.0).alias("r"), y.alias("b")) for y in (F.col("t") + 1, F.col("b"))]
    boxes = items.where("region = 'sidebar'").select("document_id", "page_no", (F.col("l") - 1).alias("l"), (F.col("t") + 12).alias("t"), (F.col("r") + 1).alias("r"), (F.col("b") - 12).alias("b"))
    return rules[0].unionByName(rules[1]).unionByName(boxes)


def _placed(spark: SparkSession, folder: str, *, texts: bool = True) -> DataFrame:
    items, pages = _boxed(spark, folder)
    # Written once, as pages, shapes and places all come from them.
    items = stored(items if texts else items.drop("text"))
    return layout.placed(items.drop("region"), pages, _shapes(items))


def page_places(spark: SparkSession, folder: str) -> DataFrame:
    """Block, column and repaired place of every text item."""
    return _placed(spark, folder, texts=False).select("document_id", "node_id", "page_no", "block", "column", "place")


def stitched_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return layout.stitch(_placed(spark, folder)).select("document_id", "place", "page_no", "label", "text", "parts")


def page_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Regions as rules and boxes give them; a title page is the first here."""
    return layout.regions(_placed(spark, folder, texts=False), title_page=1).select("document_id", "node_id", "region")


def line_fragments(spark: SparkSession, folder: str) -> DataFrame:
    items, pages = _boxed(spark, folder)
    # Texts go out once, by page: only what sizes and shapes need is written.
    bare = stored(items.select("document_id", "page_no", "label", "region", "l", "t", "r", "b"))
    rows = layout.placed(items.drop("region"), pages, _shapes(bare), bare)
    return layout.line_fragments(layout.regions(rows, title_page=1)).select("document_id", "place", "page_no", "text", "parts")


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_rows(table(spark, folder, "snippet_nodes"), ["document_id", "snippet_id"], ["extracted_at"], ["sequence_no", "label", "font_key", "line_heights"])
    return rows.select("document_id", F.col("snippet_id").alias("node_id"), F.col("sequence_no").alias("seq"), "label", "font_key", "line_heights")


def _classified(spark: SparkSession, folder: str, source: str) -> DataFrame:
    titles = table(spark, folder, "documents_meta").groupBy("document_id").agg(newest("title", "ingested_at").alias("title"))
    rows = _items(spark, folder).withColumnRenamed("level", "given").withColumn("heading", F.col("label").isin("title", "section_header"))
    return levels.classify(rows.select("document_id", "node_id", "seq", "heading", "text", "region", "font_key", "line_heights", "given"), titles, source)


def heading_styles(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_rows(table(spark, folder, "snippet_nodes"), ["document_id", "snippet_id"], ["extracted_at"], ["sequence_no", "label", "font_key", "line_heights", "region"])
    rows = rows.where("label in ('title', 'section_header')")
    return levels.heading_styles(rows.select("document_id", F.col("snippet_id").alias("node_id"), F.col("sequence_no").alias("seq"), F.coalesce("region", F.lit("body")).alias("region"), "font_key", "line_heights"))


def text_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Level of every item by type and nesting."""
    return _classified(spark, folder, "hybrid")


def typed_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Level of every item by type alone."""
    return _classified(spark, folder, "typography")


def given_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Level of every item with the delivered levels of headings."""
    return _classified(spark, folder, "given")


def height_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return levels.height_histogram(_typed(spark, folder))


def baseline_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.baseline_chunks(_tree(spark, folder)).withColumn("node_ids", F.array_join("node_ids", ",")).drop("pages")


def graph_gexf(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    meta = table(spark, folder, "documents_meta")
    return graphs.gexf(n, e, graph.root_ids(n, meta), meta)


def graph_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of snippets for a property graph."""
    n, e = _both(spark, folder)
    meta = table(spark, folder, "documents_meta").select("document_id", "filename", "title")
    rows = graphs.property_graph(meta, n, e, graph.root_ids(n, meta))["snippets"]
    return rows.select("snippet_id", "document_id", "seq", "level", "preview", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


def chunk_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Headings that the newest state of each chunk says it stands under, and how many places it comes from."""
    rows = current_rows(table(spark, folder, "chunks"), ["chunk_id"], ["loaded_at"], ["meta"])
    return rows.select("chunk_id", F.array_join(parsed.chunk_headings(F.col("meta")), " > ").alias("headings"), F.size(parsed.chunk_provenance(F.col("meta"))).alias("places"))


def fragmented_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring texts that read as one paragraph cut in two, by strength."""
    return reports.fragmented(_items(spark, folder).join(_placed(spark, folder).select("document_id", "node_id", F.col("column").alias("side")), ["document_id", "node_id"]).drop("column").withColumnRenamed("side", "column"))


def graph_relationships(spark: SparkSession, folder: str) -> DataFrame:
    n, e = _both(spark, folder)
    meta = table(spark, folder, "documents_meta").select("document_id", "filename", "title")
    return graphs.property_graph(meta, n, e, graph.root_ids(n, meta))["relationships"]


QUERIES = {"p2_found": p2_found, "p2_hierarchy": p2_hierarchy, "p2_descendants": p2_descendants}
QUERIES |= {
    f.__name__: f
    for f in (
        current_snippets, snippet_ids, graph_edges, supply_relations, resolved_parents, ruled_parents, document_roots, media_mentions, component_edges,
        media_captions, media_parents, media_texts, built_nodes, built_edges, reference_edges, document_titles, document_fields,
        structural_weights, idf_terms, bm25_weights, bm25_symmetric, embedding_cosines, reference_needs, syntactic_needs, antecedent_coverage, complementarity,
        supply_components, recentred_complementarity, evidence_weights, product_weights, combined_weights, blended_needs, inverted_similarity, reweighed_edges,
        semantic_weights, blended_similarity, node_tokens, tree_parents, tree_ancestors, _merged("none"), _merged("all_ancestors"), _merged("weighted"), _merged("subtree"),
        merge_means, merge_calibration, *map(_expanded, ("parent", "ancestors", "siblings", "subtree", "reference_edges", "auto_merge")),
        relation_mix, relation_mix_by_language, document_languages, graph_summary, graph_checks, graph_outline, repeated_texts, metric_agreement, metric_spread,
        prior_report, evidence_report, merge_costs, chunk_sizes, fragmentation, edge_sample, edge_cards, strongest_edges, page_places, stitched_paragraphs, page_regions, line_fragments,
        heading_styles, text_levels, typed_levels, given_levels, height_histogram, baseline_chunks, edge_ancestors, counterfactual_parents, graph_gexf, graph_relationships, graph_snippets, chunk_headings, fragmented_paragraphs,
    )
}
