"""Reports on graphs and weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.functions.ids import clip, edge_uid
from taproot.functions.linguistic import marker_votes
from taproot.functions.text import SPACE, n_chars, n_words, strip, token_count
from taproot.operators import retrieval, weights
from taproot.operators.current import current_rows
from taproot.operators.graph import contexts, is_heading, supply_relation
from taproot.operators.hierarchy import PARENT_SPACE
from taproot.operators.layout import CITATION, resumes, unfinished
from taproot.plans.lineage import cut, stored


# Longest heading (characters), most pages that an edge spans, how often a text comes and how long it is to
# count as repeated.
LONG_HEADING, FAR, REPEATS, REPEAT_CHARS = 120, 2, 3, 25
# What speaks for and against two texts being one, how far below a line the next begins (points at least,
# and heights of the line at most), and how one bullet of an enumeration ends.
FRAGMENT = {"base": 0.3, "hyphen": 0.35, "small letter": 0.3, "next line": 0.25, "break": 0.15, "same list": -0.45, "citation": -0.3}
LINE_OVERLAP, LINE_PITCH = -2.0, 1.6
ENUMERATION = r"(?iU)(,|\bund|\boder|\bbzw\.?|\bsowie|/oder)\s*$"


def relation_mix(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Edges, their share and mean weight by supply relation."""
    context = contexts(node_rows, edge_rows)
    counted = context.groupBy(supply_relation(context).alias("supply_relation")).agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 6).alias("mean_weight"))
    total = counted.agg(F.sum("edges").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("supply_relation", "edges", F.round(F.col("edges") / F.col("total"), 6).alias("share"), "mean_weight")


def summary(tree_rows: DataFrame) -> DataFrame:
    """Nodes, roots, headings, greatest depth and words of each document."""
    link = F.col("chain")[0]
    return tree_rows.groupBy("document_id").agg(
        F.count("*").alias("nodes"), F.count(F.when(F.col("parent_id").isNull(), 1)).alias("roots"), F.count(F.when(link["heading"], 1)).alias("headings"),
        F.max("depth").alias("depth"), F.sum(link["words"]).alias("words"),
    )


def checks(tree_rows: DataFrame, edge_rows: DataFrame, *, long_heading: int = LONG_HEADING, far: int = FAR) -> DataFrame:
    """``document_id, fault, n``: how often each kind of fault comes in each document.

    orphan: a node that is no heading and has no parent; inverted_level: a heading that doesn't rank below the heading that
    holds it; long_heading: one of more than ``long_heading`` characters; distant_edge: an edge over more than ``far`` pages;
    unreferenced_media; empty: a node without a text.
    """
    head, own = is_heading(F.col("level_label")), F.col("chain")[0]
    unnamed = F.col("kind").isin("image", "table") & F.coalesce(F.col("level_label") == "Unreferenced Image", F.lit(False))
    alone = {"orphan": F.col("parent_id").isNull() & ~head, "long_heading": (F.col("level_label") == "Heading") & (own["chars"] > long_heading), "unreferenced_media": unnamed, "empty": F.col("text") == ""}
    found = tree_rows.select("document_id", F.explode(F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in alone.items()]), lambda x: x.isNotNull())).alias("fault"))
    ends = contexts(tree_rows.select("document_id", "node_id", "level", "level_label", "page_no"), edge_rows)
    pairs = {
        "inverted_level": F.col("p_level_label").isin("Title", "Heading") & F.col("c_level_label").isin("Title", "Heading") & (F.col("c_level") <= F.col("p_level")),
        "distant_edge": (F.col("p_page_no") > 0) & (F.col("c_page_no") > 0) & (F.abs(F.col("c_page_no") - F.col("p_page_no")) > far),
    }
    crossed = ends.select("document_id", F.explode(F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in pairs.items()]), lambda x: x.isNotNull())).alias("fault"))
    return found.unionByName(crossed).groupBy("document_id", "fault").agg(F.count("*").alias("n"))


def repeated_texts(node_rows: DataFrame, least: int = REPEATS, longest_short: int = REPEAT_CHARS) -> DataFrame:
    """``document_id, text, n``: texts of more than ``longest_short`` characters that come ``least`` times or more in a document
    (a running header read as content?); runs of white space count as one space."""
    flat = F.regexp_replace(strip(F.col("text")), f"[{SPACE}]+", " ")
    return node_rows.select("document_id", flat.alias("text")).where(F.length("text") > longest_short).groupBy("document_id", "text").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def outline(tree_rows: DataFrame, longest: int = 90) -> DataFrame:
    """``document_id, node_id, depth, way, line``: each node as an indented line; ``way`` orders them like the printed tree.

    A way has the place of each node on the path, so no document is gathered to be sorted.
    """
    flat = F.regexp_replace(strip(F.col("text")), f"[{SPACE}]+", " ")
    steps = tree_rows.select("document_id", "node_id", F.posexplode(F.transform("chain", lambda x: x["id"])).alias("far", "at_id"))
    place = tree_rows.select("document_id", F.col("node_id").alias("at_id"), F.format_string("%08d:%s", F.coalesce(F.col("seq"), F.lit(99_999_999)).cast("int"), F.col("node_id")).alias("spot"))
    ways = steps.join(place, ["document_id", "at_id"]).groupBy("document_id", "node_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("o"), "spot"))).alias("w"))
    rows = tree_rows.join(ways.select("document_id", "node_id", F.array_join(F.transform("w", lambda x: x["spot"]), "/").alias("way")), ["document_id", "node_id"])
    depth = F.coalesce("depth", F.lit(0))
    return rows.select("document_id", "node_id", depth.alias("depth"), "way", F.concat(F.repeat(F.lit("  "), depth), F.coalesce("level_label", F.lit("-")), F.lit(" "), F.substring(flat, 1, longest)).alias("line"))


def document_languages(node_rows: DataFrame, first: int = 200) -> DataFrame:
    """``document_id, lang``: en if the first nodes of a document have more English function words than German ones, else de."""
    order = Window.partitionBy("document_id").orderBy("seq", "node_id")
    rows = node_rows.select("document_id", "node_id", "seq", "text").withColumn("at", F.row_number().over(order)).where(F.col("at") <= first)
    votes = rows.groupBy("document_id").agg(*[F.sum(marker_votes(F.col("text"), lang)).alias(lang) for lang in ("en", "de")])
    return votes.select("document_id", F.when(F.col("en") > F.col("de"), "en").otherwise("de").alias("lang"))


def relation_mix_by_language(node_rows: DataFrame, edge_rows: DataFrame, language_rows: DataFrame) -> DataFrame:
    """``lang, supply_relation, edges, share``: edges by relation within each language; the language "all" has all documents."""
    context = contexts(node_rows, edge_rows)
    rows = context.select("document_id", supply_relation(context).alias("supply_relation")).join(language_rows, "document_id")
    counted = rows.groupBy("lang", "supply_relation").agg(F.count("*").alias("edges"))
    counted = counted.unionByName(counted.groupBy("supply_relation").agg(F.sum("edges").alias("edges")).withColumn("lang", F.lit("all")))
    total = counted.groupBy("lang").agg(F.sum("edges").alias("total"))
    return counted.join(F.broadcast(total), "lang").select("lang", "supply_relation", "edges", F.round(F.col("edges") / F.col("total"), 6).alias("share"))


def _mean(column: str) -> Column:
    return F.round(F.avg(column), 6).alias(column)


def prior_report(node_rows: DataFrame, edge_rows: DataFrame, idf_rows: DataFrame) -> DataFrame:
    """By relation: edges, means of the parts of supply, share of edges where the prior decides, and measured less prior."""
    context = contexts(node_rows, edge_rows)
    rows = weights.supply(node_rows, edge_rows, idf_rows).join(context.select(*weights.KEY, supply_relation(context).alias("supply_relation")), weights.KEY)
    bound = F.round(F.avg(F.col("floor_bound").cast("int")), 6).alias("floor_bound")
    return rows.groupBy("supply_relation").agg(F.count("*").alias("edges"), *map(_mean, ("coverage", "complementarity", "measured", "prior", "supply")), bound, F.round(F.avg(F.col("measured") - F.col("prior")), 6).alias("gap"))


def evidence_report(node_rows: DataFrame, edge_rows: DataFrame, idf_rows: DataFrame, config: weights.NeedConfig | None = None, band: float = 0.05) -> DataFrame:
    """By relation, and for "all": means of the parts of evidence, and which way it moves edges from the middle by ``band``."""
    context = contexts(node_rows, edge_rows)
    rows = weights.evidence(node_rows, edge_rows, idf_rows, config).join(context.select(*weights.KEY, supply_relation(context).alias("r")), weights.KEY)
    rows = rows.withColumns({"merging": F.col("need") * F.col("supply"), "independence": (1 - F.col("need")) * F.col("confidence")})
    up, down = (F.col("weight") > 0.5 + band).cast("int"), (F.col("weight") < 0.5 - band).cast("int")
    shares = [F.round(F.avg(up), 6).alias("toward_1"), F.round(F.avg(1 - up - down), 6).alias("neutral"), F.round(F.avg(down), 6).alias("toward_0")]
    found = rows.rollup("r").agg(F.count("*").alias("edges"), *map(_mean, ("need", "supply", "merging", "independence", "weight")), *shares)
    return found.select(F.coalesce("r", F.lit("all")).alias("supply_relation"), *found.columns[1:])


def spread(metrics: dict[str, DataFrame]) -> DataFrame:
    """By metric: edges, mean, population deviation, least and greatest weight, distinct weights (to four places) and zeros."""
    rows = reduce(DataFrame.unionByName, [m.select(F.lit(name).alias("metric"), "weight") for name, m in metrics.items()])
    return rows.groupBy("metric").agg(
        F.count("*").alias("edges"), F.round(F.avg("weight"), 6).alias("mean"), F.round(F.stddev_pop("weight"), 6).alias("deviation"), F.round(F.min("weight"), 6).alias("least"),
        F.round(F.max("weight"), 6).alias("most"), F.countDistinct(F.round("weight", 4)).alias("different"), F.count(F.when(F.col("weight") == 0, 1)).alias("zeros"),
    )


def _steps(node_rows: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """One tree for ``n`` metrics, made into the steps of each (``metric`` is its number).

    ``own`` are edges with ``m0, m1, ..`` (weight and parent, null where a metric lacks the edge); links hold the weights of
    all metrics.  Documents in which all metrics choose the same parents come once, ``copy`` is null there; others come once
    for each metric.  Ids are replaced by numbers once the parents are chosen, as they make most of the rows; documents by
    hashes, which may meet without harm.
    """
    sized = stored(
        retrieval.measured(node_rows).where("document_id is not null and node_id is not null")
        .select("document_id", "node_id", "level_label", "unit", "words", "chars", F.monotonically_increasing_id().cast("string").alias("at"))
    )
    best = own.groupBy("document_id", F.col("child_id").alias("node_id")).agg(*[F.max(f"m{i}").alias(f"m{i}") for i in range(n)])
    parents, ups = (F.array(*[F.col(f"m{i}")[c] for i in range(n)]) for c in ("parent_id", "weight"))
    best = stored(best.select("document_id", "node_id", parents.alias("parents"), ups.alias("weight")))
    split = cut(best.where(F.exists("parents", lambda p: ~p.eqNullSafe(F.col("parents")[0]))).select("document_id").distinct())
    one, each = F.array(F.lit(None).cast("int")), F.array(*[F.lit(i) for i in range(n)])
    some = split.count() > 0

    def copied(rows: DataFrame) -> DataFrame:
        if not some:
            return rows.withColumn("copy", F.lit(None).cast("int"))
        named = rows.join(split.withColumn("apart", F.lit(True)), "document_id", "left")
        return named.withColumn("copy", F.explode(F.when(F.col("apart"), each).otherwise(one))).drop("apart")

    document = F.concat_ws("-", "copy", F.hash("document_id")).alias("document_id")
    up = F.nullif(F.regexp_replace(F.col("parents")[F.coalesce("copy", F.lit(0))], PARENT_SPACE, ""), F.lit(""))
    links = copied(best).join(sized.select("document_id", "node_id", F.col("at").alias("child")), ["document_id", "node_id"])
    links = links.select("document_id", "copy", "child", "weight", up.alias("node_id")).join(sized.select("document_id", "node_id", F.col("at").alias("parent")), ["document_id", "node_id"], "left")
    nodes = copied(sized).select(document, "copy", F.col("at").alias("node_id"), "level_label", "unit", "words", "chars")
    tree = retrieval.tree(nodes, links.select(document, F.col("parent").alias("parent_id"), F.col("child").alias("child_id"), "weight"))
    metric = F.explode(F.when(F.col("copy").isNull(), each).otherwise(F.array("copy"))).alias("metric")
    rows = tree.where(F.col("chain")[0]["unit"]).select("node_id", "chain", metric)
    return stored(retrieval.merge_steps(rows.withColumn("chain", F.transform("chain", lambda x: x.withField("up", x["up"][F.col("metric")]))), by=("metric",)))


def merge_costs(node_rows: DataFrame, edge_rows: DataFrame, metrics: dict[str, DataFrame]) -> DataFrame:
    """By metric: the threshold that brings merged units to the middle between none and all merged, the mean it reaches, its
    error, the share of units merged and the cost against unmerged units.  One calibration for each metric named."""
    spark, out = node_rows.sparkSession, []
    own = edge_rows.select(*weights.KEY)
    for i, metric in enumerate(metrics.values()):
        own = own.join(metric.select(*weights.KEY, F.struct("weight", "parent_id").alias(f"m{i}")), weights.KEY, "left")
    own = stored(own)
    steps = _steps(node_rows, own, len(metrics)) if metrics else own
    for i, name in enumerate(metrics):
        rows = steps.where(F.col("metric") == i)
        n, least, most = rows.agg(F.sum("units"), F.sum(F.when(F.col("units") > 0, F.col("tokens"))), F.sum("tokens")).first()
        bare, whole = (least / n, most / n) if n else (0.0, 0.0)
        c = retrieval.calibrate(rows, own.where(F.col(f"m{i}").isNotNull()).select(f"m{i}.weight"), max(1e-9, (bare + whole) / 2))
        merged = (rows.where(F.col("weight") >= c.min_weight).agg(F.sum("merged")).first()[0] or 0) / n if n else 0.0
        out.append((name, float(c.min_weight), round(c.achieved, 6), round(c.relative_error, 6), round(merged, 6), round(c.achieved / bare, 6) if bare else 0.0))
    return spark.createDataFrame(out, "metric string, min_weight double, mean_tokens double, error double, merged double, cost double")


def agreement(metrics: dict[str, DataFrame]) -> DataFrame:
    """Spearman correlation of every pair of metrics over all edges, ties taking their mean rank; and spread of each.

    Ranks come from counts of distinct values (rounded to six places), so no window runs over all edges.
    """
    key = ["document_id", "parent_id", "child_id"]

    def ranked(name: str, df: DataFrame) -> DataFrame:
        rows = df.select(*key, F.round("weight", 6).alias("v"))
        values = rows.groupBy("v").agg(F.count("*").alias("n"))
        band = F.floor(F.col("v") * 64)
        bands = values.groupBy(band.alias("band")).agg(F.sum("n").alias("m")).select("band", F.coalesce(F.sum("m").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
        inside = F.sum("n").over(Window.partitionBy("band").orderBy("v"))
        mean = values.withColumn("band", band).join(F.broadcast(bands), "band").select("v", (F.col("below") + inside - (F.col("n") - 1) / 2).alias(f"r_{name}"))
        return rows.join(mean, "v").select(*key, f"r_{name}", F.col("v").alias(f"v_{name}"))

    names = list(metrics)
    rows = reduce(lambda a, b: a.join(b, key), [ranked(n, metrics[n]) for n in names])
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(f"r_{a}", f"r_{b}"), 6).alias("spearman")) for i, a in enumerate(names) for b in names[i + 1 :]]
    spread = [F.struct(F.lit(n).alias("a"), F.lit("").alias("b"), F.round(F.stddev_pop(f"v_{n}"), 6).alias("spearman")) for n in names]
    return rows.agg(F.array(*pairs, *spread).alias("all")).select(F.explode("all").alias("x")).select("x.a", "x.b", F.col("x.spearman").alias("value"))


def chunk_sizes(chunks: DataFrame) -> DataFrame:
    """Chunks and their mean size by variant, reloaded chunks counted once."""
    newest = current_rows(chunks, ["chunk_id"], ["loaded_at"], ["variant", "text"])
    return newest.groupBy("variant").agg(F.count("*").alias("chunks"), F.round(F.avg(token_count(n_words(F.col("text")), n_chars(F.col("text")))), 6).alias("mean_tokens"))


def fragmentation(node_rows: DataFrame) -> DataFrame:
    """Texts that seem to go on in the next one: no full stop here and a small letter there, on the same or next page."""
    order = Window.partitionBy("document_id").orderBy("seq", "node_id")
    rows = node_rows.where("text <> ''").withColumns({"next_id": F.lead("node_id").over(order), "next": F.lead("text").over(order), "next_page": F.lead("page_no").over(order)})
    score = F.when(~F.col("text").rlike(r"[.!?:;…]\W*$"), 1).otherwise(0) + F.when(F.col("next").rlike(r"^\W*\p{Ll}"), 1).otherwise(0) + F.when(F.col("next_page") == F.col("page_no") + 1, 1).otherwise(0)
    near = F.col("next_page") - F.col("page_no") <= 1
    return rows.where(near & ~is_heading(F.col("level_label"))).withColumn("score", score).where("score >= 2").select("document_id", "node_id", "next_id", "score")


def fragmented(items: DataFrame) -> DataFrame:
    """``document_id, node_id, next_id, kind, score``: neighbouring texts that seem to be one, from 0 to 1.

    Items have ``seq, label, text, region, grouped, parent_ref, page_no, column, line_heights`` and a box.  The first breaks
    off and the second resumes; kind says where: same-column, column-break, page-break or out-of-order.  A hyphen, a small
    letter, lines right below each other and a break speak for it; two bullets of one list and a new citation against.
    """
    order = Window.partitionBy("document_id").orderBy("seq", "node_id")
    names = ["node_id", "label", "text", "page_no", "column", "t", "grouped", "parent_ref"]
    rows = items.select("document_id", "seq", *names, "b", "line_heights").withColumns({f"x_{c}": F.lead(c).over(order) for c in names})
    flow = [F.col(c).isin("text", "list_item", "footnote") for c in ("label", "x_label")]
    rows = rows.where(flow[0] & flow[1] & unfinished(F.col("text")) & resumes(F.col("x_text")))
    same = F.col("x_page_no") == F.col("page_no")
    kind = F.when(same & (F.col("x_column") == F.col("column")), "same-column").when(same & (F.col("x_column") > F.col("column")), "column-break").when(F.col("x_page_no") == F.col("page_no") + 1, "page-break").otherwise("out-of-order")
    head, tail = strip(F.col("text")), strip(F.col("x_text"))
    small, gap = tail.rlike(r"^\p{Ll}"), F.col("b") - F.col("x_t")
    signs = {
        "hyphen": head.rlike(r"[-\u00ad]$"), "small letter": small, "next line": (kind == "same-column") & (gap >= LINE_OVERLAP) & (gap <= LINE_PITCH * F.array_max("line_heights")),
        "break": kind.isin("column-break", "page-break"), "same list": F.col("grouped") & F.col("x_grouped") & (F.col("parent_ref") == F.col("x_parent_ref")) & F.col("text").rlike(ENUMERATION) & ~small,
        "citation": tail.rlike(CITATION),
    }
    score = reduce(lambda total, sign: total + F.when(F.coalesce(sign[1], F.lit(False)), FRAGMENT[sign[0]]).otherwise(0.0), signs.items(), F.lit(FRAGMENT["base"]))
    return rows.select("document_id", "node_id", F.col("x_node_id").alias("next_id"), kind.alias("kind"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("score"))


def edge_cards(node_rows: DataFrame, edge_rows: DataFrame, longest: int = 1200) -> DataFrame:
    """``uid, document_id, parent_id, child_id, relation, parent_text, child_text``: edges for a reader to judge.

    The uid depends on the ends alone, so judgements outlive a new build.  Tables keep their lines.
    """
    context = contexts(node_rows, edge_rows)
    text = lambda side: F.when(F.col(f"{side}_kind") == "table", clip(F.col(f"{side}_text"), longest, True)).otherwise(clip(F.col(f"{side}_text"), longest))
    return context.select(edge_uid(F.col("document_id"), F.col("parent_id"), F.col("child_id")).alias("uid"), *weights.KEY, supply_relation(context).alias("relation"), text("p").alias("parent_text"), text("c").alias("child_text"))


def strongest(node_rows: DataFrame, edge_rows: DataFrame, metrics: dict[str, DataFrame], top: int = 10) -> DataFrame:
    """The ``top`` heaviest edges by each metric: ``metric, place, weight`` and the edge with its texts."""
    rows = reduce(DataFrame.unionByName, [m.select(F.lit(name).alias("metric"), *weights.KEY, "weight") for name, m in metrics.items()])
    # The window keeps no more than ``top`` rows of a task before they are shuffled.
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("weight"), *weights.KEY))).where(F.col("place") <= top)
    return best.join(edge_cards(node_rows, edge_rows, 60), weights.KEY).select("metric", "place", F.round("weight", 6).alias("weight"), *weights.KEY, "relation", "parent_text", "child_text")


def review_bundle(fragments: DataFrame, items: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of :func:`fragmented` for a reader, one row each: ``uid``, both texts, their pages and boxes."""
    side = lambda p, key: items.select("document_id", F.col("node_id").alias(key), F.col("text").alias(f"{p}_text"), F.struct("page_no", "l", "t", "r", "b").alias(f"{p}_place"))
    rows = fragments.where(F.col("score") >= least).join(side("a", "node_id"), ["document_id", "node_id"]).join(side("b", "next_id"), ["document_id", "next_id"])
    uid = F.substring(F.sha1(F.concat_ws("|", "document_id", F.lit("paragraph"), "node_id", "next_id")), 1, 16)
    return rows.select(uid.alias("uid"), "document_id", "node_id", "next_id", "kind", "score", "a_text", "b_text", "a_place", "b_place")


def stratified_sample(rows: DataFrame, per_cell: int, seed: int = 42) -> DataFrame:
    """``per_cell`` rows of every cell, taken in turn from its documents; a hash of the seed decides, so it can be repeated."""
    mixed = F.xxhash64(*[c for c in rows.columns], F.lit(seed))
    turn = rows.withColumn("_h", mixed).withColumn("turn", F.row_number().over(Window.partitionBy("cell", "document_id").orderBy("_h")))
    picked = turn.where(F.col("turn") <= per_cell).withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("turn", "_h")))
    return picked.where(F.col("place") <= per_cell).drop("_h", "turn")
