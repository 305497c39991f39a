"""Edge weights: structural, lexical, semantic, and need and supply evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.functions import linguistic as ling
from taproot.functions.text import cosine, stems, strip, tokens
from taproot.operators.graph import STRUCTURAL_WEIGHTS, SUPPLY_PRIORS, contexts, is_heading, lookup, supply_relation
from taproot.plans.lineage import cut, stored

KEY = ["document_id", "parent_id", "child_id"]


def structural(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select(*KEY, lookup(F.col("relation"), STRUCTURAL_WEIGHTS, STRUCTURAL_WEIGHTS["text"]).alias("weight"))


def uniform(edge_rows: DataFrame) -> DataFrame:
    return edge_rows.select(*KEY, F.lit(1.0).alias("weight"))


def idf(node_rows: DataFrame, length: int = 6) -> DataFrame:
    """``term, idf`` over all nodes: ln((N + 1) / (df + 1)) + 1."""
    total = node_rows.agg(F.count("*").alias("total"))
    seen = node_rows.select(F.explode(F.array_distinct(stems(F.col("text"), length))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return seen.crossJoin(F.broadcast(total)).select("term", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def bm25(node_rows: DataFrame, edge_rows: DataFrame, *, k1: float = 1.5, b: float = 0.75, scoring: str = "child_query") -> DataFrame:
    """BM25 of the child's terms in the parent's text, divided by the greatest of the document.

    N, lengths and document frequencies are over all nodes of the document.  Only the sum is cut at zero.  Scoring:
    child_query, symmetric_mean or symmetric_max.  A document whose greatest score isn't positive gets zeros.
    """
    # Written once, as counts and pairs all come from them; so no plan holds the nodes' own more than once.
    words = stored(node_rows.select("document_id", "node_id", tokens(F.col("text")).alias("t")))
    stats = words.groupBy("document_id").agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    terms = words.select("document_id", "node_id", F.array_distinct("t").alias("d"))
    df = terms.select("document_id", F.explode("d").alias("term")).groupBy("document_id", "term").agg(F.count("*").alias("df"))
    # Only terms that both ends have count, whichever asks; they are few, and nothing else goes out by term.
    asked = edge_rows.select(*KEY).join(terms.withColumnsRenamed({"node_id": "child_id", "d": "c"}), ["document_id", "child_id"]).join(terms.withColumnsRenamed({"node_id": "parent_id", "d": "p"}), ["document_id", "parent_id"])
    shared = stored(asked.select(*KEY, F.explode(F.array_intersect("c", "p")).alias("term")).join(df, ["document_id", "term"]).join(stats, "document_id"))

    def directed(target: str) -> DataFrame:
        ends = shared.select("document_id", F.col(target).alias("node_id")).distinct()
        held = words.join(ends, ["document_id", "node_id"], "left_semi").select("document_id", F.col("node_id").alias(target), F.size("t").alias("len"), F.explode("t").alias("term"))
        rows = shared.join(held.groupBy("document_id", target, "term", "len").agg(F.count("*").alias("tf")), ["document_id", target, "term"])
        norm = k1 * (1 - b + b * F.col("len") / F.col("avgdl"))
        part = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
        return rows.groupBy(*KEY).agg(F.greatest(F.lit(0.0), F.sum(part)).alias("score"))

    score = directed("parent_id")
    if scoring != "child_query":
        back = directed("child_id").withColumnRenamed("score", "back")
        both = score.join(back, KEY, "full").na.fill(0.0, ["score", "back"])
        joined = (F.col("score") + F.col("back")) / 2 if scoring == "symmetric_mean" else F.greatest("score", "back")
        score = both.select(*KEY, joined.alias("score"))
    score = stored(score)
    top = score.groupBy("document_id").agg(F.max("score").alias("top"))
    rows = edge_rows.select(*KEY).join(score.join(top, "document_id"), KEY, "left")
    return rows.select(*KEY, F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("weight"))


def semantic(edge_rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of the ends' vectors (``document_id, node_id, vector``); an edge without a vector gets 0."""
    p = vectors.select("document_id", F.col("node_id").alias("parent_id"), F.col("vector").alias("pv"))
    c = vectors.select("document_id", F.col("node_id").alias("child_id"), F.col("vector").alias("cv"))
    rows = edge_rows.select(*KEY).join(p, ["document_id", "parent_id"], "left").join(c, ["document_id", "child_id"], "left")
    return rows.select(*KEY, F.coalesce(cosine(F.col("pv"), F.col("cv")), F.lit(0.0)).alias("weight"))


def blend(a: DataFrame, b: DataFrame, alpha: float = 0.5) -> DataFrame:
    """alpha x a + (1 - alpha) x b."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    return a.withColumnRenamed("weight", "x").join(b.withColumnRenamed("weight", "y"), KEY).select(*KEY, (alpha * F.col("x") + (1 - alpha) * F.col("y")).alias("weight"))


def inverted(a: DataFrame) -> DataFrame:
    return a.select(*KEY, (1 - F.col("weight")).alias("weight"))


# --- need ------------------------------------------------------------------

_POINTERS = "array<struct<kind:string,surface:string,offset:int,resolved:boolean,key:string>>"


def _pointers(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield pd.Series([[p._asdict() for p in ling.pointers(t or "")] for t in part])


def pointers(node_rows: DataFrame) -> DataFrame:
    """``document_id, node_id, pointers``: expressions of a node that point at something, worked out once a node."""
    return node_rows.select("document_id", "node_id", F.pandas_udf(_pointers, _POINTERS)("text").alias("pointers"))


def reference_need(node_rows: DataFrame, default: float = 0.0, pointed: DataFrame | None = None) -> DataFrame:
    """Share of a node's pointers (``pointed``, if they are at hand) that it can't resolve by itself."""
    n = F.size("pointers")
    open_ = F.size(F.filter("pointers", lambda p: ~p["resolved"]))
    return (pointers(node_rows) if pointed is None else pointed).select("document_id", "node_id", F.when(n > 0, open_ / n).otherwise(default).alias("need"))


# Weights of the signs that a unit isn't a sentence of its own.
SYNTACTIC_WEIGHTS = {"no_finite_verb": 1.0, "fragment": 1.0, "leading_connective": 1.0, "lowercase_start": 1.0, "parent_ends_in_colon": 2.0}


def syntactic_need(context: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted share of the syntactic signs of each edge."""
    weights = weights or SYNTACTIC_WEIGHTS
    signs = ling.sentence_signs(context["c_text"])
    signs["parent_ends_in_colon"] = F.rtrim(context["p_text"]).endswith(":")
    total = sum(abs(w) for w in weights.values())
    fired = sum((F.when(sign, abs(weights.get(name, 0.0))).otherwise(0.0) for name, sign in signs.items()), F.lit(0.0))
    return context.select(*KEY, (fired / total if total else F.lit(0.0)).alias("need"))


def surprisal_need(edge_rows: DataFrame, control_rows: DataFrame, scorer: Callable[[Column, Column], Column], mode: str = "max", scale: float = 1.0) -> DataFrame:
    """How much the parent lowers the child's surprisal, beyond what a control parent does.

    ``edge_rows`` have ``p_text, c_text``, ``control_rows`` ``document_id, child_id, text`` and perhaps ``parent_id``; ``scorer(text, context)`` gives
    the mean negative log likelihood.  Mode max divides by the document's greatest, tanh squashes by ``scale``.
    """
    empty = F.lit("")
    by = [c for c in KEY if c in control_rows.columns]
    rows = edge_rows.join(control_rows.select(*by, F.col("text").alias("k_text")), by, "left")
    alone = scorer(F.col("c_text"), empty)
    gain = (alone - scorer(F.col("c_text"), F.col("p_text"))) - F.greatest(F.lit(0.0), F.coalesce(alone - scorer(F.col("c_text"), F.col("k_text")), F.lit(0.0)))
    rows = rows.select(*KEY, F.when(F.trim("c_text") == "", 0.0).otherwise(gain).alias("gain"))
    if mode == "tanh":
        return rows.select(*KEY, F.greatest(F.lit(0.0), F.tanh(F.col("gain") / (2 * scale))).alias("need"))
    top = rows.groupBy("document_id").agg(F.max("gain").alias("top"))
    return rows.join(top, "document_id").select(*KEY, F.when(F.col("top") > 0, F.greatest(F.lit(0.0), F.col("gain") / F.col("top"))).otherwise(0.0).alias("need"))


@dataclass(frozen=True)
class NeedConfig:
    """How need is estimated: uniform, reference_density, syntactic, surprisal, or a blend of them by ``blend_weights``."""

    estimator: str = "reference_density"
    blend_weights: tuple[tuple[str, float], ...] = (("reference_density", 0.5), ("syntactic", 0.5))


def need(node_rows: DataFrame, edge_rows: DataFrame, config: NeedConfig | None = None, *, scorer: Callable[[Column, Column], Column] | None = None, control_rows: DataFrame | None = None, pointed: DataFrame | None = None) -> DataFrame:
    """Need of every edge, between 0 and 1, by the configured estimator.

    An edge whose child has no text on record needs nothing.  Surprisal takes a ``scorer`` and ``control_rows``.
    """
    config = config or NeedConfig()
    edge_keys = edge_rows.select(*KEY)
    if config.estimator == "uniform":
        return edge_keys.withColumn("need", F.lit(1.0))
    if config.estimator == "reference_density":
        own = reference_need(node_rows, pointed=pointed).select("document_id", F.col("node_id").alias("child_id"), "need")
        return edge_keys.join(own, ["document_id", "child_id"], "left").select(*KEY, F.coalesce("need", F.lit(0.0)).alias("need"))
    if config.estimator == "syntactic":
        return syntactic_need(contexts(node_rows, edge_rows))
    if config.estimator == "surprisal":
        if scorer is None or control_rows is None:
            raise ValueError("surprisal takes a scorer and control rows")
        return surprisal_need(contexts(node_rows, edge_rows), control_rows, scorer)
    if config.estimator != "blend":
        raise ValueError(f"unknown estimator {config.estimator!r}")
    weights = {name: w for name, w in config.blend_weights if w > 0}
    if not weights:
        raise ValueError("a blend takes at least one positive weight")
    if unknown := set(weights) - {"uniform", "reference_density", "syntactic", "surprisal"}:
        raise ValueError(f"unknown estimators {sorted(unknown)}")
    total, out = sum(weights.values()), edge_keys.withColumn("need", F.lit(0.0))
    for name, w in weights.items():
        part = need(node_rows, edge_rows, NeedConfig(name), scorer=scorer, control_rows=control_rows, pointed=pointed).withColumnRenamed("need", "x")
        out = out.join(part, KEY, "left").select(*KEY, (F.col("need") + w / total * F.coalesce("x", F.lit(0.0))).alias("need"))
    return out


# --- supply ----------------------------------------------------------------


def _resolved_in(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for asked, texts in parts:
        out = []
        for items, text in zip(asked, texts):
            profile = ling.profile(text or "")
            out.append([ling.resolves(p["kind"], p["key"], text or "", profile) for p in items])
        yield pd.Series(out)


def coverage(node_rows: DataFrame, edge_rows: DataFrame, idf_rows: DataFrame | None = None, default: float = 0.0, prose_only: bool = True, pointed: DataFrame | None = None) -> DataFrame:
    """Share (by idf) of the child's open pointers that the parent resolves; ``support`` is how many there are.

    An edge below a heading isn't measured if ``prose_only``; it and a child without open pointers get the default.
    """
    asked = (pointers(node_rows) if pointed is None else pointed).select("document_id", F.col("node_id").alias("child_id"), F.filter("pointers", lambda p: ~p["resolved"]).alias("asked"))
    if idf_rows is not None:
        # Weights come by a join: the table of terms grows with the corpus, so it isn't broadcast.
        top = idf_rows.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("most"))
        each = asked.select("document_id", "child_id", F.posexplode("asked").alias("at", "p")).withColumn("term", F.lower(F.substring("p.key", 1, 6)))
        each = each.join(idf_rows, "term", "left").crossJoin(F.broadcast(top)).withColumn("w", F.coalesce(F.when(F.col("term") != "", F.col("idf")), F.col("most")))
        asked = each.groupBy("document_id", "child_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("p"), "w"))).alias("a")).select(
            "document_id", "child_id", F.col("a.p").alias("asked"), F.col("a.w").alias("w")
        )
    else:
        asked = asked.withColumn("w", F.transform("asked", lambda _: F.lit(1.0)))
    context = contexts(node_rows, edge_rows).join(asked, ["document_id", "child_id"], "left")
    measured = (~is_heading(F.col("p_level_label")) if prose_only else F.lit(True)) & (F.size(F.coalesce("asked", F.array())) > 0)
    measured = F.col("asked").isNotNull() & measured
    rows = context.select(*KEY, "w", measured.alias("measured"), F.pandas_udf(_resolved_in, "array<boolean>")(F.when(measured, F.col("asked")).otherwise(F.expr(f"cast(array() as {_POINTERS})")), "p_text").alias("hit"))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    covered = F.aggregate(F.zip_with("w", "hit", lambda w, h: F.when(h, w).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return rows.select(*KEY, F.when(F.col("measured") & (total > 0), covered / total).otherwise(default).alias("coverage"), F.when(F.col("measured"), F.size("w")).otherwise(0).alias("support"))


def complementarity(node_rows: DataFrame, edge_rows: DataFrame, idf_rows: DataFrame, top_k: int = 8, min_idf: float = 0.0) -> DataFrame:
    """What is new in the parent (its ``top_k`` rarest terms) against what the child says, in idf.

    A term that ``idf_rows`` don't know counts like the rarest, as 1 if they are empty.
    """
    rarest = F.broadcast(idf_rows.agg(F.coalesce(F.max("idf"), F.lit(1.0)).alias("rarest")))

    def weighed(rows: DataFrame) -> DataFrame:
        return rows.join(idf_rows, "term", "left").crossJoin(rarest).withColumn("idf", F.coalesce("idf", "rarest"))

    terms = node_rows.select("document_id", "node_id", F.array_distinct(stems(F.col("text"))).alias("t"))
    p = terms.select("document_id", F.col("node_id").alias("parent_id"), F.col("t").alias("pt"))
    c = terms.select("document_id", F.col("node_id").alias("child_id"), F.col("t").alias("ct"))
    pairs = edge_rows.select(*KEY).join(p, ["document_id", "parent_id"]).join(c, ["document_id", "child_id"])
    new = pairs.select(*KEY, F.explode(F.array_except("pt", "ct")).alias("term")).transform(weighed).where(F.col("idf") >= min_idf)
    novel = new.groupBy(*KEY).agg(F.slice(F.sort_array(F.collect_list("idf"), False), 1, top_k).alias("w")).select(*KEY, F.aggregate("w", F.lit(0.0), lambda s, x: s + x).alias("novel"))
    mass = terms.select("document_id", F.col("node_id").alias("child_id"), F.explode("t").alias("term")).transform(weighed).groupBy("document_id", "child_id").agg(F.sum("idf").alias("mass"))
    rows = edge_rows.select(*KEY).join(novel, KEY, "left").join(mass, ["document_id", "child_id"], "left").na.fill(0.0, ["novel", "mass"])
    return rows.select(*KEY, F.when(F.col("novel") + F.col("mass") > 0, F.col("novel") / (F.col("novel") + F.col("mass"))).otherwise(0.0).alias("complementarity"))


def priors(context: DataFrame) -> DataFrame:
    return context.select(*KEY, lookup(supply_relation(context), SUPPLY_PRIORS, 0.0).alias("prior"))


def supply(node_rows: DataFrame, edge_rows: DataFrame, idf_rows: DataFrame, combine: str = "max", floor: str = "prior", pointed: DataFrame | None = None) -> DataFrame:
    """All components of supply: coverage, complementarity, prior, measured, supply and floor_bound."""
    rows = coverage(node_rows, edge_rows, idf_rows, pointed=pointed).join(complementarity(node_rows, edge_rows, idf_rows), KEY).join(priors(contexts(node_rows, edge_rows)), KEY)
    measured = F.greatest("coverage", "complementarity") if combine == "max" else (F.col("coverage") + F.col("complementarity")) / 2
    value = F.greatest("measured", "prior") if floor == "prior" else F.col("measured")
    bound = (F.col("prior") > F.col("measured")) if floor == "prior" else F.lit(False)
    return rows.withColumn("measured", measured).select(*KEY, "coverage", "support", "complementarity", "prior", "measured", value.alias("supply"), bound.alias("floor_bound"))


def controls(node_rows: DataFrame, edge_rows: DataFrame, ancestor_rows: DataFrame, k: int = 8) -> DataFrame:
    """Up to ``k`` stand-in parents of every edge: parents of the same document, of the same relation, nearest in length.

    The child, its parent and its ancestors are none.  Parents are ranked by length, and as many are taken from either
    side of an edge's length as it needs with all of these blocked; so the nearest are exact without pairs of all parents.
    """
    context = contexts(node_rows, edge_rows)
    size = F.size(stems(F.col("text")))
    p_heading = F.col("rel").isin("section", "heading_list", "heading_text")
    edge = context.select(*KEY, supply_relation(context).alias("rel"), F.size(stems(F.col("p_text"))).alias("len")).select(*KEY, p_heading.alias("k_heading"), "len")
    edge = cut(edge)
    stand = edge_rows.select("document_id", F.col("parent_id").alias("node_id")).distinct().join(node_rows, ["document_id", "node_id"]).where("text <> ''")
    stand = cut(stand.select("document_id", F.col("node_id").alias("control"), is_heading(F.col("level_label")).alias("k_heading"), size.alias("k_len")))
    pool = ["document_id", "k_heading"]
    # How many parents are shorter than each length in use.
    met = stand.select(*pool, F.col("k_len").alias("len"), F.lit(1).alias("n")).unionByName(edge.select(*pool, "len", F.lit(0).alias("n"))).groupBy(*pool, "len").agg(F.sum("n").alias("n"))
    by_length = Window.partitionBy(*pool).orderBy("len").rowsBetween(Window.unboundedPreceding, -1)
    met = met.select(*pool, "len", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("below"), F.sum("n").over(Window.partitionBy(*pool)).alias("total"))
    up = cut(ancestor_rows.select("document_id", F.col("node_id").alias("child_id"), F.col("ancestor_id").alias("control")))
    blocked = up.groupBy("document_id", "child_id").agg(F.count("*").alias("n"))
    edge = edge.join(met, [*pool, "len"]).join(blocked, ["document_id", "child_id"], "left").withColumn("need", F.coalesce("n", F.lit(0)) + k + 2)

    def side(longer: bool) -> DataFrame:
        before = F.col("below") if longer else F.col("total") - F.col("below")
        wanted = edge.where(before < F.col("total")).select(*KEY, "k_heading", "len", F.explode(F.sequence(before + 1, F.least(before + F.col("need"), F.col("total")))).alias("at"))
        order = Window.partitionBy(*pool).orderBy("k_len" if longer else F.desc("k_len"), "control")
        return wanted.join(stand.withColumn("at", F.row_number().over(order).cast("long")), [*pool, "at"])

    pairs = side(True).unionByName(side(False)).where((F.col("control") != F.col("parent_id")) & (F.col("control") != F.col("child_id")))
    ranked = Window.partitionBy(*KEY).orderBy(F.abs(F.col("k_len") - F.col("len")), "control")
    return cut(pairs.join(up, ["document_id", "child_id", "control"], "left_anti").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(*KEY, "control"))


def counterfactual_parents(node_rows: DataFrame, edge_rows: DataFrame, ancestor_rows: DataFrame) -> DataFrame:
    """One stand-in parent of every edge that has one: ``document_id, parent_id, child_id, control, text``.

    The parents of a document stand in a ring by id; from half the ring on behind an edge's parent the first counts that has
    a text and is neither end nor an ancestor of the child.  Of the ring each edge sees as many members as may be barred.
    """
    pool = stored(edge_rows.select("document_id", F.col("parent_id").alias("control")).distinct().join(node_rows.select("document_id", F.col("node_id").alias("control"), "text"), ["document_id", "control"]))
    ring = stored(pool.withColumn("at", F.row_number().over(Window.partitionBy("document_id").orderBy("control")) - 1))
    sizes = ring.groupBy("document_id").agg(F.count("*").alias("n"))
    # Those with a text are numbered once more; each place of the ring knows how many of them come before it.
    full = strip(F.col("text")) != ""
    before = F.sum(F.when(full, 1).otherwise(0)).over(Window.partitionBy("document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    ring = stored(ring.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("full", full).drop("text"))
    said = ring.where("full").select("document_id", "control", "before")
    m = said.groupBy("document_id").agg(F.count("*").alias("m"))
    barred = ancestor_rows.select("document_id", F.col("node_id").alias("child_id"), F.col("ancestor_id").alias("control")).distinct()
    counts = barred.groupBy("document_id", "child_id").agg(F.count("*").alias("k"))
    own = edge_rows.select(*KEY).join(ring.select("document_id", F.col("control").alias("parent_id"), "at"), ["document_id", "parent_id"]).join(sizes, "document_id").join(m, "document_id")
    own = own.withColumn("start", (F.col("at") + F.greatest(F.lit(1), F.floor(F.col("n") / 2))) % F.col("n"))
    own = own.join(ring.select("document_id", F.col("at").alias("start"), F.col("before").alias("first")), ["document_id", "start"]).join(counts, ["document_id", "child_id"], "left")
    seen = own.select(*KEY, "first", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("m") - 1, F.coalesce("k", F.lit(0)) + 2))).alias("step"))
    seen = seen.withColumn("before", (F.col("first") + F.col("step")) % F.col("m")).join(said, ["document_id", "before"]).where((F.col("control") != F.col("parent_id")) & (F.col("control") != F.col("child_id")))
    free = seen.join(barred, ["document_id", "child_id", "control"], "left_anti").groupBy(*KEY).agg(F.min(F.struct("step", "control"))["control"].alias("control"))
    return free.join(node_rows.select("document_id", F.col("node_id").alias("control"), "text"), ["document_id", "control"]).select(*KEY, "control", "text")


def recentred(scores: Callable[[DataFrame], DataFrame], edge_rows: DataFrame, control_rows: DataFrame, value: str) -> DataFrame:
    """A measure of every edge minus its mean over the controls, cut at 0; without controls 0.  Both are scored in one pass."""
    extra = control_rows.select("document_id", F.col("control").alias("parent_id"), "child_id").distinct().withColumn("relation", F.lit("text")).withColumn("weight", F.lit(0.0))
    both = edge_rows.select(*KEY, "relation", "weight").unionByName(extra).groupBy(*KEY).agg(F.max("relation").alias("relation"), F.max("weight").alias("weight"))
    scored = scores(both).select(*KEY, F.col(value).alias("v"))
    base = control_rows.join(scored.select("document_id", F.col("parent_id").alias("control"), "child_id", F.col("v").alias("b")), ["document_id", "control", "child_id"]).groupBy(*KEY).agg(F.avg("b").alias("base"))
    return edge_rows.select(*KEY).join(scored, KEY).join(base, KEY, "left").select(*KEY, F.greatest(F.lit(0.0), F.when(F.col("base").isNull(), 0.0).otherwise(F.col("v") - F.col("base"))).alias(value))


# --- composition -----------------------------------------------------------

#: Words at which a missing sign of dependence counts half.
HALF_LENGTH = 20


def evidence(node_rows: DataFrame, edge_rows: DataFrame, idf_rows: DataFrame, config: NeedConfig | None = None, **extra) -> DataFrame:
    """Evidence for merging: 0.5 x (1 + need x supply - (1 - need) x confidence), with its terms.

    What points at something is worked out once for need and supply.
    """
    pointed = stored(pointers(node_rows))
    kinds = node_rows.select("document_id", F.col("node_id").alias("child_id"), F.when(F.col("kind").isin("image", "table"), 0).otherwise(F.size(tokens(F.col("text")))).alias("n"))
    confidence = (F.col("n") / (F.col("n") + HALF_LENGTH)).alias("confidence")
    measured = supply(node_rows, edge_rows, idf_rows, floor="none", pointed=pointed).select(*KEY, "supply")
    rows = measured.join(need(node_rows, edge_rows, config, pointed=pointed, **extra), KEY).join(kinds, ["document_id", "child_id"]).select(*KEY, "need", "supply", confidence)
    weight = 0.5 * (1 + F.col("need") * F.col("supply") - (1 - F.col("need")) * F.col("confidence"))
    return rows.select(*KEY, "need", "supply", "confidence", weight.alias("weight"))


def product(node_rows: DataFrame, edge_rows: DataFrame, idf_rows: DataFrame, config: NeedConfig | None = None, **extra) -> DataFrame:
    """need x supply, supply floored at the prior of the relation."""
    pointed = stored(pointers(node_rows))
    wanted = need(node_rows, edge_rows, config, pointed=pointed, **extra)
    return supply(node_rows, edge_rows, idf_rows, pointed=pointed).join(wanted, KEY).select(*KEY, (F.col("need") * F.col("supply")).alias("weight"))


def combine(own: DataFrame, metric: DataFrame, how: str = "replace") -> DataFrame:
    """Weights of a metric put in place of, multiplied with or averaged with the own ones."""
    rows = own.select(*KEY, F.col("weight").alias("a")).join(metric.select(*KEY, F.col("weight").alias("b")), KEY, "left")
    value = {"replace": F.col("b"), "multiply": F.col("a") * F.col("b"), "mean": (F.col("a") + F.col("b")) / 2}[how]
    return rows.select(*KEY, F.coalesce(value, F.col("a")).alias("weight"))


@dataclass(frozen=True)
class WeightConfig:
    """What edges are weighed by.

    ``backend`` of similarity is bm25, embedding or blend (``alpha`` is the share of embeddings); ``composition`` of need and
    supply is evidence or product; ``combination`` with the own weights is replace, multiply or mean.
    """

    metric: str = "structural"
    backend: str = "bm25"
    alpha: float = 0.5
    k1: float = 1.5
    b: float = 0.75
    scoring: str = "child_query"
    need: NeedConfig = NeedConfig()
    composition: str = "evidence"
    combination: str = "replace"

    def __post_init__(self) -> None:
        if self.backend not in ("bm25", "embedding", "blend") or self.composition not in ("evidence", "product") or self.combination not in ("replace", "multiply", "mean"):
            raise ValueError("unknown backend, composition or combination")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must lie between 0 and 1")


@dataclass(frozen=True)
class Inputs:
    """What metrics may need besides the graph: vectors of the nodes, idf of a corpus, a scorer and controls of surprisal."""

    vectors: DataFrame | None = None
    idf_rows: DataFrame | None = None
    scorer: Callable[[Column, Column], Column] | None = None
    control_rows: DataFrame | None = None


def similarity(node_rows: DataFrame, edge_rows: DataFrame, config: WeightConfig, inputs: Inputs) -> DataFrame:
    """Similarity of the ends' texts by the configured backend."""
    if config.backend != "bm25" and inputs.vectors is None:
        raise ValueError("embeddings take vectors")
    if config.backend == "embedding":
        return semantic(edge_rows, inputs.vectors)
    lexical = bm25(node_rows, edge_rows, k1=config.k1, b=config.b, scoring=config.scoring)
    return lexical if config.backend == "bm25" else blend(semantic(edge_rows, inputs.vectors), lexical, config.alpha)


def need_supply(node_rows: DataFrame, edge_rows: DataFrame, config: WeightConfig, inputs: Inputs) -> DataFrame:
    terms = idf(node_rows) if inputs.idf_rows is None else inputs.idf_rows
    composed = evidence if config.composition == "evidence" else product
    return composed(node_rows, edge_rows, terms, config.need, scorer=inputs.scorer, control_rows=inputs.control_rows).select(*KEY, "weight")


Metric = Callable[[DataFrame, DataFrame, WeightConfig, Inputs], DataFrame]
_metrics: dict[str, Metric] = {}


def register(name: str, metric: Metric) -> None:
    """Add a metric: a function of nodes, edges, configuration and inputs that gives the key and ``weight``."""
    _metrics[name] = metric


def available() -> list[str]:
    return sorted(_metrics)


def compute(config: WeightConfig | str, node_rows: DataFrame, edge_rows: DataFrame, inputs: Inputs | None = None) -> DataFrame:
    """Weights of a metric, named or configured, before they are combined with the own ones."""
    config = WeightConfig(config) if isinstance(config, str) else config
    if config.metric not in _metrics:
        raise ValueError(f"unknown metric {config.metric!r}; there are {', '.join(available())}")
    return _metrics[config.metric](node_rows, edge_rows, config, inputs or Inputs())


def reweigh(config: WeightConfig, node_rows: DataFrame, edge_rows: DataFrame, inputs: Inputs | None = None) -> DataFrame:
    """Edges with new weights.  Tree and reference edges are weighed in one pass, so that they share one scale.

    Edges that don't say how they came about can't be weighed anew.
    """
    if edge_rows.where("relation is null").limit(1).count():
        raise ValueError("there are edges without a relation")
    own = structural(edge_rows)
    if config.metric == "structural" and config.combination == "replace":
        new = own
    else:
        new = combine(own, compute(config, node_rows, edge_rows, inputs), config.combination)
    return edge_rows.drop("weight").join(new, KEY).select(*edge_rows.columns)


def metric_grid() -> dict[str, WeightConfig]:
    """The configurations that reports compare: one for each metric and way to estimate need."""
    ns = {name: WeightConfig("need_supply", need=NeedConfig(name)) for name in ("reference_density", "syntactic", "blend")}
    plain = {name: WeightConfig(name) for name in ("uniform", "structural", "similarity", "inverted_similarity")}
    return plain | {f"ns/{name}": c for name, c in ns.items()} | {"ns/blend/product": WeightConfig("need_supply", need=NeedConfig("blend"), composition="product")}


register("structural", lambda n, e, c, i: structural(e))
register("uniform", lambda n, e, c, i: uniform(e))
register("similarity", similarity)
register("inverted_similarity", lambda n, e, c, i: inverted(similarity(n, e, c, i)))
register("need_supply", need_supply)
