"""Retrieval units of document graphs: merging by weight and budget, growing hits, and thresholds of equal cost.

A tree has one row a node with ``chain``: the node itself and its ancestors, nearest first, each with what decisions
need.  It is built once; every strategy, threshold and budget is then an expression over the chain of its row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.functions.text import n_chars, n_words, token_count
from taproot.operators.graph import best_parents, is_heading
from taproot.operators.hierarchy import hierarchy
from taproot.plans.lineage import cut, stored

ID = ["document_id", "node_id"]


@dataclass(frozen=True)
class MergePolicy:
    """How units are merged.  Strategies: none, all_ancestors, weighted, subtree."""

    strategy: str = "weighted"
    min_weight: float = 0.5
    min_cumulative: float = 0.0
    min_tokens: int = 0
    max_tokens: int = 1024
    separator: str = "\n\n"

    def __post_init__(self) -> None:
        if self.strategy not in ("none", "all_ancestors", "weighted", "subtree"):
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if not (0 <= self.min_weight <= 1 + 1e-9 and 0 <= self.min_cumulative <= 1 and self.min_tokens >= 0 and self.max_tokens > 0):
            raise ValueError("policy out of range")
        if self.separator.strip():
            raise ValueError("the separator must be white space")


@dataclass(frozen=True)
class ExpansionPolicy:
    """How hits grow.  Modes: none, parent, ancestors, siblings, subtree, reference_edges, auto_merge."""

    mode: str = "auto_merge"
    min_siblings: int = 2
    min_edge_weight: float = 0.0
    max_added_tokens: int = 2000
    max_tokens_per_unit: int = 2048
    dedupe: bool = True
    separator: str = "\n\n"

    def __post_init__(self) -> None:
        if self.mode not in ("none", "parent", "ancestors", "siblings", "subtree", "reference_edges", "auto_merge"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.min_siblings < 1 or self.max_added_tokens < 0 or self.max_tokens_per_unit < 1:
            raise ValueError("policy out of range")


def measured(node_rows: DataFrame) -> DataFrame:
    """Nodes with ``unit, words, chars``: what a tree needs of their texts."""
    rows = node_rows.withColumn("unit", (F.col("text") != "") & ~F.coalesce(F.col("kind") == "root", F.lit(False)))
    return rows.withColumn("words", n_words(F.col("text"))).withColumn("chars", n_chars(F.col("text")))


def tree(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Nodes with ``parent_id, weight`` (of the best edge up), ``depth`` and ``chain``.

    Links are array elements ``id, up`` (weight of the edge to its parent), ``words, chars, heading, unit``; they hold what
    decisions need and no texts, which are joined once the members of a unit are known.  A node that reaches no root has a
    chain of itself alone.  Nodes that are :func:`measured` need no texts.
    """
    rows = node_rows.join(best_parents(edge_rows), ID, "left")
    rows = cut(rows if "words" in rows.columns else measured(rows))
    h = hierarchy(rows, "document_id", "node_id", "parent_id").select(F.col("group").alias("document_id"), F.col("node").alias("node_id"), "depth", F.coalesce("path", F.array("node")).alias("path"))
    steps = h.select("document_id", "node_id", "depth", F.posexplode(F.reverse("path")).alias("far", "link_id"))
    link = rows.select("document_id", F.col("node_id").alias("link_id"), F.struct(F.col("node_id").alias("id"), F.col("weight").alias("up"), "words", "chars", is_heading(F.col("level_label")).alias("heading"), "unit").alias("link"))
    chains = steps.join(link, ["document_id", "link_id"]).groupBy(*ID).agg(F.max("depth").alias("depth"), F.array_sort(F.collect_list(F.struct("far", "link"))).alias("c"))
    return rows.drop("words", "chars", "unit").join(chains.select(*ID, "depth", F.transform("c", lambda x: x["link"]).alias("chain")), ID)


def ancestors(tree_rows: DataFrame) -> DataFrame:
    """``document_id, node_id, ancestor_id, distance, cumulative`` (product of the weights between)."""
    far = tree_rows.select(*ID, "chain", F.posexplode("chain").alias("distance", "link")).where("distance > 0")
    product = F.aggregate(F.slice("chain", 1, F.col("distance")), F.lit(1.0), lambda s, x: s * F.coalesce(x["up"], F.lit(1.0)))
    return far.select(*ID, F.col("link.id").alias("ancestor_id"), "distance", product.alias("cumulative"))


def _tokens(words: Column, chars: Column, parts: Column, separator: str) -> Column:
    """Tokens of ``parts`` texts joined by white space, from sums over them."""
    return token_count(words, chars + len(separator) * F.greatest(parts - 1, F.lit(0)))


def _gate(chain: Column, threshold: Column, policy: MergePolicy) -> Column:
    """How many ancestors the weights let in; the first that fails stops the walk."""
    ups = F.slice(chain, 1, F.size(chain) - 1)
    if policy.strategy == "none":
        return F.lit(0)
    if policy.strategy == "all_ancestors":
        return F.size(ups)
    walk = F.aggregate(
        ups, F.struct(F.lit(0).alias("n"), F.lit(1.0).alias("cum"), F.lit(True).alias("go")),
        lambda s, x: F.struct(
            F.when(s["go"] & (x["up"] >= threshold) & (s["cum"] * x["up"] >= policy.min_cumulative), s["n"] + 1).otherwise(s["n"]).alias("n"),
            (s["cum"] * x["up"]).alias("cum"),
            (s["go"] & (x["up"] >= threshold) & (s["cum"] * x["up"] >= policy.min_cumulative)).alias("go"),
        ),
    )
    return walk["n"]


def _fit(chain: Column, n: Column, own_words: Column, own_chars: Column, own_parts: Column, policy: MergePolicy) -> Column:
    """Struct of how many of the first ``n`` ancestors fit the budget, nearest first, and the tokens of the unit."""
    start = _tokens(own_words, own_chars, own_parts, policy.separator)
    zero = F.struct(
        F.lit(0).alias("n"), own_words.cast("long").alias("w"), own_chars.cast("long").alias("c"), own_parts.cast("int").alias("k"),
        (start <= policy.max_tokens).alias("go"), start.alias("tokens"),
    )

    def step(s: Column, x: Column) -> Column:
        w, c = (s["w"] + x["words"]).cast("long"), (s["c"] + x["chars"]).cast("long")
        k = (s["k"] + F.when(x["chars"] > 0, 1).otherwise(0)).cast("int")
        t = _tokens(w, c, k, policy.separator)
        ok = s["go"] & (t <= policy.max_tokens)
        return F.struct(
            F.when(ok, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(ok, w).otherwise(s["w"]).alias("w"), F.when(ok, c).otherwise(s["c"]).alias("c"),
            F.when(ok, k).otherwise(s["k"]).alias("k"), ok.alias("go"), F.when(ok, t).otherwise(s["tokens"]).alias("tokens"),
        )

    return F.aggregate(F.slice(chain, 2, n), zero, step)


def _hosts(tree_rows: DataFrame, policy: MergePolicy) -> DataFrame:
    """Nodes too small for a unit, with the nearest ancestor that stands as one."""
    size = lambda x: token_count(x["words"], x["chars"])
    up = F.reverse(F.filter(F.slice("chain", 2, F.size("chain")), lambda x: x["unit"]))
    host = F.aggregate(up, F.lit(None).cast("string"), lambda s, x: F.when(s.isNull() | (size(x) >= policy.min_tokens), x["id"]).otherwise(s))
    own = F.col("chain")[0]
    return tree_rows.where(own["unit"] & (size(own) < policy.min_tokens)).select(*ID, "seq", own["words"].alias("words"), own["chars"].alias("chars"), host.alias("host")).where("host is not null")


def _with_tails(tree_rows: DataFrame, policy: MergePolicy) -> DataFrame:
    """Unit nodes with the small ones folded into them: ``tail`` (ids, in reading order), their words and characters."""
    units = tree_rows.where(F.col("chain")[0]["unit"])
    none = F.array().cast("array<string>")
    if policy.min_tokens <= 0:
        return units.withColumns({"tail": none, "tail_words": F.lit(0), "tail_chars": F.lit(0)})
    hosts = _hosts(tree_rows, policy)
    tails = hosts.groupBy("document_id", F.col("host").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("t"), F.sum("words").alias("w"), F.sum("chars").alias("c"))
    rows = units.join(hosts.select(*ID), ID, "left_anti").join(tails, ID, "left")
    return rows.select(*units.columns, F.coalesce(F.transform("t", lambda x: x["node_id"]), none).alias("tail"), F.coalesce("w", F.lit(0)).alias("tail_words"), F.coalesce("c", F.lit(0)).alias("tail_chars"))


def _fitted(rows: DataFrame, threshold: Column, policy: MergePolicy) -> DataFrame:
    own = F.col("chain")[0]
    n = _gate(F.col("chain"), threshold, policy)
    return rows.withColumn("fit", _fit(F.col("chain"), n, own["words"] + F.col("tail_words"), own["chars"] + F.col("tail_chars"), 1 + F.size("tail"), policy))


def crumbs(chain: Column) -> Column:
    """Ids of the headings above a node that have a text, outermost first."""
    up = F.filter(F.slice(chain, 2, F.size(chain)), lambda x: x["heading"] & (x["chars"] > 0))
    return F.reverse(F.transform(up, lambda x: x["id"]))


def with_texts(units: DataFrame, tree_rows: DataFrame, separator: str) -> DataFrame:
    """Units (``member_ids`` and ``crumb_ids`` in order) with ``text, breadcrumb, pages`` and ``page_no`` (the first).

    Only what a unit is made of is looked up; ``pages`` are the distinct pages of its members with a text, in order, or that of
    its own node if none has one.
    """
    parts = F.concat(F.transform("member_ids", lambda x: F.struct(F.lit(0).alias("k"), x.alias("node_id"))), F.transform("crumb_ids", lambda x: F.struct(F.lit(1).alias("k"), x.alias("node_id"))))
    keys = [c for c in ("query_id",) if c in units.columns] + ["document_id", "unit_id"]
    named = units.select(*keys, F.posexplode(parts).alias("at", "p")).select(*keys, "at", "p.k", "p.node_id")
    texts = tree_rows.select(*ID, "text", "page_no")
    found = named.join(texts, ID).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "k", "text", "page_no", "node_id"))).alias("m"))
    of = lambda k: F.filter("m", lambda x: (x["k"] == k) & (x["text"] != ""))
    text = F.array_join(F.transform(of(0), lambda x: x["text"]), separator)
    pages = F.array_distinct(F.filter(F.transform(F.filter("m", lambda x: (x["k"] == 0) & ((x["text"] != "") | (x["node_id"] == F.col("unit_id")))), lambda x: x["page_no"]), lambda x: x.isNotNull()))
    found = found.select(*keys, text.alias("text"), F.transform(of(1), lambda x: x["text"]).alias("breadcrumb"), pages.alias("pages"), F.get(pages, F.lit(0)).alias("page_no"))
    return units.drop("crumb_ids").join(found, keys)


def merge_units(tree_rows: DataFrame, policy: MergePolicy | None = None) -> DataFrame:
    """Units of all documents: ``document_id, unit_id, seq, text, member_ids, breadcrumb, token_count, pages, page_no,
    node_type, merged`` (the links taken: parent, child, weight, cumulative).

    No text is lost: every non-blank node is in some unit.  A unit passes the budget only by its own text.
    """
    policy = policy or MergePolicy()
    return with_texts(bare_units(tree_rows, policy), tree_rows, policy.separator).select("document_id", "unit_id", "seq", "text", "member_ids", "breadcrumb", "token_count", "pages", "page_no", "node_type", "merged")


def bare_units(tree_rows: DataFrame, policy: MergePolicy) -> DataFrame:
    """Units without their texts: what they are made of, and how large they are."""
    return _subtrees(tree_rows, policy) if policy.strategy == "subtree" else _merged(tree_rows, policy)


_LINKS = "array<struct<parent:string,child:string,weight:double,cumulative:double>>"


def _taken(chain: Column, n: Column) -> Column:
    """The first ``n`` links up from a node, nearest first, with the product of the weights up to each."""
    start = F.struct(F.lit(1.0).alias("cum"), F.array().cast(_LINKS).alias("out"))

    def step(s: Column, i: Column) -> Column:
        link = chain[i]
        cum = s["cum"] * link["up"]
        new = F.struct(chain[i + 1]["id"].alias("parent"), link["id"].alias("child"), link["up"].alias("weight"), cum.alias("cumulative"))
        return F.struct(cum.alias("cum"), F.concat(s["out"], F.array(new)).alias("out"))

    return F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), start, step)["out"]


def _merged(tree_rows: DataFrame, policy: MergePolicy) -> DataFrame:
    rows = _fitted(_with_tails(tree_rows, policy), F.lit(policy.min_weight), policy)
    taken = F.reverse(F.slice("chain", 2, F.col("fit.n")))
    return rows.select(
        "document_id", F.col("node_id").alias("unit_id"), "seq", F.concat(F.transform(taken, lambda x: x["id"]), F.array("node_id"), "tail").alias("member_ids"),
        crumbs(F.col("chain")).alias("crumb_ids"), F.col("fit.tokens").alias("token_count"), F.col("kind").alias("node_type"), _taken(F.col("chain"), F.col("fit.n")).alias("merged"),
    )


def _subtrees(tree_rows: DataFrame, policy: MergePolicy) -> DataFrame:
    folded = _hosts(tree_rows, policy).select(*ID) if policy.min_tokens > 0 else None
    own = F.col("chain")[0]
    units = tree_rows.where(own["unit"])
    standing = units if folded is None else units.join(folded, ID, "left_anti")
    flat = units.select(*ID, "seq", own["words"].alias("words"), own["chars"].alias("chars"), F.transform("chain", lambda x: x["id"]).alias("line"))
    heads = standing.where(own["heading"]).select("document_id", F.col("node_id").alias("head"))
    under = flat.select("*", F.posexplode("line").alias("far", "head")).drop("line").join(heads, ["document_id", "head"])
    order = Window.partitionBy("document_id", "head").orderBy(F.col("far") > 0, "seq", "node_id")
    # Every node has a token or more, so what comes after max_tokens rows can't fit; the window drops it before the shuffle.
    under = under.withColumn("at", F.row_number().over(order)).where(F.col("at") <= policy.max_tokens + 1)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = under.withColumn("t", _tokens(F.sum("words").over(run), F.sum("chars").over(run), F.count("*").over(run), policy.separator))
    # The first that doesn't fit stops the walk; the heading itself always stays.
    stopped = F.max(F.when((F.col("t") > policy.max_tokens) & (F.col("at") > 1), 1).otherwise(0)).over(run)
    carried = cut(sums.withColumn("stopped", stopped).where("stopped = 0").select(*ID, "head", "at", "t"))
    made = carried.groupBy("document_id", F.col("head").alias("unit_id")).agg(F.array_sort(F.collect_list(F.struct("at", "node_id"))).alias("m"), F.max("t").alias("token_count"))
    made = made.select("document_id", "unit_id", F.transform("m", lambda x: x["node_id"]).alias("member_ids"), "token_count")
    done = carried.select(*ID).distinct()
    # What no heading carries stands alone, with the small nodes that belong to it; so do small ones whose host is gone.
    alone = _with_tails(tree_rows, policy).join(done, ID, "left_anti")
    if folded is not None:
        hosts = _hosts(tree_rows, policy).join(done, ID, "left_anti")
        stray = hosts.join(alone.select("document_id", F.col("node_id").alias("host")), ["document_id", "host"], "left_anti").select(*ID)
        alone = alone.unionByName(_with_tails(units.join(stray, ID, "left_semi"), replace(policy, min_tokens=0)))
    free = replace(policy, strategy="none", max_tokens=2**31 - 1)
    rest = _fitted(alone, F.lit(0.0), free).select("document_id", F.col("node_id").alias("unit_id"), F.concat(F.array("node_id"), "tail").alias("member_ids"), F.col("fit.tokens").alias("token_count"))
    above = tree_rows.select("document_id", F.col("node_id").alias("unit_id"), "seq", crumbs(F.col("chain")).alias("crumb_ids"), F.col("kind").alias("node_type"))
    none = F.array().cast(_LINKS).alias("merged")
    return made.unionByName(rest).join(above, ["document_id", "unit_id"]).select("document_id", "unit_id", "seq", "member_ids", "crumb_ids", "token_count", "node_type", none)


def mean_unit_tokens(units: DataFrame) -> DataFrame:
    """One row: units and their mean size, 0 if there are none."""
    return units.agg(F.count("*").alias("units"), F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("mean_tokens"))


@dataclass(frozen=True)
class Calibration:
    min_weight: float
    target: float
    achieved: float
    evaluated: int
    exhaustive: bool

    @property
    def relative_error(self) -> float:
        return (self.achieved - self.target) / self.target if self.target else 0.0

    def within(self, tolerance: float = 0.02) -> bool:
        return abs(self.relative_error) <= tolerance


def _sizing(tree_rows: DataFrame, policy: MergePolicy) -> DataFrame:
    """What sizes of units depend on, and nothing else."""
    return _with_tails(tree_rows, policy).select("chain", "tail", "tail_words", "tail_chars")


def means_at(sizing: DataFrame, thresholds: list[float], policy: MergePolicy) -> DataFrame:
    """``min_weight, units, mean_tokens`` of every threshold in one pass over :func:`_sizing` or a tree."""
    if "node_id" in sizing.columns:
        sizing = _sizing(sizing, policy)
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    sized = _fitted(sizing.select("*", grid), F.col("threshold"), policy)
    return sized.groupBy(F.col("threshold").alias("min_weight")).agg(F.count("*").alias("units"), F.avg("fit.tokens").alias("mean_tokens"))


def merge_steps(tree_rows: DataFrame, policy: MergePolicy | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """What thresholds do to all units of a tree at once: ``weight, tokens, units, merged`` for each weight.

    A threshold lets in what stands at its weight or above: tokens that ancestors add to units, and units that get more than
    one node by it.  What units have by themselves stands at infinity with their number, what fits but is kept out by its
    weights alone at minus infinity.  So sizes at any threshold are sums over few numbers; ``by`` are columns to tell trees apart.
    """
    policy = replace(policy or MergePolicy(), strategy="weighted")
    chain, own, folded = F.col("chain"), F.col("chain")[0], F.size("tail")
    w, c, k = (own["words"] + F.col("tail_words")).cast("long"), (own["chars"] + F.col("tail_chars")).cast("long"), (1 + folded).cast("int")
    start = _tokens(w, c, k, policy.separator)
    row = lambda weight, tokens, units, merged: F.struct(weight.cast("double").alias("weight"), tokens.alias("tokens"), units.cast("long").alias("units"), merged.cast("long").alias("merged"))
    zero = F.struct(
        w.alias("w"), c.alias("c"), k.alias("k"), (start <= policy.max_tokens).alias("fits"), F.lit(True).alias("go"), start.alias("tokens"), F.lit(1.0).alias("cum"),
        F.lit(float("inf")).alias("least"), F.array(row(F.lit(float("inf")), start, F.lit(1), (folded > 0).cast("int"))).alias("out"),
    )

    def step(s: Column, x: Column) -> Column:
        w, c = s["w"] + x["words"], s["c"] + x["chars"]
        k = (s["k"] + F.when(x["chars"] > 0, 1).otherwise(0)).cast("int")
        t, cum = _tokens(w, c, k, policy.separator), F.coalesce(s["cum"] * x["up"], F.lit(float("-inf")))
        go, least = s["go"] & (cum >= policy.min_cumulative), F.least(s["least"], x["up"])
        new = row(F.when(go, least).otherwise(float("-inf")), t - s["tokens"], F.lit(0), F.when((F.size(s["out"]) == 1) & (folded == 0), 1).otherwise(0))
        fits = s["fits"] & (t <= policy.max_tokens)
        return F.struct(
            w.alias("w"), c.alias("c"), k.alias("k"), fits.alias("fits"), go.alias("go"), t.alias("tokens"), cum.alias("cum"), least.alias("least"),
            F.when(fits, F.concat(s["out"], F.array(new))).otherwise(s["out"]).alias("out"),
        )

    links = F.zip_with(F.slice(chain, 1, F.size(chain) - 1), F.slice(chain, 2, F.size(chain) - 1), lambda x, up: F.struct(x["up"].alias("up"), up["words"].alias("words"), up["chars"].alias("chars")))
    rows = _with_tails(tree_rows, policy).select(*by, F.inline(F.aggregate(links, zero, step)["out"]))
    return rows.groupBy(*by, "weight").agg(*[F.sum(x).alias(x) for x in ("tokens", "units", "merged")])


def calibrate(tree_rows: DataFrame, edge_rows: DataFrame, target: float, policy: MergePolicy | None = None, *, exhaustive_below: int = 64, iterations: int = 24) -> Calibration:
    """The min_weight whose units come nearest to a mean of ``target`` tokens.

    With few distinct weights all are tried in one job, with many the threshold is bisected, three steps a job; both over
    :func:`merge_steps`, which may be given in place of a tree.  The first that is strictly better wins, beginning with 0.
    """
    if target <= 0:
        raise ValueError("the target must be positive")
    policy = replace(policy or MergePolicy(), strategy="weighted")
    weights = [r.weight for r in edge_rows.select("weight").distinct().orderBy("weight").limit(exhaustive_below + 1).collect()]
    exhaustive = len(weights) <= exhaustive_below
    rows = tree_rows if "tokens" in tree_rows.columns else stored(merge_steps(tree_rows, policy))
    best, tried = (0.0, 0.0, float("inf")), 0

    def means(thresholds: list[float]) -> dict[float, float]:
        units, *sums = rows.agg(F.sum("units"), *[F.sum(F.when(F.col("weight") >= t, F.col("tokens"))) for t in thresholds]).first()
        return {t: x / units for t, x in zip(thresholds, sums)} if units else {}

    def consider(t: float, mean: float) -> None:
        nonlocal best, tried
        tried += 1
        if abs(mean - target) < best[2]:
            best = (t, mean, abs(mean - target))

    if exhaustive:
        grid = list(dict.fromkeys([0.0, *weights, min(1.0, weights[-1] + 1e-9) if weights else 1.0]))
        got = means(grid)
        for t in grid:
            consider(t, got.get(t, 0.0))
    else:
        low, high, left = 0.0, 1.0, iterations
        consider(0.0, means([0.0]).get(0.0, 0.0))
        while left > 0:
            ahead = [low + (high - low) * i / 8 for i in range(1, 8)]
            got = means(ahead)
            at, step = 3, 2
            for _ in range(min(3, left)):
                mean = got.get(ahead[at], 0.0)
                consider(ahead[at], mean)
                low, high = (ahead[at], high) if mean > target else (low, ahead[at])
                at, step = (at + step if mean > target else at - step), step // 2
            left -= 3
    return Calibration(best[0], target, best[1], tried, exhaustive)


# --- growing hits -------------------------------------------------------------


def _candidates(hits: DataFrame, tree_rows: DataFrame, policy: ExpansionPolicy, reference_rows: DataFrame | None) -> DataFrame:
    """What a mode may add to each hit: ``document_id, query_id, node_id, member, rank`` (nearest or first first)."""
    known = hits.join(tree_rows.select(*ID, "seq", "parent_id", "weight", "chain"), ID)
    keys = ["document_id", "query_id", "node_id"]
    if policy.mode == "parent":
        return known.where((F.col("parent_id").isNotNull()) & (F.col("weight") >= policy.min_edge_weight)).select(*keys, F.col("parent_id").alias("member"), F.lit(0).alias("rank"))
    if policy.mode == "ancestors":
        far = known.select(*keys, "chain", F.posexplode("chain").alias("rank", "link")).where("rank > 0")
        weight = F.element_at("chain", F.col("rank"))["up"]
        return far.where(weight >= policy.min_edge_weight).select(*keys, F.col("link.id").alias("member"), "rank")
    place = tree_rows.select("document_id", F.col("node_id").alias("member"), F.col("parent_id").alias("p"), F.col("seq").alias("m_seq"))
    by_order = Window.partitionBy(*keys).orderBy("m_seq", "member")
    if policy.mode == "siblings":
        rows = known.join(place.withColumnRenamed("p", "parent_id"), ["document_id", "parent_id"]).where("member <> node_id")
        return rows.select(*keys, "member", F.row_number().over(by_order).alias("rank"))
    if policy.mode == "subtree":
        # Only documents with hits are unfolded.
        asked = tree_rows.join(hits.select("document_id").distinct(), "document_id", "left_semi")
        down = asked.select("document_id", F.col("node_id").alias("member"), F.explode(F.transform(F.slice("chain", 2, F.size("chain")), lambda x: x["id"])).alias("node_id"))
        rows = hits.join(down, ID).join(place, ["document_id", "member"])
        return rows.select(*keys, "member", F.row_number().over(by_order).alias("rank"))
    if policy.mode == "reference_edges" and reference_rows is not None:
        both = reference_rows.select("document_id", F.col("parent_id").alias("node_id"), F.col("child_id").alias("member")).unionByName(reference_rows.select("document_id", F.col("child_id").alias("node_id"), F.col("parent_id").alias("member")))
        rows = hits.join(both.distinct(), ID).join(place, ["document_id", "member"])
        return rows.select(*keys, "member", F.row_number().over(by_order).alias("rank"))
    return hits.select(*keys, F.lit(None).cast("string").alias("member"), F.lit(0).alias("rank")).limit(0)


_HIT = "query_id string, document_id string, unit_id string, hit_id string, score double, reason string, member_ids array<string>, absorbed_ids array<string>, added_tokens int, token_count int"


def expand(hits: DataFrame, tree_rows: DataFrame, policy: ExpansionPolicy | None = None, reference_rows: DataFrame | None = None) -> DataFrame:
    """Units grown from the hits (``query_id, document_id, node_id, score``) of each query in each document.

    Hits that aren't nodes are left out; repeated ones keep the best score.  Hits are served by score, ties by id, from one
    budget of added tokens; what doesn't fit is returned bare.  Auto-merge puts a parent in the place of enough of its
    children; with ``dedupe`` off every hit comes bare.  Ancestors read outermost first and the nearest are kept when the
    budget is short.  Candidates beyond the budget of a hit are cut off before they are gathered, so a group holds no more
    than its hits and what they may add.  Units have ``hit_id`` (the hit they came from), ``text, breadcrumb, token_count,
    pages`` and ``page_no``.
    """
    policy = policy or ExpansionPolicy()
    known = hits.groupBy("query_id", *ID).agg(F.max("score").alias("score")).join(tree_rows.select(*ID), ID)
    size = tree_rows.select("document_id", F.col("node_id").alias("member"), F.col("seq").alias("m_seq"), F.col("chain")[0]["words"].alias("words"), F.col("chain")[0]["chars"].alias("chars"))
    if policy.mode == "auto_merge":
        up = known.join(tree_rows.select(*ID, "parent_id", "weight"), ID).where((F.col("parent_id").isNotNull()) & (F.col("weight") >= policy.min_edge_weight))
        hit_ids = known.select("query_id", "document_id", F.col("node_id").alias("parent_id"))
        up = up.join(hit_ids, ["query_id", "document_id", "parent_id"], "left_anti")
        enough = up.groupBy("query_id", "document_id", "parent_id").agg(F.count("*").alias("n")).where(F.col("n") >= policy.min_siblings)
        asked = up.join(enough, ["query_id", "document_id", "parent_id"]).select("document_id", "query_id", "node_id", F.col("parent_id").alias("member"), F.lit(0).alias("rank"))
    else:
        asked = _candidates(known, tree_rows, policy, reference_rows)
    sized = asked.join(size, ["document_id", "member"])
    run = Window.partitionBy("document_id", "query_id", "node_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    before = {c: F.coalesce(F.sum(c).over(run), F.lit(0)) for c in ("words", "chars")}
    sized = sized.join(size.select("document_id", F.col("member").alias("node_id"), F.col("words").alias("own_words"), F.col("chars").alias("own_chars")), ID)
    # The joined cost of those before, separators aside, is never more than what the walk finds; the walk decides.
    least = token_count(F.col("own_words") + before["words"], F.col("own_chars") + before["chars"]) - token_count(F.col("own_words"), F.col("own_chars"))
    sized = sized.withColumn("least", least).where(F.col("least") <= policy.max_added_tokens)
    own = known.join(size.withColumnRenamed("member", "node_id"), ID).select("query_id", *ID, "score", F.lit(None).cast("string").alias("member"), F.lit(-1).alias("rank"), "m_seq", "words", "chars")
    rows = own.unionByName(sized.join(known, ["query_id", *ID]).select("query_id", *ID, "score", "member", "rank", "m_seq", "words", "chars"))
    gap, mode = len(policy.separator), policy.mode

    def cost(parts: list[tuple[int, int]]) -> int:
        full = [p for p in parts if p[1]]
        return max(sum(w for w, _ in full), (sum(c for _, c in full) + gap * max(0, len(full) - 1)) // 4)

    def serve(group: pd.DataFrame) -> pd.DataFrame:
        info = {r.node_id: (r.m_seq, r.words, r.chars, r.score) for r in group[group["rank"] == -1].itertuples()}
        extra: dict[str, list] = {}
        for r in group[group["rank"] >= 0].sort_values(["node_id", "rank", "member"]).itertuples():
            extra.setdefault(r.node_id, []).append((r.member, r.m_seq, r.words, r.chars))
        budget, out, done = policy.max_added_tokens, [], set()
        wards: dict[str, list[str]] = {}
        if mode == "auto_merge" and policy.dedupe:
            for node, items in extra.items():
                wards.setdefault(items[0][0], []).append(node)
        query, document = group["query_id"].iloc[0], group["document_id"].iloc[0]
        for node in sorted(info, key=lambda x: (-info[x][3], x)):
            seq, words, chars, score = info[node]
            bare = (query, document, node, node, score, "hit", [node], [], 0, cost([(words, chars)]))
            if mode == "auto_merge":
                host = extra[node][0] if node in extra and policy.dedupe else None
                if host is None:
                    out.append(bare)
                    continue
                if host[0] in done:
                    continue
                children = sorted(wards[host[0]], key=lambda x: (info[x][0], x))
                base, taken = cost([(host[2], host[3])]), []
                added = 0
                for child in children:
                    trial = cost([(host[2], host[3]), *[(info[x][1], info[x][2]) for x in [*taken, child]]])
                    if trial > policy.max_tokens_per_unit or trial - base > budget:
                        break
                    taken, added = [*taken, child], trial - base
                if not taken:
                    out.append(bare)
                    continue
                done.add(host[0])
                budget -= added
                members = sorted([(host[1], host[0]), *[(info[x][0], x) for x in taken]])
                out.append((query, document, host[0], node, max(info[x][3] for x in children), "auto_merge", [m for _, m in members], [c for c in children if c != node], added, base + added))
                continue
            base, taken, added = cost([(words, chars)]), [], 0
            for item in extra.get(node, []):
                trial = cost([(words, chars), *[(x[2], x[3]) for x in [*taken, item]]])
                if trial > policy.max_tokens_per_unit or trial - base > budget:
                    break
                taken, added = [*taken, item], trial - base
            if not taken:
                out.append(bare)
                continue
            budget -= added
            if mode in ("parent", "ancestors"):
                members = [x[0] for x in reversed(taken)] + [node]
            else:
                members = [m for _, m in sorted([(seq, node), *[(x[1], x[0]) for x in taken]])]
            out.append((query, document, node, node, score, mode, members, [], added, base + added))
        return pd.DataFrame(out, columns=["query_id", "document_id", "unit_id", "hit_id", "score", "reason", "member_ids", "absorbed_ids", "added_tokens", "token_count"])

    served = rows.groupBy("query_id", "document_id").applyInPandas(serve, _HIT)
    above = tree_rows.select("document_id", F.col("node_id").alias("unit_id"), crumbs(F.col("chain")).alias("crumb_ids"))
    return with_texts(served.join(above, ["document_id", "unit_id"]), tree_rows, policy.separator)
