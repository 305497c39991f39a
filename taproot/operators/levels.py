"""Levels of headings and texts from their type: fonts and line heights of a document.

Headings of a font are clustered by height, largest first; font and cluster make a style.  Styles are ranked by which
encloses which in reading order, and by size where they don't nest; their levels are the longest chains of that order.
Texts get the levels below the headings by how their heights lie to those of all lines.

Only counts leave the rows: first and last place and number of each style, how many headings of a style lie between two
such places, and how often each height comes.  They are combined where they are, so what is gathered for a document is as
small as its styles and heights, however many items it has.
"""

from __future__ import annotations

from statistics import median

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproot.plans.grouping import Row, by_document
from taproot.plans.lineage import stored

# A height is smaller if it differs by more than this many points and this share of the larger.
STEP_POINTS, STEP_SHARE = 1.5, 0.10
# What a smaller style needs to stand above a larger one: evidence, how many times that of the reverse,
# sections, and the share of the larger one's headings inside them.
OVERRIDE_EVIDENCE, OVERRIDE_RATIO, OVERRIDE_SECTIONS, OVERRIDE_SHARE = 0.5, 5.0, 3, 0.7
#: Where levels come from: type and nesting, type alone, or the levels that the items bring along.
SOURCES = ("hybrid", "typography", "given")
#: Level of a text without line heights.
UNKNOWN = 1000


def median_height(heights: Column) -> Column:
    """Median of the line heights, null without any."""
    s = F.array_sort(F.filter(heights, lambda x: x.isNotNull()))
    n = F.size(s)
    mid = F.floor(n / 2).cast("int")
    return F.when(n > 0, F.when(n % 2 == 1, F.get(s, mid)).otherwise((F.get(s, mid - 1) + F.get(s, mid)) / 2))


def is_step(larger: float, smaller: float) -> bool:
    return larger - smaller > max(STEP_POINTS, STEP_SHARE * larger)


def clusters(heights: list[float]) -> list[list[float]]:
    """Distinct heights in clusters, largest first; each is compared with the first of its cluster."""
    out: list[list[float]] = []
    for h in sorted(set(heights), reverse=True):
        if out and not is_step(out[-1][0], h):
            out[-1].append(h)
        else:
            out.append([h])
    return out


def break_cycles(order: dict[tuple[int, int], tuple]) -> dict[tuple[int, int], tuple]:
    """An order of pairs (above, below) with their confidence, less the weakest pair of each cycle."""
    order = dict(order)
    while True:
        down: dict[int, list[int]] = {}
        for a, b in order:
            down.setdefault(a, []).append(b)
        state: dict[int, int] = {}
        ring: list[tuple[int, int]] = []

        def visit(x: int, path: list[int]) -> bool:
            state[x] = 1
            for y in down.get(x, ()):
                if state.get(y) == 1:
                    way = [*path[path.index(y) :], y]
                    ring.extend(zip(way, way[1:]))
                    return True
                if y not in state and visit(y, [*path, y]):
                    return True
            state[x] = 2
            return False

        if not any(x not in state and visit(x, [x]) for x in list(down)):
            return order
        del order[min(ring, key=order.__getitem__)]


def rank_styles(size: list[float], count: list[int], first: list, inside: dict[tuple[int, int], int], source: str = "hybrid") -> list[int]:
    """Level of each style, from 0.  ``inside[a, b]`` headings of b stand between the first and the last of a."""
    n = len(size)

    def evidence(a: int, b: int) -> float:
        sections, held = count[a] - 1, inside.get((a, b), 0)
        return (held / sections) * (held / count[b]) if sections >= 1 else 0.0

    order: dict[tuple[int, int], tuple] = {}
    for a in range(n):
        for b in range(a + 1, n):
            tall, short = (a, b) if size[a] >= size[b] else (b, a)
            step = is_step(size[tall], size[short])
            if source == "typography":
                if step:
                    order[tall, short] = (False, size[tall] - size[short])
                continue
            if step:
                over = (
                    count[short] - 1 >= OVERRIDE_SECTIONS and inside.get((short, tall), 0) / count[tall] >= OVERRIDE_SHARE
                    and evidence(short, tall) >= OVERRIDE_EVIDENCE and evidence(short, tall) > OVERRIDE_RATIO * evidence(tall, short)
                )
                above, below = (short, tall) if over else (tall, short)
            else:
                nested = [(p, c) for p, c in ((a, b), (b, a)) if first[p] < first[c] and evidence(p, c) > 0]
                if not nested:
                    continue
                above, below = max(nested, key=lambda x: evidence(*x))
            margin = evidence(above, below) - evidence(below, above)
            order[above, below] = (True, margin) if margin > 0 else (False, size[tall] - size[short])
    order = break_cycles(order)
    level = [0] * n
    for _ in range(n):
        for a, b in order:
            level[b] = max(level[b], level[a] + 1)
    return level


def _styled(headings: DataFrame) -> DataFrame:
    """Headings with the ``font, size`` of their style; a null size has no style.

    Clusters are made of all heights of a font, to a tenth.  Where no heading of a document has a font all share one;
    where some have, those without have no style.  A heading whose height is unknown belongs to the smallest style of its
    font, as its height counts as 0.
    """
    rows = headings.withColumn("height", F.coalesce(median_height(F.col("line_heights")), F.lit(0.0))).withColumn("tenth", F.round("height", 1))
    met = rows.groupBy("document_id", "font_key", "tenth").agg(F.count("*").alias("n"))

    def cluster(document: str, own: list[Row]) -> list[tuple]:
        fonts: dict[str, list[float]] = {}
        use = any(isinstance(r.font_key, str) for r in own)
        for r in own:
            if not use or isinstance(r.font_key, str):
                fonts.setdefault(r.font_key if use else "", []).append(r.tenth)
        out = []
        for font, heights in fonts.items():
            made = clusters([h for h in heights if h > 0])
            sizes = [median(c) for c in made]
            for h in set(heights):
                own_size = next((s for s, c in zip(sizes, made) if h in c), min(sizes, key=lambda s: abs(s - h), default=None))
                out.append((document, font, h, own_size))
        return out

    made = by_document(met, cluster, "document_id string, font string, tenth double, size double")
    fonts = met.groupBy("document_id").agg(F.max("font_key").isNotNull().alias("use"))
    rows = rows.join(fonts, "document_id").withColumn("font", F.when(F.col("use"), F.col("font_key")).otherwise(F.lit("")))
    return rows.drop("use").join(made, ["document_id", "font", "tenth"], "left")


def heading_styles(headings: DataFrame, source: str = "hybrid") -> DataFrame:
    """``document_id, font, size, n, level``: the styles of the body's headings and their levels, from 0.

    ``headings`` have ``document_id, node_id, seq, region, font_key, line_heights``.  Headings outside the body help to
    make the clusters, but aren't ranked.
    """
    rows = _styled(headings).where("size is not null and region = 'body'").select("document_id", "font", "size", F.struct("seq", "node_id").alias("at"))
    return _ranked(rows, source)


def _ranked(rows: DataFrame, source: str) -> DataFrame:
    styles = rows.groupBy("document_id", "font", "size").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    # Two places a style; each heading sends how many of them lie before it, and whether it is one of them.
    places = styles.groupBy("document_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("first", "last"))))).alias("places"))
    spot = rows.join(places, "document_id").select("document_id", "font", "size", F.size(F.filter("places", lambda x: x < F.col("at"))).alias("after"), F.array_contains("places", F.col("at")).alias("on"))
    spread = spot.groupBy("document_id", "font", "size", "after", "on").agg(F.count("*").alias("n"))
    spread = spread.groupBy("document_id", "font", "size").agg(F.collect_list(F.struct("after", "on", "n")).alias("spread"))
    at = lambda c: (F.array_position("places", F.col(c)) - 1).cast("int").alias(c)
    rows = styles.join(places, "document_id").select("document_id", "font", "size", "n", at("first"), at("last")).join(spread, ["document_id", "font", "size"])

    def rank(document: str, own: list[Row]) -> list[tuple]:
        own = sorted(own, key=lambda r: r.first)
        size, n, first, last = ([getattr(r, c) for r in own] for c in ("size", "n", "first", "last"))
        inside = {}
        for a in range(len(own)):
            for b, r in enumerate(own):
                # A heading on place k lies strictly after first if k > first, one between places k - 1 and k if k > first.
                held = sum(x["n"] for x in r.spread if x["after"] > first[a] and (x["after"] < last[a] if x["on"] else x["after"] <= last[a]))
                if a != b and held:
                    inside[a, b] = held
        return [(document, r.font, r.size, r.n, level) for r, level in zip(own, rank_styles(size, n, first, inside, source))]

    return by_document(rows, rank, "document_id string, font string, size double, n long, level int")


def _text_steps(document: str, own: list[Row]) -> list[tuple]:
    """Levels of the heights (in tenths) of a document's texts; rows: height, n (all items), texts (texts alone), deepest."""
    own = sorted(own, key=lambda r: r.tenth)
    height, n = np.array([r.tenth for r in own], float), np.array([r.n for r in own], np.int64)
    out = []

    def percentile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
        ends, at = np.cumsum(counts), q * (counts.sum() - 1)
        low, high = values[np.searchsorted(ends, np.floor(at), "right")], values[np.searchsorted(ends, np.ceil(at), "right")]
        return float(low + (high - low) * (at - np.floor(at)))

    body, spread = percentile(height, n, 0.5), percentile(height, n, 0.75) - percentile(height, n, 0.25)
    small = height < body - spread
    middle = percentile(height[small], n[small], 0.5) if small.any() else 0.0
    level, label = int(own[0].deepest), {}
    used = [(h, s) for h, s, t in zip(height[::-1], small[::-1], [r.texts for r in own[::-1]]) if t > 0]
    for h, under in used:
        if not under:
            label[level] = "Body"
            out.append((int(h), level))
    if any(under for _, under in used):
        level += 1
    for h, under in used:
        if under:
            if middle - spread <= h <= middle + spread:
                label[level] = "Subtext"
            else:
                level += 1
                label[level] = "Subsubtext"
            out.append((int(h), level))
    return [(document, h, x, label[x]) for h, x in out]


def classify(items: DataFrame, titles: DataFrame, source: str = "hybrid") -> DataFrame:
    """``document_id, node_id, level, level_label`` of every item.

    ``items`` have ``document_id, node_id, seq, heading`` (boolean), ``text, region, font_key, line_heights`` and, for
    the source given, ``given`` (levels from 1); ``titles`` have ``document_id, title``.  A heading that reads like its
    document's title is Title, of level 0.  Headings of the body get the levels of their styles; those of the front matter
    the top level, those of sidebars and figures one below the deepest.  A heading without a known style gets the level
    whose median size is nearest.  Texts come below all headings: the body's height and more, then what lies around the
    middle of the smaller ones, then each smaller step; a text's own median height takes the level of the nearest step.
    """
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    named = titles.groupBy("document_id").agg(F.max("title").alias("title"))
    items = stored(items)
    rows = items.join(named, "document_id", "left").withColumn("is_title", F.col("heading") & F.coalesce(F.col("text") == F.col("title"), F.lit(False)))
    top = rows.groupBy("document_id").agg(F.max(F.col("is_title").cast("int")).alias("start"))
    heads = rows.where("heading and not is_title").join(top, "document_id")
    if source == "given":
        heads = heads.withColumn("own", F.col("start") + F.greatest(F.coalesce("given", F.lit(1)) - 1, F.lit(0))).withColumn("size", median_height(F.col("line_heights")))
        styled = heads.groupBy("document_id", F.col("own").alias("level"), "size").agg(F.count("*").alias("n"))
    else:
        heads = stored(_styled(heads))
        body = heads.where("size is not null and region = 'body'").select("document_id", "font", "size", F.struct("seq", "node_id").alias("at"))
        styled = stored(_ranked(body, source).join(top, "document_id").withColumn("level", F.col("level") + F.col("start")).drop("start"))
        heads = heads.join(styled.select("document_id", "font", "size", F.col("level").alias("own")), ["document_id", "font", "size"], "left")
    # Levels in use, each with its middle size; a document has as many as its styles.
    sizes = styled.where("size > 0").groupBy("document_id", "level").agg(F.percentile("size", 0.5).alias("size"))
    tiers = sizes.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("level", "size"))).alias("tiers"))
    deepest = styled.groupBy("document_id").agg(F.max("level").alias("deepest"))
    frame = stored(top.join(deepest, "document_id", "left").join(tiers, "document_id", "left").select(
        "document_id", "start", F.when(F.col("deepest").isNotNull(), F.col("deepest") + 1).alias("aside"), "tiers"
    ))
    height = F.coalesce(median_height(F.col("line_heights")), F.lit(0.0))
    nearest = F.array_min(F.transform("tiers", lambda x: F.struct(F.abs(x["size"] - height).alias("gap"), x["level"].alias("level"))))["level"]
    fallback = F.coalesce(nearest, F.col("start"))
    # Without any ranked heading there is no outline to place the others by.
    outline = F.when(F.col("aside").isNotNull(), F.col("start")).otherwise(0)
    level = F.when(F.col("region") == "front_matter", outline).when(F.col("region").isin("sidebar", "figure"), F.coalesce("aside", F.lit(0))).otherwise(F.coalesce("own", fallback))
    headed = heads.drop("start").join(frame, "document_id").select("document_id", "node_id", level.cast("int").alias("level"), F.lit("Heading").alias("level_label"))
    title = rows.where("is_title").select("document_id", "node_id", F.lit(0).alias("level"), F.lit("Title").alias("level_label"))
    # Texts: all line heights of the document in tenths, with how many of them are those of texts.
    lines = rows.select("document_id", "heading", F.explode("line_heights").alias("h")).where("h is not null").groupBy("document_id", F.round(F.round("h", 1) * 10).cast("int").alias("tenth"))
    lines = lines.agg(F.count("*").alias("n"), F.count(F.when(~F.col("heading"), 1)).alias("texts"))
    lines = lines.join(frame.select("document_id", F.coalesce(F.col("aside") + 1, F.lit(1)).alias("deepest")), "document_id")
    steps = by_document(lines, _text_steps, "document_id string, step int, level int, level_label string")
    # Largest step first, as of equally near ones the larger counts.
    steps = steps.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("step", "level", "level_label")), False).alias("steps"))
    own = median_height(F.transform("line_heights", lambda x: F.floor(x * 10 + 1e-9).cast("double")))
    gap = F.transform("steps", lambda x: F.struct(F.abs(x["step"] - own).alias("gap"), (-x["step"]).alias("order"), x["level"].alias("level"), x["level_label"].alias("label")))
    best = F.when(own.isNotNull(), F.array_min(gap))
    plain = rows.where("not heading").join(steps, "document_id", "left").select("document_id", "node_id", F.coalesce(best["level"], F.lit(UNKNOWN)).alias("level"), F.coalesce(best["label"], F.lit("unknown")).alias("level_label"))
    return title.unionByName(headed).unionByName(plain)


def height_histogram(items: DataFrame) -> DataFrame:
    """How often each median height, to a tenth, comes in each document."""
    return items.select("document_id", F.round(median_height(F.col("line_heights")), 1).alias("height")).where("height is not null").groupBy("document_id", "height").agg(F.count("*").alias("n"))
