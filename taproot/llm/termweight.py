"""How distinctive a term is for a record: log-entropy weights by two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taproot.plans.lineage import stored

#: A word: a longest run of letters and marks of any script.
WORD = r"[\p{L}\p{M}]+"
#: A longest run of six or more Latin letters.
LATIN_6 = r"[A-Za-zÀ-ÖØ-öø-ÿ]{6,}"
#: Texts of a record from which it is split, and into how many parts the whole collection may be split for that.
HOT_TEXTS, PARTS = 5_000, 10_000
#: Terms that are looked up by broadcast, at most: those that stand in more than this share of all pairs.
HOT_TERMS = 10_000


def _log(x: Column) -> Column:
    return F.log(x)


def log_entropy(df: DataFrame, record: str, text: str, *, pattern: str = WORD, presence: bool = False) -> DataFrame:
    """Log-entropy weight of every term of every record; a record may consist of many rows (texts).

    Columns: the record, ``term`` (lower case), ``tf`` (times in the record), ``n_records`` (records that hold it),
    ``entropy`` (of its spread over the records, divided by the log of the number of records: 0 if one record has it all,
    1 if all have the same share), ``local`` = ln(1 + tf), ``spread`` = 1 - entropy and ``score`` = local x spread.  In a
    collection of one record the entropy is 0.  With ``presence`` tf is the number of the record's texts that hold the
    term, and all records that hold it have the same share of its spread.

    The texts' terms are brought together by record, a record of very many texts in parts, and counted where they are;
    only the counts of split records meet once more.  The second aggregation sums up each term's spread.  The few terms
    that stand in very many records get theirs by broadcast (at most ``HOT_TERMS`` rows), so no hot record or term is
    gathered in one task.  Rows with null records or texts have no terms, but a record with a null or empty text still
    counts as a record.  Repeated rows count as often as they come.  An empty table gives an empty table.
    """
    rows = df.select(F.col(record).alias("record"), F.col(text).alias("text")).where("record is not null")
    sizes = rows.groupBy("record").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    # No more than PARTS records can have more than a PARTS-th of all texts, so their broadcast is bounded.
    bar = F.greatest(F.lit(HOT_TEXTS), F.col("total") / PARTS)
    hot = sizes.crossJoin(F.broadcast(total)).where(F.col("n") > bar).select("record", F.ceil(F.col("n") / bar).alias("parts"))
    # Lower case comes last: it may turn a letter outside the pattern into one inside.  Joined terms take little room.
    words = F.lower(F.array_join(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), " "))
    held = rows.where("text is not null").select("record", words.alias("words")).where("words <> ''")
    held = held.join(F.broadcast(hot), "record", "left").withColumn("part", F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("words"), "parts")).cast("int"))
    each = F.split("words", " ")
    term = F.explode(F.array_distinct(each) if presence else each).alias("term")
    counted = held.select("record", "part", "words").repartition("record", "part").select("record", "part", term).groupBy("record", "part", "term").agg(F.count("*").alias("tf"))
    counted = stored(counted)
    split = counted.where("part >= 0").groupBy("record", "term").agg(F.sum("tf").alias("tf"))
    counted = counted.where("part < 0").select("record", "term", "tf").unionByName(split)
    f = F.lit(1) if presence else F.col("tf")
    spread = counted.groupBy("term").agg(F.sum(f).alias("gf"), F.sum(f * _log(f)).alias("h"), F.count("*").alias("n_records"))
    entropy = F.when(F.col("size") > 1, (_log(F.col("gf")) - F.col("h") / F.col("gf")) / _log(F.col("size"))).otherwise(0.0)
    # One row, so its broadcast is bounded.
    spread = stored(spread.crossJoin(F.broadcast(total)).select("term", "n_records", F.greatest(F.lit(0.0), entropy).alias("entropy")))
    # The records of all terms add up to the pairs, so no more than HOT_TERMS of them have more than this.
    often = spread.agg((F.sum("n_records") / HOT_TERMS).alias("often"))
    common = spread.crossJoin(F.broadcast(often)).where((F.col("n_records") > F.col("often")) & (F.col("n_records") > PARTS)).drop("often")
    looked = counted.join(F.broadcast(common), "term", "left")
    rare = looked.where("n_records is null").drop("n_records", "entropy").join(spread, "term")
    joined = looked.where("n_records is not null").unionByName(rare)
    local = _log(1 + F.col("tf"))
    return joined.select(
        F.col("record").alias(record), "term", "tf", "n_records", "entropy", local.alias("local"), (1 - F.col("entropy")).alias("spread"), (local * (1 - F.col("entropy"))).alias("score")
    )
