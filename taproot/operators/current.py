"""The newest state of rows that are delivered more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taproot.plans.lineage import cut, stored

#: Bits of the filter of repeated keys: so many for each, and never more than MOST_BITS (8 MB).
KEY_BITS, MOST_BITS = 24, 1 << 26


def _may_repeat(df: DataFrame, keys: list[str]) -> Column | None:
    """True for every row whose key comes more than once, and for few others.

    The keys are counted by their hashes, then sent out as a Bloom filter of bounded size.  Null where no key repeats
    or the session has no JVM at hand; then all rows or none need a closer look.  The filter comes from a table by a
    subquery: as a literal it would stand in every text of the plan that the driver keeps, twice its size in each place.
    """
    jvm = getattr(df.sparkSession, "_jvm", None)
    h = F.xxhash64(*keys)
    repeated = cut(df.select(h.alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    n = repeated.count()
    if not n:
        return F.lit(False)
    if jvm is None:
        return None
    bits = min(MOST_BITS, max(1 << 16, KEY_BITS * n))
    out = jvm.java.io.ByteArrayOutputStream()
    repeated._jdf.stat().bloomFilter("h", n, bits).writeTo(out)
    sent = stored(df.sparkSession.createDataFrame([(bytearray(out.toByteArray()),)], "bits binary"))
    columns = jvm.org.apache.spark.sql.classic.ExpressionUtils
    test = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(columns.expression(sent.scalar()._jc), columns.expression(h._jc))
    return Column(columns.column(test))


def current_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row for each ``keys``: the greatest by ``order`` (first column first).

    Only ``columns`` besides the keys are kept, so the scan and the shuffle carry nothing else.  Rows that tie in
    ``order`` are told apart by the remaining columns, so the choice never depends on the partitioning.  A null in
    ``order`` is older than any value; null keys form a key of their own.  An empty table gives an empty table.

    Rows of keys that come once stay where they are; only the others, told apart by a filter over the hashed keys, are
    shuffled and ranked.
    """
    kept = [c for c in (columns if columns is not None else df.columns) if c not in keys]
    rows = df.select(*dict.fromkeys([*keys, *order, *kept]))
    orderable = [c for c, kind in rows.dtypes if c not in keys and c not in order and "map" not in kind]
    ranked = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in [*order, *orderable]])

    def newest_of(part: DataFrame) -> DataFrame:
        return part.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").select(*keys, *kept)

    test = _may_repeat(rows, keys)
    if test is None:
        return newest_of(rows)
    return rows.where(~test).select(*keys, *kept).unionByName(newest_of(rows.where(test)))


def newest(value: str, order: str) -> Column:
    """Aggregate: ``value`` of the row with the greatest ``order``; ties go to the greatest value."""
    return F.max(F.struct(F.col(order), F.col(value)))[value]
