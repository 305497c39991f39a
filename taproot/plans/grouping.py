"""Work on groups that are small and many."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

Row = Any


def by_document(df: DataFrame, work: Callable[[str, list[Row]], list[tuple]], schema: str) -> DataFrame:
    """``work`` done on the rows of each document; they are few, so many documents go through one task without a frame each."""
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name="Row"):
                if row.document_id != at:
                    out += work(at, held) if held else []
                    at, held = row.document_id, []
                held.append(row)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(work(at, held) if held else [], columns=columns)

    columns = [c.split()[0] for c in schema.split(", ")]
    return df.select(*names).repartition("document_id").sortWithinPartitions("document_id").mapInPandas(run, schema)
