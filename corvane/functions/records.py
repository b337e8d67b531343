"""Operations within one record, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_terms(rows: DataFrame, keep: list[str], found: Column) -> DataFrame:
    """(keep..., term, tf): the terms of each record's token array with their counts in the record.

    The counts are the run lengths of the sorted tokens, so no row leaves its record and nothing is shuffled.
    """
    rows = rows.select(*keep, F.sort_array(found).alias("_t"))
    starts = F.filter(F.transform("_t", lambda t, i: F.when((i == 0) | (F.get("_t", i - 1) != t), i).otherwise(-1)), lambda i: i >= 0)
    rows = rows.select(*keep, "_t", F.size("_t").alias("_n"), starts.alias("_s"))
    return rows.select(
        *keep,
        F.inline(F.transform("_s", lambda s, k: F.struct(F.get("_t", s).alias("term"), (F.coalesce(F.get("_s", k + 1), F.col("_n")) - s).cast("long").alias("tf")))),
    )
