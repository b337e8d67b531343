"""Top N items within every group, by statistics-guided skipping over files clustered by group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.runtime import new_path

#: Rows of a file of the clustered layout that the writer aims at, and rows of its row groups: a group of more than two of these has some that
#: can be skipped, since within a file each group lies together, best score first.
FILE_ROWS, ROW_GROUP_ROWS = 1_000_000, 2_048
#: Fewer rows than this are no file of their own.
LEAST_ROWS = 100_000
#: Judged keys up to this number are broadcast (some 100 MB at most); beyond it the semi join shuffles.
BROADCAST_KEYS = 1_000_000


def cluster_by_group(rows: DataFrame, groups: Sequence[str], item: str, score: str, path: str, file_rows: int = FILE_ROWS, row_group_rows: int = ROW_GROUP_ROWS) -> None:
    """Write ``rows`` as files in which each group lies together, best score first: the layout that can be skipped over.

    A group larger than one file is split by a hash of its items over as many files as it needs, so no task gets more
    than about ``file_rows`` rows; there can be no more such groups than files, so their table is broadcast.
    Items with null or NaN scores and null items are left out: they never count.
    """
    spark = rows.sparkSession
    rows = rows.select(*groups, F.col(item).alias("item"), (F.col(score).cast("double") + F.lit(0.0)).alias("score")).where(
        "item is not null and score is not null and not isnan(score)"
    )
    sizes = rows.groupBy(*groups).count()
    heavy = F.when(F.col("count") > file_rows, F.struct(*[F.col(g).alias(f"_{g}") for g in groups], F.ceil(F.col("count") / file_rows).cast("int").alias("parts")))
    counted = sizes.agg(F.sum("count").alias("n"), F.collect_list(heavy).alias("big"))
    n, found = counted.first() or (0, [])
    n = n or 0
    files = max(1, -(-n // file_rows))
    big = spark.createDataFrame(found, counted.schema["big"].dataType.elementType)
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    placed = rows.join(F.broadcast(big), on, "left").select(*groups, "item", "score", F.coalesce("parts", F.lit(1)).alias("parts"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")))
    (
        placed.repartition(max(files, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // LEAST_ROWS)), *groups, "part")
        .drop("part")
        .sortWithinPartitions(*groups, F.desc("score"), "item")
        .write.option("compression", "zstd")
        .option("parquet.block.row.count.limit", row_group_rows)
        .parquet(path)
    )


def _open(path: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else "file://" + path)
    return pq.ParquetFile(system.open_input_file(inside))


def _best(frame: pd.DataFrame, groups: list[str], n: int) -> pd.DataFrame:
    """The n best distinct items of each group of a frame."""
    frame = frame.sort_values([*groups, "score", "item"], ascending=[*[True] * len(groups), False, True], kind="stable")
    frame = frame[~frame.duplicated([*groups, "item"])]
    return frame[frame.groupby(groups, dropna=False, sort=False).cumcount() < n]


def scan_file(path: str, groups: list[str], n: int, seen: dict | None = None) -> pd.DataFrame:
    """The n best distinct items of each group of one clustered file.

    Row groups are read in descending maximum score. A row group whose statistics show a single group, and a maximum
    strictly below that group's current n-th score, is skipped; equal scores are read, as the tie rule may prefer them. A row
    group of several groups holds the best rows of all but the first of them, so it is never below every contained group's n-th score.
    ``seen`` receives the numbers of row groups read and skipped.
    """
    file = _open(path)
    at = {file.metadata.schema.column(i).path: i for i in range(file.metadata.num_columns)}

    def bounds(k: int):
        cols = [file.metadata.row_group(k).column(at[c]).statistics for c in (*groups, "score")]
        one = all(s is not None and s.has_min_max and s.min == s.max and s.null_count == 0 for s in cols[:-1])
        most = cols[-1].max if cols[-1] is not None and cols[-1].has_min_max else np.inf
        return most, tuple(s.min for s in cols[:-1]) if one else None

    order = sorted(((*bounds(k), k) for k in range(file.metadata.num_row_groups)), key=lambda x: (-x[0], x[2]))
    single: dict[tuple, pd.DataFrame] = {}
    held, read = [], 0
    for most, group, k in order:
        best = single.get(group) if group else None
        if best is not None and len(best) >= n and most < best["score"].iloc[n - 1]:
            continue
        read += 1
        frame = _best(file.read_row_group(k).to_pandas(), groups, n)
        if group:
            single[group] = _best(pd.concat([best, frame]), groups, n) if best is not None else frame
        else:
            held.append(frame)
    if seen is not None:
        seen.update(read=read, skipped=len(order) - read)
    held += single.values()
    return _best(pd.concat(held, ignore_index=True), groups, n) if held else pd.DataFrame()


def top_n_clustered(spark, path: str, groups: Sequence[str], n: int) -> DataFrame:
    """Top n of a layout written by :func:`cluster_by_group`: (groups, item, score, rank).

    Each task reads one file and returns at most n rows of each of its groups. Only groups that were split over
    several files are merged by a second, small shuffle.
    """
    layout = spark.read.parquet(path)
    names = list(groups)
    files = layout.inputFiles()
    if not files:
        return layout.limit(0).select(*names, "item", "score", F.lit(0).alias("rank"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for f in frame["file"]:
                got = scan_file(f, names, n)
                if len(got):
                    got["rank"] = (got.groupby(names, dropna=False, sort=False).cumcount() + 1).astype("int32")
                    yield got[[*names, "item", "score", "parts", "rank"]]

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in layout.select(*names, "item", "score", "parts").schema)
    paths = spark.createDataFrame([(f,) for f in files], "file string").repartitionByRange(len(files), "file")
    found = paths.mapInPandas(scan, types + ", rank int")
    order = Window.partitionBy(*names).orderBy(F.desc("score"), "item")
    whole = found.where("parts = 1").drop("parts")
    split = found.where("parts > 1").drop("parts").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return whole.unionByName(split)


def top_n(rows: DataFrame, groups: Sequence[str], item: str, score: str, n: int, only: DataFrame | None = None) -> DataFrame:
    """(groups, item, score, rank): the n best distinct items of each group, higher score first, then smaller item.

    An item that is repeated in a group counts once with its highest score. Null and NaN scores and null items never
    count; a null group column is a group of its own. ``only`` holds the keys to keep, in columns named like some
    of ``groups``. An empty table gives no rows. Existing columns with other names, ranks included, are ignored.
    """
    if only is not None:
        keys = only.dropna().distinct()
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        rows = rows.join(keys, only.columns, "left_semi")
    spark = rows.sparkSession
    path = new_path(spark, "clustered")
    cluster_by_group(rows, groups, item, score, path)
    return top_n_clustered(spark, path, groups, n).withColumnRenamed("item", item).withColumnRenamed("score", score)
