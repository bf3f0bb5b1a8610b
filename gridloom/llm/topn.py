"""Top N items within every group, reading only the row groups that can still matter.

Groups of at most N items need no search: all of them come out. The items of larger groups are written clustered by
group, best first, so that Parquet row groups of a large group hold ranges of its scores. Each file is then read by its
footer: row groups in descending maximum score, and those whose maximum lies strictly below the N-th score so far of
every group they hold are skipped. In a file sorted by group that can only be row groups of one group: one that holds
several has the first rows of all but its first. A group of millions of items spreads over many row groups and files,
all but the first few of which are never read; what a task keeps is N rows per group of its file. A last merge takes N of
the at most N rows per file and group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.skew import salted_join
from gridloom.storage import written

#: Rows of a file, about, and bytes of its row groups: small enough for a large group to span many.
FILE_ROWS = 1_000_000
ROW_GROUP_BYTES = 128 << 10


def read_top(path: str, group: str, item: str, score: str, n: int) -> tuple[pd.DataFrame, int, int]:
    """The n best rows of every group of one file sorted by (group, score descending, item), the row groups read and skipped."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, where = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(where) as source:
        file = pq.ParquetFile(source)
        meta = file.metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        todo = []
        for k in range(meta.num_row_groups):
            s, g = meta.row_group(k).column(at[score]).statistics, meta.row_group(k).column(at[group]).statistics
            top = s.max if s is not None and s.has_min_max else math.inf
            alone = g.min if g is not None and g.has_min_max and g.min == g.max and not g.null_count else None
            todo.append((-top, k, alone))
        heads: list[pd.DataFrame] = []
        best: dict[object, list] = {}  # the n best scores so far of groups that may go on in other row groups
        read = skipped = 0
        for minus_top, k, alone in sorted(todo, key=lambda x: x[:2]):
            have = best.get(alone, []) if alone is not None else []
            if len(have) >= n and have[n - 1] > -minus_top:
                skipped += 1
                continue
            read += 1
            rows = file.read_row_group(k, columns=[group, item, score]).to_pandas()
            head = rows.groupby(group, sort=False, dropna=False).head(n)
            heads.append(head)
            for g in {rows[group].iloc[0], rows[group].iloc[-1]} if len(rows) else ():
                if g is not None:
                    best[g] = sorted([*best.get(g, []), *head.loc[head[group] == g, score]], reverse=True)[:n]
    if not heads:
        return pd.DataFrame({group: [], item: [], score: []}), read, skipped
    every = pd.concat(heads).sort_values([group, score, item], ascending=[True, False, True], kind="stable")
    return every.groupby(group, sort=False, dropna=False).head(n), read, skipped


def _best_of_files(paths: DataFrame, columns: list[str], n: int, schema: str, counters: bool) -> DataFrame:
    group, item, score = columns

    def best_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                rows, read, skipped = read_top(p, group, item, score, n)
                if counters:
                    yield pd.DataFrame([(p.rsplit("/", 1)[-1], read, skipped)], columns=["file", "groups_read", "groups_skipped"])
                else:
                    # Plain objects: strings of several row groups come in chunks, which a batch of rows cannot hold.
                    yield rows.astype({group: object, item: object})

    return paths.mapInPandas(best_of, "file string, groups_read int, groups_skipped int" if counters else schema)


def clustered(scored: DataFrame, group: str, item: str, score: str, n: int, file_rows: int = FILE_ROWS, row_group_bytes: int = ROW_GROUP_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the groups of at most n items, paths of the clustered files of the others or None)."""
    spark = scored.sparkSession
    table, _ = written(scored.select(group, item, score).dropna(), "scored")
    large = table.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > n)
    large, _ = written(large, "large-groups")
    n_rows = large.agg(F.sum("_n")).first()[0] or 0
    if not n_rows:
        return table, None
    rows = salted_join(table, large.select(group), [group], "left_semi")
    # Clustered by group, a hot group over several files in score order.
    order = [F.col(group), F.col(score).desc(), F.col(item)]
    ranged = rows.repartitionByRange(max(1, math.ceil(n_rows / file_rows)), *order).sortWithinPartitions(*order)
    sorted_table, _ = written(ranged, "clustered", {"parquet.block.size": str(row_group_bytes)})
    names = sorted(sorted_table.inputFiles())
    return table.join(large.select(group).hint("merge"), group, "left_anti"), spark.createDataFrame([(p,) for p in names], "path string").repartition(len(names))


def top_n_per_group(scored: DataFrame, group: str, item: str, score: str, n: int, file_rows: int = FILE_ROWS, row_group_bytes: int = ROW_GROUP_BYTES) -> DataFrame:
    """(group, rank_no int from 1, item, score): for each group its n rows of highest score, ties by item ascending (bytes).

    `scored` has one row per (group, item); a repeated one takes a rank each. Rows with a null group, item or score
    are left out. Groups with fewer than n rows give them all; an empty input gives no rows; n below 1 is an error.
    Further columns are not read, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    small, paths = clustered(scored, group, item, score, n, file_rows, row_group_bytes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema if f.name in (group, item, score))
    best = small.select(group, item, score)
    if paths is not None:
        best = best.unionByName(_best_of_files(paths, [group, item, score], n, schema, False))
    w = W.partitionBy(group).orderBy(F.col(score).desc(), F.col(item))
    return best.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n).select(group, "rank_no", item, score)


def row_groups_skipped(scored: DataFrame, group: str, item: str, score: str, n: int, file_rows: int = FILE_ROWS, row_group_bytes: int = ROW_GROUP_BYTES) -> DataFrame:
    """(file, groups_read, groups_skipped): what `top_n_per_group` reads of each clustered file; no rows if no group has more than n items."""
    _, paths = clustered(scored, group, item, score, n, file_rows, row_group_bytes)
    if paths is None:
        return scored.sparkSession.createDataFrame([], "file string, groups_read int, groups_skipped int")
    return _best_of_files(paths, [group, item, score], n, "", True)
