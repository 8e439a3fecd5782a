"""Rows that are written once, with numbers that are the same at each reading, and how many tasks share some work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.written import PLAIN_FILES, fresh_path, shared_folder, written


def fresh(columns: list[str], name: str) -> str:
    """The name, or one like it that none of the columns has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def positional(df: DataFrame) -> DataFrame:
    """The same with the columns c0, c1, ...: no name clashes with working columns, or has to be quoted."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def cut(df: DataFrame, small: bool = False) -> DataFrame:
    """The rows, written to the shared folder: they survive lost executors, and the plan before them is done with.

    small: the table is a small part of the input's size, so it is dealt to an eighth of the partitions, and files,
    after it is worked out in all of them.
    """
    return written(df.repartition(-(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)) if small else df)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet in the shared folder, or as a checkpoint if they have a type that Parquet does not hold."""
    rows, names = positional(df), df.columns
    if any("void" in kind or "interval" in kind for _, kind in rows.dtypes):
        return cut(rows).toDF(*names)
    path = fresh_path(df.sparkSession, name)
    plain = {} if df.sparkSession.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl") else PLAIN_FILES
    rows.write.options(compression="zstd", **plain).parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path).toDF(*names)


def numbered(df: DataFrame, rid: str = "rid") -> DataFrame:
    """With rid, which tells rows by partition and place: written once, so that it is the same whenever it is read.

    A scan of files alone is not so: its splits follow the cores that live when a job is planned.  The rows go to
    Parquet in the shared folder, or to a checkpoint if they have a type that Parquet does not hold.
    """
    return stored(df.withColumn(rid, F.monotonically_increasing_id()), "numbered")


#: What is broadcast has so many bytes at most.
MOST_BROADCAST = 8 << 20


def small(table: DataFrame, size: Column, most: int = MOST_BROADCAST) -> DataFrame:
    """With a hint to broadcast the (written) table if its rows' sizes come to few bytes; else it is joined by shuffles."""
    total = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if total <= most else table


def tasks_for(work: int | None, a_task: int, most: int = 1 << 15) -> int:
    """How many tasks share some work, so that each gets about so much of it, however much it is.

    Adaptive execution sizes partitions by their bytes, which says little where a byte costs much work.
    """
    return max(1, min(most, -(-(work or 0) // a_task)))
