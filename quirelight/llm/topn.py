"""Problem 6: the first N items of every group, whatever the size of the group."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelight.session import scratch_path

#: Bytes a Parquet row group buffers: small, so that one can be skipped without the next.
ROW_GROUP_BYTES = 512 * 1024
#: Footers that one task reads.
FOOTERS = 8


@contextmanager
def _open(path: str):
    """A Parquet file of the shared folder; Spark's names of a store's protocol are mapped."""
    from pyarrow import fs
    from pyarrow import parquet as pq

    where, inner = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
    with where.open_input_file(inner) as f:
        yield pq.ParquetFile(f)


def _bounds(rg, columns: list[str]) -> dict[str, tuple[Any, Any] | None]:
    found: dict[str, tuple[Any, Any] | None] = dict.fromkeys(columns)
    for i in range(rg.num_columns):
        col = rg.column(i)
        if col.path_in_schema in found and col.statistics is not None and col.statistics.has_min_max:
            found[col.path_in_schema] = (col.statistics.min, col.statistics.max)
    return found


def _row_groups(order: list[str]):
    """Footers only: of each row group its one group (if one) and its best possible row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                with _open(path) as f:
                    meta = f.metadata
                for i in range(meta.num_row_groups):
                    b = _bounds(meta.row_group(i), ["_g", *order, "_item"])
                    only = b["_g"][0] if b["_g"] and b["_g"][0] == b["_g"][1] else None
                    low: list[float] = []
                    tied = True
                    for c in order:
                        if not tied or b[c] is None:
                            tied = False
                            break
                        low.append(b[c][0])
                        tied = b[c][0] == b[c][1]
                    item = str(b["_item"][0]) if tied and b["_item"] else None
                    # a row group of one group is read with the others of that group, any
                    # other one alone: it holds the end of one group and the start of others
                    rows.append((path, i, f"m{path}#{i}" if only is None else f"g{only}", only, low, item))
            yield pd.DataFrame(rows, columns=["path", "row_group", "unit", "only", "low", "low_item"])

    return run


class _Best:
    """The n best distinct items of one group; keys are tuples that compare in order."""

    def __init__(self, n: int):
        self.n, self.held = n, {}

    def worst(self):
        return max(self.held.values()) if len(self.held) == self.n else None

    def offer(self, key: tuple, item: str) -> None:
        old = self.held.get(item)
        if old is not None:
            if key < old:
                self.held[item] = key
            return
        self.held[item] = key
        if len(self.held) > self.n:
            del self.held[max(self.held, key=self.held.get)]


def _read_best_first(n: int, order: list[str]):
    """Read a unit's row groups from the best bound down; skip what is strictly worse."""

    def run(units: pd.DataFrame) -> pd.DataFrame:
        best: dict[str, _Best] = {}
        jobs = [((*low, *([] if item is None else [item])), path, i, only) for path, i, only, low, item in zip(units["path"], units["row_group"], units["only"], units["low"], units["low_item"])]
        for low, path, i, only in sorted(jobs, key=lambda j: j[:3]):
            worst = best[only].worst() if only in best else None
            if worst is not None and low > worst[: len(low)]:
                continue
            with _open(path) as f:
                t = f.read_row_group(i, columns=["_g", *order, "_item"]).to_pydict()
            for group, item, *key in zip(t["_g"], t["_item"], *[t[c] for c in order]):
                best.setdefault(group, _Best(n)).offer((*key, item), item)
        rows = [(g, *key[:-1], item) for g, b in best.items() for item, key in b.held.items()]
        return pd.DataFrame(rows, columns=["_g", *order, "_item"])

    return run


def top_n(df: DataFrame, group: list[str], order: list[Column], item: str, n: int) -> DataFrame:
    """The ``n`` first distinct ``item`` values of each group, with ``position`` 1 to n.

    ``order`` are ascending, non-null numeric columns, the best first; equal rows are told
    apart by ``item``. An item counts once, with its best row. Null group parts form groups
    of their own; rows with a null item are ignored; an empty input gives no rows.

    The rows are clustered by group and order into Parquet files in the shared folder, by
    range, so a group with a third of all rows spreads over many files. Then only footers
    are read; the row groups of a group are visited from the best bound down, and those
    strictly behind its n-th item so far are skipped unread, the tie columns included. What
    remains to shuffle is at most n rows per group and row-group unit.
    """
    spark = df.sparkSession
    names = [f"_o{i}" for i in range(len(order))]
    key = F.to_json(F.struct(*[F.col(c) for c in group]))
    rows = df.where(F.col(item).isNotNull()).select(key.alias("_g"), *[c.cast("double").alias(k) for c, k in zip(order, names)], F.col(item).alias("_item"))
    path = scratch_path(spark, "topn")
    (rows.repartitionByRange("_g", *names).sortWithinPartitions("_g", *names, "_item")
     .write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", 64 * 1024).parquet(path))
    files = spark.read.parquet(path).inputFiles()
    units = T.StructType([T.StructField("path", T.StringType()), T.StructField("row_group", T.IntegerType()), T.StructField("unit", T.StringType()),
                          T.StructField("only", T.StringType()), T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("low_item", T.StringType())])
    out = T.StructType([T.StructField("_g", T.StringType()), *[T.StructField(k, T.DoubleType()) for k in names], T.StructField("_item", rows.schema["_item"].dataType)])
    listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, -(-len(files) // FOOTERS)))
    parts = listed.mapInPandas(_row_groups(names), units).groupBy("unit").applyInPandas(_read_best_first(n, names), out)
    once = parts.groupBy("_g", "_item").agg(F.min(F.struct(*names)).alias("_k"))
    ranked = once.withColumn("position", F.row_number().over(W.partitionBy("_g").orderBy("_k", "_item"))).where(F.col("position") <= n)
    schema = T.StructType([df.schema[c] for c in group])
    return (ranked.select(F.from_json("_g", schema).alias("_s"), F.col("_item").alias(item), "position")
            .select(*[F.col(f"_s.{c}").alias(c) for c in group], item, "position"))


def leading_papers(clusters: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` leading papers of each cluster 0 and up of every run, view and method.

    By ``representative_rank`` (1 and up), then ``medoid_rank`` (missing last), then
    ``paper_id``; a paper written several times counts with its best row.
    """
    kept = clusters.where((F.col("cluster") >= 0) & (F.col("representative_rank") >= 1))
    medoid = F.coalesce(F.col("medoid_rank"), F.lit(2**31 - 1))
    return top_n(kept, ["run_id", "text_view", "cluster_method", "cluster"], [F.col("representative_rank"), medoid], "paper_id", n)
