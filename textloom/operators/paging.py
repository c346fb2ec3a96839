"""Deep pages of an ordered listing, by an index of how many rows each range of the order has.

``orderBy().offset().limit()`` keeps offset + limit rows in every task and brings them together. Here the rows are dealt into
ranges of their key and written in order, once; a row's id is its range and its place in it. The index has the number of rows
before each range: a page is one stretch of places in one range or a few, which the reader finds by the ids that Parquet keeps
for its row groups.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows up to which a page is taken by a top-k; beyond, an index pays.
SHALLOW = 5000
_PLACE = 33  # bits of an id that are the place in its range


@dataclass(frozen=True)
class Pages:
    """rows: with id_, ordered by it; starts: (range, rows before it, rows in it), one for each range."""

    rows: DataFrame
    starts: tuple[tuple[int, int, int], ...]

    @staticmethod
    def of(rows: DataFrame, *keys: str, group_bytes: int | None = None) -> Pages:
        """The order is that of keys, which tell rows apart. group_bytes: the size of a row group, which a page reads at least."""
        spark = rows.sparkSession
        path = f"{shared_folder(spark)}/textloom/pages-{uuid.uuid4().hex}"
        dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id_", F.monotonically_increasing_id())
        options = {"parquet.block.size": str(group_bytes), "parquet.page.row.count.limit": "1000"} if group_bytes else {}
        dealt.write.options(**options).parquet(path)
        made = spark.read.schema(dealt.schema).parquet(path)
        sizes = made.groupBy(F.shiftright("id_", _PLACE).alias("range")).count().orderBy("range").collect()
        starts, before = [], 0
        for r in sizes:
            starts.append((r.range, before, r["count"]))
            before += r["count"]
        return Pages(made, tuple(starts))

    @property
    def total(self) -> int:
        return self.starts[-1][1] + self.starts[-1][2] if self.starts else 0

    def within(self, offset: int, limit: int) -> Column:
        """The ids of a page."""
        wanted = [F.lit(False)]
        for part, before, n in self.starts:
            first, last = max(offset - before, 0), min(offset + limit - before, n) - 1
            if first <= last:
                wanted.append(F.col("id_").between((part << _PLACE) + first, (part << _PLACE) + last))
        return reduce(Column.__or__, wanted[1:]) if len(wanted) > 1 else wanted[0]

    def page(self, offset: int, limit: int) -> DataFrame:
        return self.rows.filter(self.within(offset, limit)).orderBy("id_").drop("id_")
