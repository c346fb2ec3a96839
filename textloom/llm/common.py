"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import shared_folder, small_batches

__all__ = ["LARGE_ROWS", "WHITE", "Marks", "clear", "gathered", "let", "marked_only", "marks", "shared_folder", "small_batches", "table", "written"]

#: Fixed value: ASCII white space, as a character class of a regular expression.
WHITE = r"\x20\x09-\x0D"

#: Options of written() for rows of some megabytes: a row group for each. Parquet looks at the size of a group after a hundred rows only
#: and counts it compressed, and a reader decodes a group of so few rows at once, so it would be all that a task wrote.
LARGE_ROWS = {"parquet.block.row.count.limit": "1"}


def written(frame: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: it survives lost executors and cuts the lineage.

    The schema is given to the reader, so an empty frame reads back too.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    frame.write.options(**options).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def gathered(spark: SparkSession, frames: Iterable[DataFrame], schema: str, name: str) -> DataFrame:
    """Write frames of one schema one after the other into a folder as written() does, and read them back as one."""
    path, some = f"{shared_folder(spark)}/textloom/{name}-{uuid.uuid4().hex}", False
    for frame in frames:
        frame.write.mode("append").parquet(path)
        some = True
    return spark.read.schema(schema).parquet(path) if some else spark.createDataFrame([], schema)


def clear(spark: SparkSession) -> None:
    """Delete what written() has left, when no frame that reads it is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/textloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class Marks:
    """A bitmap of hashed long keys as rows (word_, bits_), small enough to be broadcast."""

    rows: DataFrame
    words: int

    def _here(self, key: str) -> Column:
        bit = F.expr(f"bits_ & shiftleft(1L, cast(shiftrightunsigned({key}, 40) & 63 AS INT))")
        return (F.pmod(F.col(key), F.lit(self.words)) == F.col("word_")) & (bit != 0)

    def maybe(self, frame: DataFrame, key: str) -> DataFrame:
        """The rows whose key may be marked, without a shuffle of the frame."""
        return frame.join(F.broadcast(self.rows), self._here(key), "left_semi")

    def surely_not(self, frame: DataFrame, key: str) -> DataFrame:
        """The other rows (those with a null key too)."""
        return frame.join(F.broadcast(self.rows), self._here(key), "left_anti")


def marks(keys: DataFrame, key: str, least: int = 1 << 12, most: int = 1 << 19) -> Marks:
    """Marks of the keys, which are counted: about sixteen bits a key, and never more than ``most`` words of 64 bits.

    A key's bit may be set by another key, never left unset by its own. Beyond some 10^7 keys the bitmap fills and tells less,
    up to nothing; then more rows go the longer way, whose result is the same.
    """
    n = keys.agg(F.approx_count_distinct(key)).first()[0]
    words = min(most, max(least, 1 << (n // 4).bit_length()))
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({key}, 40) & 63 AS INT))")
    return Marks(keys.groupBy(F.pmod(key, F.lit(words)).alias("word_")).agg(F.bit_or(bit).alias("bits_")), words)


def marked_only(frame: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of the frame whose key may be among the keys (a column of the same name)."""
    return marks(keys, key).maybe(frame, key)
