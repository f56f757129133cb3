"""What several operators share: table access, words, literal tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER_BYTES = bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of an Arrow batch of texts, unless the session has a setting of its own.
BATCH_ROWS = 1000
_BATCH_SETTING, _SPARK_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python a thousand at a time: Spark's default of ten thousand is made for short rows."""
    if spark.conf.get(_BATCH_SETTING) == _SPARK_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def ascii_lower(column):
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, _UPPER, _UPPER.lower())


def lower_bytes(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased. bytes.split() then cuts at exactly the characters WORD leaves out."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES)


def literal_rows(spark: SparkSession, names: Sequence[str], rows: Iterable[Sequence[object]], types: str) -> DataFrame:
    """A small table of constants as SQL literals, without Python on the executors."""
    structs = [F.struct(*(F.lit(value).alias(name) for name, value in zip(names, row))) for row in rows]
    array = F.array(*structs) if structs else F.array()
    typed = array.cast(f"array<struct<{types}>>")
    return spark.range(1).select(F.inline(typed))


def without(frame: DataFrame, *names: str) -> DataFrame:
    """Drops columns by name, in any letter case."""
    taken = {name.lower() for name in names}
    return frame.select(*(quoted(name) for name in frame.columns if name.lower() not in taken))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def arrow_rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of Arrow batches as Python tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names))
