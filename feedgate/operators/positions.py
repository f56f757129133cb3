"""Which positions a commit holds, as bitmaps that merge.

A commit's positions are kept as one bitmap for each stretch of BITS positions. Whether a position was given
out twice, or never, follows from merging the bitmaps of all commits: counting them and counting their
union. Rows are grouped once, when their commit is made; checking many commits groups bitmaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of one bitmap, fixed by Spark's bitmap functions.
BITS = 32768


def position_bitmaps(rows: DataFrame, commit: Column | int) -> DataFrame:
    """``commit, bucket, bitmap, rows`` of rows with positions; ``commit`` names what they belong to."""
    commit = F.lit(commit) if isinstance(commit, int) else commit
    known = rows.filter(F.col("seq") > 0).select(commit.cast("long").alias("commit"), "seq")
    bucket, place = F.bitmap_bucket_number("seq"), F.bitmap_bit_position("seq")
    return known.groupBy("commit", bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(place).alias("bitmap"), F.count(F.lit(1)).alias("rows")
    )


def merged(bitmaps: DataFrame) -> DataFrame:
    """``bucket, bitmap, rows, positions``: the union of all commits, the rows they have, and different positions."""
    joined = bitmaps.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), F.sum("rows").alias("rows"))
    return joined.withColumn("positions", F.bitmap_count("bitmap"))


def _places(bitmap: Column, value: int) -> Column:
    """The places 0 … BITS - 1 whose bit has a value, in order; bytes are looked at before bits."""
    text = F.hex(bitmap)
    skipped = "00" if value else "FF"

    def byte(n: Column) -> Column:
        return F.substring(text, n * 2 + 1, F.lit(2))

    bytes_met = F.filter(F.sequence(F.lit(0), F.lit(BITS // 8 - 1)), lambda n: byte(n) != skipped)

    def places(n: Column) -> Column:
        number = F.conv(byte(n), 16, 10).cast("int")
        held = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit(number, b) == value)
        return F.transform(held, lambda b: n * 8 + b)

    bits = F.transform(bytes_met, places)
    return F.flatten(bits)


def _positions(buckets: DataFrame, value: int, upto: int | None = None) -> DataFrame:
    at = buckets.select("bucket", F.explode(_places(F.col("bitmap"), value)).alias("_place"))
    # Bucket 1 begins with position 1.
    rows = at.select(((F.col("bucket") - 1) * BITS + F.col("_place") + 1).alias("seq"))
    return rows if upto is None else rows.filter(F.col("seq") <= upto)


def gaps(bitmaps: DataFrame, upto: int) -> DataFrame:
    """``seq`` of the positions up to one that no commit holds. Buckets without a row are named by a range."""
    every = bitmaps.sparkSession.range(1, -(-upto // BITS) + 1).select(F.col("id").alias("bucket"))
    found = every.join(merged(bitmaps), "bucket", "left").filter(F.coalesce(F.col("positions") < BITS, F.lit(True)))
    empty = F.unhex(F.repeat(F.lit("00"), BITS // 8))
    return _positions(found.select("bucket", F.coalesce("bitmap", empty).alias("bitmap")), 0, upto)


def repeated(bitmaps: DataFrame, rows: DataFrame) -> DataFrame:
    """``seq, rows`` of positions given out more than once.

    Only buckets that have more rows than positions are looked at; their rows are read and counted, others
    are not.
    """
    suspects = merged(bitmaps).filter(F.col("rows") > F.col("positions")).select("bucket")
    in_doubt = rows.filter(F.col("seq") > 0).withColumn("bucket", F.bitmap_bucket_number("seq")).join(suspects, "bucket", "left_semi")
    return in_doubt.groupBy("seq").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
