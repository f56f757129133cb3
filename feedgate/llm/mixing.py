"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source's words, its documents in a seeded order, are one stream cut into blocks of equal
length. Sainte-Lague's highest quotients weight / (2 q + 1) turn the sources' target sizes into
whole numbers of blocks. A source's quota is some full passes over its stream and a rest of blocks,
which highest quotients turn into a quota for each shard of consecutive blocks; in each shard a seeded
permutation picks as many blocks. A document takes the words it has in picked blocks, plus its
size for every full pass. Quotas are whole numbers throughout.

Only one row per source reaches the driver, and their number is checked. Positions in a stream
come from sums over buckets of about BUCKET_WORDS words or BUCKET_ROWS rows, and sums over groups of
buckets, so a source that holds most rows is many tasks, whether they have words or not.

Defined results: null texts have size 0 and take nothing; a null source is a source, the last;
equal rows are separate documents and interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedgate.llm.common import WORD, quoted
from feedgate.sources.scratch import save

BLOCK_WORDS = 32
SHARD_BLOCKS = 1024
BUCKET_WORDS = 65_536
BUCKET_ROWS = 65_536
GROUP_BUCKETS = 1024
MAX_SOURCES = 1_000_000
WEIGHTS = (5, 2, 1)
PASSES = 3
SEED = 20_240_101

#: Primes above SHARD_BLOCKS: multiplying by one permutes the blocks of any shard.
_STEPS = (1031, 1033, 1039, 1049, 1051, 1061, 1063, 1069)


def targets(sizes: Sequence[int], weights: Sequence[float], passes: int = PASSES) -> list[float]:
    """Shares of all sizes by weight; none above `passes` times its source, the excess reshared."""
    result, fixed = [0.0] * len(sizes), set()
    total = float(sum(sizes))
    while len(fixed) < len(sizes):
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(result[i] for i in fixed)
        whole = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / whole > passes * sizes[i]]
        if not above:
            for i in free:
                result[i] = left * weights[i] / whole
            break
        for i in above:
            result[i] = float(passes * sizes[i])
            fixed.add(i)
    return result


def sainte_lague(weights: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotient weight / (2 q + 1), ties to the earlier; at most `most` each."""
    seats = min(seats, sum(most))
    count = lambda divisor: [min(m, int(w / divisor + 0.5)) for w, m in zip(weights, most)]
    low, high = 0.0, 4 * max(weights, default=0.0) + 1.0
    for _ in range(200):  # the seats that every method step before the last few hands out
        middle = (low + high) / 2
        low, high = (low, middle) if middle > 0 and sum(count(middle)) <= seats else (middle, high)
    given = count(high)
    queue = [(-w / (2 * q + 1), i) for i, (w, q) in enumerate(zip(weights, given)) if q < most[i] and w > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(given)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        given[i] += 1
        if given[i] < most[i]:
            heapq.heappush(queue, (-weights[i] / (2 * given[i] + 1), i))
    return given


def shard_quotas(blocks: int, seats: int, shard: int) -> tuple[int, int, int, int]:
    """Sainte-Lague seats of a source's shards: (whole shards, seats of each, how many have one more, seats of the last).

    All shards but the last hold `shard` blocks, so their quotients tie and the earlier ones come first;
    the last holds the others. Its q-th seat is handed out once the whole shards have taken all quotients
    that are as high, and still is one of `seats`. No shard gets more than it holds.
    """
    whole, rest = divmod(blocks, shard)
    last = 0
    while last < rest:
        ahead = min(shard, (shard * (2 * last + 1) // rest + 1) // 2)
        if whole * ahead + last >= seats:
            break
        last += 1
    each, more = divmod(seats - last, whole) if whole else (0, 0)
    return whole, each, more, last


def plan_sources(
    sizes: dict[str | None, int],
    weights: Sequence[float] = WEIGHTS,
    passes: int = PASSES,
    block: int = BLOCK_WORDS,
    counts: dict[str | None, int] | None = None,
) -> list[tuple]:
    """(source, size, target, blocks, full passes, rest of blocks, buckets, shard quotas) of every source."""
    names = sorted(sizes, key=lambda name: (name is None, name or ""))
    amounts = [sizes[name] for name in names]
    wanted = targets(amounts, [weights[i % len(weights)] for i in range(len(names))], passes)
    blocks = [-(-amount // block) for amount in amounts]
    quotas = sainte_lague(wanted, round(sum(wanted) / block), [passes * n for n in blocks])
    rows = []
    for name, amount, target, n, quota in zip(names, amounts, wanted, blocks, quotas):
        full, rest = passes_and_rest(quota, amount, passes, block)
        buckets = max(1, -(-amount // BUCKET_WORDS), -(-(counts or {}).get(name, 0) // BUCKET_ROWS))
        rows.append((name, amount, target, n, full, rest, buckets, *shard_quotas(n, rest, SHARD_BLOCKS)))
    return rows


def passes_and_rest(quota: int, amount: int, passes: int, block: int) -> tuple[int, int]:
    """Full passes over a source, and further blocks, that hold as many words as `quota` blocks.

    A source's last block may be short, so passes are counted in words.
    """
    words = min(quota * block, passes * amount)
    full = words // amount if amount else 0
    rest = (2 * (words - full * amount) + block) // (2 * block)
    return (full + 1, 0) if amount and rest >= -(-amount // block) else (full, rest)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = (),
    weights: Sequence[float] = WEIGHTS,
    passes: int = PASSES,
    block: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """id, size, source_size, target and taken of every row, after the `keep` columns of `docs`.

    A kept column that has one of these names gives way.
    """
    spark = docs.sparkSession
    added = {id_col.lower(), "size", "source_size", "target", "taken"}
    kept = [name for name in keep if name.lower() not in added]
    own = [F.col(quoted(name)).alias(f"__keep_{i}") for i, name in enumerate(kept)]
    rows = docs.select(
        *own,
        F.col(id_col).alias("__id"),
        F.col(source_col).cast("string").alias("__source"),
        words(F.col(text_col)).alias("__size"),
    )
    short = save(rows.select("__id", "__source", "__size"), "mix-sizes")
    if not kept:
        rows = short

    totals = short.groupBy("__source").agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("rows"))
    listed = totals.limit(MAX_SOURCES + 1).collect()
    found, counts = {row[0]: row[1] for row in listed}, {row[0]: row[2] for row in listed}
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; group them first")
    # Written, so that its bytes are known: the planner broadcasts it or not.
    plan = save(
        spark.createDataFrame(
            [(number, *row) for number, row in enumerate(plan_sources(found, weights, passes, block, counts))],
            "s int, p_source string, source_size long, target double, n long, full long, rest long, buckets long, "
            "whole long, each long, more long, last long",
        ).coalesce(1),
        "mix-plan",
    )

    def placed(frame: DataFrame) -> DataFrame:
        """Bucket and order within the source: both follow the same seeded hash."""
        joined = frame.join(plan, F.col("__source").eqNullSafe(F.col("p_source")))
        joined = joined.withColumn("h", F.xxhash64(F.lit(seed), "__id", "__size"))
        joined = joined.withColumn("u", F.shiftrightunsigned("h", 33))
        return joined.withColumn("bucket", F.shiftright(F.col("u") * F.col("buckets"), 31)).withColumn(
            "grp", F.expr(f"bucket div {GROUP_BUCKETS}")
        )

    # By number, not name: plain equality, so that window and join share one exchange of the rows.
    sums = placed(short).groupBy("s", "grp", "bucket").agg(F.sum("__size").alias("in_bucket"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("s", "grp").agg(F.sum("in_bucket").alias("in_group"))
    group_start = F.coalesce(F.sum("in_group").over(before("s").orderBy("grp")), F.lit(0))
    start = F.coalesce(F.sum("in_bucket").over(before("s", "grp").orderBy("bucket")), F.lit(0))
    starts = (
        sums.withColumn("start", start)
        .join(groups.select("s", "grp", group_start.alias("group_start")), ["s", "grp"])
        .select("s", "bucket", (F.col("start") + F.col("group_start")).alias("bucket_start"))
    )
    within = before("s", "bucket").orderBy("u", "h", "__id", "__size")
    ranked = placed(rows).withColumn("inside", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    located = ranked.join(starts, ["s", "bucket"]).withColumn("at", F.col("bucket_start") + F.col("inside"))

    return located.select(
        *(F.col(f"__keep_{i}").alias(name) for i, name in enumerate(kept)),
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("full") * F.col("__size") + _picked_words(block, seed)).cast("long").alias("taken"),
    )


def _picked_words(block: int, seed: int) -> Column:
    """Words of [at, at + size) in picked blocks of the source's stream."""
    shard = f"(k div {SHARD_BLOCKS})"
    first, after = f"({shard} * {SHARD_BLOCKS})", f"(({shard} + 1) * {SHARD_BLOCKS})"
    length = f"(least({after}, n) - {first})"
    quota = f"(CASE WHEN {shard} >= whole THEN last WHEN {shard} < more THEN each + 1 ELSE each END)"
    steps = ", ".join(map(str, _STEPS))
    mixed = f"xxhash64({seed}, __source, {shard})"
    step = f"element_at(array({steps}), CAST(pmod({mixed}, {len(_STEPS)}) + 1 AS INT))"
    turn = f"pmod(shiftright({mixed}, 8), {SHARD_BLOCKS})"
    picked = f"pmod((k - {first}) * {step} + {turn}, {length}) < {quota}"
    overlap = f"(least(at + __size, (k + 1) * {block}) - greatest(at, k * {block}))"
    return F.expr(
        f"CASE WHEN rest = 0 OR __size = 0 THEN 0 ELSE aggregate(sequence(at div {block}, (at + __size - 1) div {block}), "
        f"CAST(0 AS BIGINT), (sum, k) -> sum + CASE WHEN {picked} THEN {overlap} ELSE 0 END) END"
    )
