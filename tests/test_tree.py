"""Digest trees, position bitmaps, and reads that skip what they do not need."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedgate.operators import positions, reads, summary, tree
from feedgate.operators.indexing import with_index_columns
from feedgate.plans.apply import RECORD
from feedgate.sources.table import RecordTable
from test_merge import SPECS

WHEN = datetime(2024, 1, 1)


def listing(spark, pairs):
    rows = [(s, "a.one", i, h) for s, i, h in pairs]
    return spark.createDataFrame(rows, "source string, collection string, id string, content_hash string")


def scanned(frame):
    """Rows that the scans of a plan produced, after it has run."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    total, waiting = 0, [plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif hasattr(node, "plan") and name.endswith("QueryStageExec"):
            waiting.append(node.plan())
        if name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        waiting += [children.apply(k) for k in range(children.size())]
    return total


def expected(ours, theirs):
    out = set()
    mine, other = {(s, i): h for s, i, h in ours}, {(s, i): h for s, i, h in theirs}
    for key in mine.keys() | other.keys():
        kind = "missing" if key not in mine else "extra" if key not in other else "changed" if mine[key] != other[key] else None
        if kind:
            out.add((key[0], "a.one", key[1], kind))
    return out


@pytest.mark.parametrize("changes", [1, None])
def test_descent_equals_the_plain_report(spark, tmp_path, changes):
    rng = random.Random(changes)
    ours = [(s, f"k{n}", f"h{n}") for s in ("erp", "shop") for n in range(1500)]
    theirs = list(ours)
    for _ in range(changes if changes is not None else 3000):
        at = rng.randrange(len(theirs))
        source, name, _ = theirs[at]
        theirs[at] = rng.choice([(source, name, f"z{at}"), (source, f"{name}x{at}", "h")])
    one, two = listing(spark, ours), listing(spark, theirs)
    found = tree.tree_drift(tree.Listing.write(one, str(tmp_path / "a")), tree.Listing.write(two, str(tmp_path / "b")))
    assert {tuple(r) for r in found.collect()} == expected(ours, theirs) == {tuple(r) for r in summary.drift_report(one.withColumn("deleted_at", F.lit(None).cast("timestamp")), two).collect()}


def test_equal_stretches_are_not_read(spark, tmp_path):
    ours = spark.range(60_000).select(
        F.lit("erp").alias("source"), F.lit("a.one").alias("collection"), F.concat(F.lit("k"), "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("content_hash")
    )
    theirs = ours.withColumn("content_hash", F.when(F.col("id") == "k77", "other").otherwise(F.col("content_hash")))
    a, b = tree.Listing.write(ours, str(tmp_path / "a")), tree.Listing.write(theirs, str(tmp_path / "b"))
    found = tree.tree_drift(a, b)
    assert 0 < scanned(found) <= 120_000 / 100
    assert [tuple(r) for r in found.collect()] == [("erp", "a.one", "k77", "changed")]


def test_trees_move_on_with_changes_alone(spark, tmp_path):
    kinds = "source string, collection string, id string, content_hash string, deleted_at timestamp"
    rows = lambda pairs: spark.createDataFrame([("erp", "a.one", i, h, WHEN if h is None else None) for i, h in pairs], kinds)
    before = {f"k{n}": f"h{n}" for n in range(300)}
    changes = {"k1": "new", "k2": None, "k3": "h3", "fresh": "f"}
    after = {k: v for k, v in (before | changes).items() if v is not None}
    digests = tree.leaf_digests(rows(before.items()))
    moved = tree.moved_on(digests, rows([(k, v) for k, v in before.items() if k in changes]), rows(changes.items()))
    assert sorted(moved.collect()) == sorted(tree.leaf_digests(rows(after.items())).collect())
    gone = tree.moved_on(digests, rows(before.items()), rows([(k, None) for k in before]))
    assert gone.collect() == []


def test_empty_listings(spark, tmp_path):
    empty, one = listing(spark, []), listing(spark, [("erp", "a", "h")])
    stored = [tree.Listing.write(frame, str(tmp_path / name)) for frame, name in ((empty, "e"), (one, "o"))]
    assert tree.tree_drift(stored[0], stored[0]).collect() == []
    assert [r.drift for r in tree.tree_drift(*stored).collect()] == ["missing"]
    assert [r.drift for r in tree.tree_drift(*stored[::-1]).collect()] == ["extra"]


def test_bitmaps_name_repeated_and_missing_positions(spark):
    rng = random.Random(2)
    held = [rng.randrange(1, 100_000) for _ in range(3000)] + [1, 32768, 32769, 65536, 65536, 99_999] + list(range(32769, 65537))
    rows = spark.createDataFrame([(n, i % 7) for i, n in enumerate(held)] + [(None, 1), (0, 1)], "seq long, commit long")
    kept = positions.position_bitmaps(rows, F.col("commit")).checkpoint()
    counts = {n: held.count(n) for n in set(held) if held.count(n) > 1}
    assert {r.seq: r.rows for r in positions.repeated(kept, rows).collect()} == counts
    assert {r.seq for r in positions.gaps(kept, 99_999).collect()} == set(range(1, 100_000)) - set(held)
    assert positions.gaps(kept.limit(0), 40_000).count() == 40_000 and positions.gaps(kept, 0).count() == 0
    whole = positions.position_bitmaps(spark.range(1, 70_000).withColumnRenamed("id", "seq"), 1)
    assert positions.gaps(whole, 69_999).isEmpty() and positions.repeated(whole, rows.limit(0)).isEmpty()
    [first] = positions.merged(whole).filter("bucket = 1").collect()
    assert (first.rows, first.positions) == (32768, 32768)


def test_lookups_and_filters_skip_row_groups(spark, tmp_path):
    """Ids and values are spread over all row groups of a base; a read touches those that may hold them."""
    table = RecordTable(spark, str(tmp_path / "t"), SPECS, row_group_bytes=40_000)
    n = 40_000
    sku = F.concat(F.lit("s"), F.xxhash64("id").cast("string"))
    payload = F.concat(F.lit('{"sku":"'), sku, F.lit('"}'))
    rows = spark.range(n).select(
        F.lit("erp").alias("source"), F.lit("a.one").alias("collection"), F.concat(F.lit("k"), (F.col("id") * 7919) % n).alias("id"),
        (F.col("id") + 1).alias("seq"), payload.alias("payload"), F.sha2(payload, 256).alias("content_hash"),
        F.length(payload).alias("payload_bytes"), F.lit(WHEN).alias("ingested_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    table.commit(with_index_columns(rows.select(*[name.split()[0] for name in RECORD.split(", ")]), SPECS))
    table.compact()
    found = reads.lookup(table.read(), "erp", "a.one", "k1234")
    assert found.count() == 1 and scanned(found) <= n / 10
    value = found.select("idx_string_sku").first()[0]
    chosen = reads.parse_filter(SPECS["a.one"], [("sku", value)])
    base = table.read()
    filtered = base.filter(F.col("collection") == "a.one").filter(reads.filter_column(SPECS["a.one"], chosen, base.columns))
    assert [r.id for r in filtered.collect()] == ["k1234"] and scanned(filtered) <= n / 10
    later = table.read().filter(F.col("seq") > n - 50)
    assert later.count() == 50 and scanned(later) <= n / 10
