"""What is moved between tasks, and that moving less changes no result."""

import hashlib
import random
from datetime import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from feedgate.operators import gates, merge, summary
from feedgate.plans import inputs
from feedgate.plans.apply import RECORD, reproject
from feedgate.streaming.outcomes import KeyOutcomes

WHEN = datetime(2024, 1, 1)
OPS = "source string, collection string, id string, batch_id string, batch_seq long, ord int, op string, content_hash string"


def joins(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Join " in line for line in plan.splitlines())


def test_places_are_marked_in_words(spark, monkeypatch):
    written = []
    monkeypatch.setattr(gates, "sized", lambda frame, label="side": written.append(frame) or frame)
    draw = random.Random(3)
    rows = [("good", n, None) for n in range(-70, 500)]
    rows += [("twice", n, None) for n in [*range(200), 130, 190]] + [("late", n, "missing_id" if n == 40 else None) for n in range(90)]
    rows += [("nowhere", None, "invalid_body"), ("nowhere", None, "invalid_body"), ("many", 1, "missing_payload"), ("many", 64, None), ("many", 64, None)]
    rows += [(None, 5, None), (None, 5, None)]
    draw.shuffle(rows)
    judged = spark.createDataFrame(rows, "batch_id string, ord int, code string").repartition(3)
    found = {r.batch_id: (r.ord, r.code) for r in gates.batch_verdicts(judged, 1000).collect()}
    assert found == {
        "twice": (130, "invalid_body"), "late": (40, "missing_id"), "nowhere": (None, "invalid_body"),
        "many": (64, "invalid_body"), None: (5, "invalid_body"),
    }
    assert sum(frame.count() for frame in written) <= len(rows) / 20
    assert {r.batch_id: r.code for r in gates.batch_verdicts(judged, 300).collect()}["good"] == "batch_too_large"


def test_hot_keys_are_looked_for_in_buckets(spark):
    rows = spark.range(3000).select(F.lit("s").alias("source"), F.lit("c").alias("collection"), F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("id"))
    assert [tuple(r) for r in merge.hot_keys(rows, 800).collect()] == [("s", "c", "hot")]
    cold = merge.hot_keys(rows, 900)
    assert "Exchange" not in cold._jdf.queryExecution().executedPlan().toString() and cold.isEmpty()


def test_marked_changes_equal_the_aggregate(spark):
    draw = random.Random(9)
    rows = [
        ("s", "c", f"k{draw.randint(0, 60)}", f"b{n // 50}", n // 50, n % 50, op, hashlib.sha256(bytes([draw.randint(0, 2)])).hexdigest() if op == "upsert" else None)
        for n in range(900) for op in [draw.choice(["upsert", "upsert", "delete"])]
    ]
    base = spark.createDataFrame([("s", "c", f"k{n}", n + 1, "{}", hashlib.sha256(bytes([n % 3])).hexdigest(), 2, WHEN, None) for n in range(0, 60, 2)], RECORD)
    ops = spark.createDataFrame(rows, OPS)
    plain = merge.detect_outcomes(ops, base)
    marked = merge.detect_outcomes(ops.withColumn("content_hash", merge.packed(F.col("content_hash"))), base, mark_last=True)
    at = ["batch_id", "ord", "outcome"]
    assert sorted(map(tuple, plain.select(at).collect())) == sorted(map(tuple, marked.select(at).collect()))
    seq = F.when(F.col("outcome") != "unchanged", F.col("batch_seq") * 50 + F.col("ord"))
    one, two = (merge.last_changes(f.withColumn("seq", seq)).select(*merge.KEY, "seq", "op", "batch_id", "ord") for f in (plain, marked))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    numbered = marked.withColumn("seq", seq).drop("content_hash").localCheckpoint()
    assert "Aggregate" not in merge.last_changes(numbered)._jdf.queryExecution().executedPlan().toString()


def test_reprojected_rows_meet_their_positions_without_a_join(spark):
    payload = '{"cents":1,"priority":"high","status":"F"}'
    digest = hashlib.sha256(payload.encode()).hexdigest()
    rows = [("erp", "sales.order", str(n), n + 1, payload if n % 3 else "[1]", digest, len(payload), WHEN, None) for n in range(30)]
    done = reproject(spark.createDataFrame(rows, RECORD), inputs.NARROWER)
    assert joins(done.changes) == 1  # the numbers of earlier rows, one per range
    got = {r.id: (r.seq, r.deleted_at is not None) for r in done.changes.collect()}
    assert got == {str(n): (31 + n, n % 3 == 0) for n in range(30)}
    assert {r.id: r.seq for r in done.outcomes.collect()} == {str(n): 31 + n for n in range(30)}


def broadcasts(frame):
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("BroadcastHashJoin")


def test_many_keys_in_small_files_are_not_broadcast(spark):
    """Half a million keys in order take a byte or two each in their files, and a hundred in the driver."""
    keys = [F.lit("erp").alias("source"), F.lit("sales.order").alias("collection"), F.col("id").cast("string").alias("id")]
    rows = spark.range(600_000).select(*keys, (F.col("id") + 1).alias("seq"))
    changed = rows.filter("seq % 6 > 0").withColumn("seq", F.col("seq") + 1_000_000)
    after = merge.merge_records(rows, changed)
    assert broadcasts(after) == 0
    assert after.agg(F.count("id"), F.countDistinct("id"), F.count_if(F.col("seq") > 1_000_000)).first() == (600_000, 600_000, 500_000)
    assert broadcasts(merge.merge_records(rows, changed.limit(1000))) == 1


def test_reprojected_collections_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(gates, "MAX_BROADCAST_BYTES", 1000, raising=False)
    names = ["sales.order", "part.sheet", "user.activity"]
    rows = [("erp", name, str(n), 3 * n + at + 1, '{"name":"x"}', "0" * 64, 12, WHEN, None) for n in range(40) for at, name in enumerate(names)]
    done = reproject(spark.createDataFrame(rows, RECORD).checkpoint(), inputs.NARROWER_STILL, start=1000)
    assert broadcasts(done.records) == 1  # the numbers of earlier rows, one per range
    got = {(r.collection, r.id): (r.payload, r.seq > 1000) for r in done.records.collect()}
    assert got == {(c, i): (p if c == "user.activity" else "{}", c != "user.activity") for _, c, i, _, p, *_ in rows}


def test_checksums_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(summary, "PIECE_BYTES", 300)
    rows = [(s, "c", f"{n}\"\\x", hashlib.sha256(str(n).encode()).hexdigest() if n % 7 else f"odd{n}", WHEN if n % 11 == 0 else None) for s in "ab" for n in range(400)]
    records = spark.createDataFrame(rows, "source string, collection string, id string, content_hash string, deleted_at timestamp").repartition(5)
    frame = summary.collection_checksums(records)
    alive = sorted((i, h) for s, _, i, h, gone in rows if s == "a" and gone is None)
    text = ",".join('["' + i.replace("\\", "\\\\").replace('"', '\\"') + f'","{h}"]' for i, h in alive)
    want = hashlib.sha256(f"[{text}]".encode()).hexdigest()
    assert {tuple(r) for r in frame.collect()} == {(s, "c", want) for s in "ab"}
    # Pairs are sorted by ranges; what meets in the one task of a collection is pieces.
    assert "rangepartitioning" in frame._jdf.queryExecution().executedPlan().toString()


def test_state_is_handled_by_rows():
    class Kept:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    keeper = KeyOutcomes()
    keeper._left = Kept()
    op = lambda ord, op, digest: Row(batch_id="b", batch_seq=1, ord=ord, op=op, content_hash=digest)
    ops = [op(2, "delete", None), op(0, "upsert", "x"), op(3, "delete", None), op(1, "upsert", "x")]
    out = list(keeper.handleInputRows(("s", "c", "k"), iter(ops), None))
    assert [(r.ord, r.outcome) for r in out] == [(0, "stored"), (1, "unchanged"), (2, "tombstoned"), (3, "unchanged")]
    assert keeper._left.value == (False, None)
