"""Outcomes, sequence numbers and the merged table against a sequential model."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedgate.limits import EMPTY_DOCUMENT_HASH
from feedgate.operators.merge import KEY, detect_outcomes
from feedgate.operators.numbering import number_rows
from feedgate.operators.replica import newest
from feedgate.plans.apply import OPS, apply_ops, reproject
from feedgate.spec import CollectionSpec, FieldSpec, SpecSet
from model import Table

SPECS = SpecSet(
    CollectionSpec(
        name, ("id",),
        {"sku": FieldSpec.scalar("string", True), "n": FieldSpec.scalar("number", True)},
        filters=("sku", "n"),
    )
    for name in ("a.one", "b.two")
)
WHEN = datetime(2024, 5, 1)


def op(batch, ord, id, kind="upsert", payload='{"sku":"x"}', collection="a.one", source="erp"):
    return {
        "batch_id": f"b{batch}", "batch_seq": batch, "ord": ord, "source": source,
        "collection": collection, "op": kind, "id": id,
        "payload": None if kind == "delete" else payload, "arrived_at": WHEN,
    }


def frame(spark, ops):
    names = [part.split()[0] for part in OPS.split(", ")]
    return spark.createDataFrame([tuple(o[n] for n in names) for o in ops], OPS)


def random_ops(rng, count, first_batch=0, keys=40):
    ops = []
    for at in range(count):
        hot = rng.random() < 0.34
        ident = "hot" if hot else f"k{rng.randrange(keys)}"
        kind = "delete" if rng.random() < 0.3 else "upsert"
        payload = '{"n":%d,"junk":%d}' % (rng.randrange(3), rng.randrange(9))
        ops.append(op(first_batch + at // 20, at % 20, ident, kind, payload, rng.choice(["a.one", "b.two"])))
    return ops


def snapshot(records):
    return {
        (r.source, r.collection, r.id): (r.payload, r.deleted_at is not None, r.seq, r.content_hash)
        for r in records.collect()
    }


def model_rows(table):
    return {k: (v["payload"], v["deleted"], v["seq"], v["hash"]) for k, v in table.rows.items()}


def answers(applied):
    return {(r.batch_id, r.ord): (r.outcome, r.seq) for r in applied.outcomes.collect()}


@pytest.mark.parametrize("hot_threshold", [10**6, 25])
def test_runs_match_the_model(spark, hot_threshold):
    rng = random.Random(3)
    table, records = Table(SPECS), None
    for run in range(2):
        ops = random_ops(rng, 500, first_batch=run * 100)
        rng.shuffle(ops)
        applied = apply_ops(
            records, frame(spark, ops), SPECS,
            hot_threshold=hot_threshold,
        )
        assert answers(applied) == table.run(ops)
        assert snapshot(applied.records) == model_rows(table)
        records = applied.records
    assert applied.rejects.isEmpty()


def test_blocks_of_one_batch(spark):
    rng = random.Random(5)
    ops = random_ops(rng, 400)
    plain = frame(spark, ops).withColumn("content_hash", F.sha2("payload", 256))
    one = detect_outcomes(plain)
    many = detect_outcomes(plain, hot_threshold=5, batches_per_block=1)
    pick = lambda d: {(r.batch_id, r.ord): r.outcome for r in d.collect()}
    assert pick(one) == pick(many) and len(pick(one)) == 400


def test_known_sequences(spark):
    ops = [
        op(1, 0, "twice", payload='{"sku":"x","n":1}'), op(1, 1, "twice", payload='{"n":1.0,"sku":"x"}'),
        op(1, 2, "gone"), op(1, 3, "gone", "delete"), op(1, 4, "gone", "delete"),
        op(1, 5, "never", "delete"),
        op(2, 0, "back"), op(2, 1, "back", "delete"), op(2, 2, "back"),
        op(2, 3, "two", payload='{"n":1}'), op(2, 4, "two", payload='{"n":2}'),
    ]
    applied = apply_ops(None, frame(spark, ops), SPECS)
    got = [answers(applied)[(o["batch_id"], o["ord"])] for o in ops]
    assert got == [
        ("stored", 1), ("unchanged", None), ("stored", 2), ("tombstoned", 3), ("unchanged", None),
        ("unchanged", None), ("stored", 4), ("tombstoned", 5), ("stored", 6), ("stored", 7), ("stored", 8),
    ]
    rows = {r.id: r for r in applied.records.collect()}
    assert set(rows) == {"twice", "gone", "back", "two"}
    assert rows["gone"].payload == "{}" and rows["gone"].content_hash == EMPTY_DOCUMENT_HASH
    assert rows["gone"].deleted_at == WHEN and rows["back"].deleted_at is None
    assert rows["two"].payload == '{"n":2}' and rows["two"].idx_number_n == 2.0


def test_applying_again_changes_nothing(spark):
    ops = [o for o in random_ops(random.Random(9), 200) if o["op"] == "upsert"]
    last = {}
    for o in ops:
        last[(o["collection"], o["id"])] = o
    ops = list(last.values())
    first = apply_ops(None, frame(spark, ops), SPECS)
    again = apply_ops(first.records, frame(spark, ops), SPECS)
    assert {r.outcome for r in again.outcomes.collect()} == {"unchanged"}
    assert again.changes.isEmpty()
    assert snapshot(again.records) == snapshot(first.records)


def test_one_run_equals_many(spark):
    ops = random_ops(random.Random(13), 120)
    whole = apply_ops(None, frame(spark, ops), SPECS)
    records = None
    for batch in sorted({o["batch_seq"] for o in ops}):
        part = [o for o in ops if o["batch_seq"] == batch]
        records = apply_ops(records, frame(spark, part), SPECS).records.checkpoint()
    assert snapshot(whole.records) == snapshot(records)


def test_row_numbers_are_dense_and_in_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    numbered = number_rows(rows, [F.col("k").asc()], "n", "test").orderBy("k").collect()
    assert [r.n for r in numbered] == list(range(1, 5001))


def test_merge_plan_has_one_exchange_on_the_key(spark):
    ops = frame(spark, random_ops(random.Random(1), 50)).withColumn("content_hash", F.sha2("payload", 256))
    base = apply_ops(None, frame(spark, random_ops(random.Random(2), 50)), SPECS).records
    plan = detect_outcomes(ops, base.checkpoint())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(source") <= 2 and "CartesianProduct" not in plan
    assert "Window" in plan


def test_operations_without_place_refuse_their_batch(spark):
    ops = [op(1, 0, "a"), {**op(1, 1, "b"), "ord": None}, op(2, 0, "c"), {**op(2, 1, "d"), "batch_seq": None}, op(3, 0, "e")]
    ops += [{**op(4, 0, "f"), "batch_id": None}, {**op(4, 1, "g", "bogus"), "batch_id": None}]
    applied = apply_ops(None, frame(spark, ops), SPECS)
    assert {(r.batch_id, r.code) for r in applied.rejects.collect()} == {(b, "invalid_body") for b in ("b1", "b2", None)}
    assert [(r.batch_id, r.id) for r in applied.outcomes.collect()] == [("b3", "e")]
    assert [r.id for r in applied.records.collect()] == ["e"]


def test_repeated_places_refuse_their_batch(spark):
    ops = [op(1, 0, "a"), op(1, 0, "b", payload='{"n":2}'), op(2, 0, "c")]
    applied = apply_ops(None, frame(spark, ops), SPECS)
    assert [(r.batch_id, r.ord, r.code) for r in applied.rejects.collect()] == [("b1", 0, "invalid_body")]
    assert [r.id for r in applied.records.collect()] == ["c"]


def test_batches_of_equal_number_are_ordered_by_name(spark):
    ops = [{**op(1, 0, "a", payload='{"n":%d}' % n), "batch_id": name} for n, name in ((1, "x"), (2, "y"), (3, "z"))]
    applied = apply_ops(None, frame(spark, ops[::-1]), SPECS)
    assert [(r.batch_id, r.seq) for r in applied.outcomes.orderBy("seq").collect()] == [("x", 1), ("y", 2), ("z", 3)]
    assert applied.records.first().payload == '{"n":3}'


def test_newest_rows_carry_no_payload_through_a_sort(spark):
    rows = apply_ops(None, frame(spark, random_ops(random.Random(4), 60)), SPECS).changes.checkpoint()
    plan = newest(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "max_by" not in plan
    twice = rows.unionByName(rows.filter("seq % 2 = 0"))
    assert snapshot(newest(twice)) == snapshot(rows) and newest(twice).count() == rows.count()


def test_reprojection_writes_what_changes_and_settles(spark):
    first = apply_ops(None, frame(spark, random_ops(random.Random(8), 80)), SPECS).records.checkpoint()
    narrow = SpecSet(CollectionSpec(n, ("id",), {"sku": FieldSpec.scalar("string", True)}, filters=("sku",)) for n in ("a.one", "b.two"))
    once = reproject(first, narrow)
    rows = once.records.drop("idx_number_n").checkpoint()
    alive = {(r.source, r.collection, r.id) for r in first.collect() if r.deleted_at is None}
    assert {r.payload for r in rows.collect()} == {"{}"} and {tuple(r)[:3] for r in once.changes.collect()} == alive
    assert reproject(rows, narrow).changes.isEmpty()


def test_reprojection_judges_rows_one_by_one(spark):
    """Two collections, a narrower specification for one; one of its rows is broken, one too large."""
    rows = apply_ops(None, frame(spark, random_ops(random.Random(9), 80)), SPECS).records.checkpoint()
    one = rows.filter("collection = 'a.one' AND deleted_at IS NULL")
    broken, large, *others = [r.id for r in one.orderBy("id").collect()]
    assert others
    spoiled = rows.withColumn(
        "payload",
        F.when(one_row(broken), "not json").when(one_row(large), F.concat(F.lit('{"sku":"'), F.repeat(F.lit("x"), 70_000), F.lit('"}'))).otherwise(F.col("payload")),
    ).checkpoint()
    narrow = SpecSet([CollectionSpec("a.one", ("id",), {"sku": FieldSpec.scalar("string", True)}, filters=("sku",))])
    done = reproject(spoiled, narrow)
    after = {(r.source, r.collection, r.id): r for r in done.records.collect()}
    assert len(after) == rows.count()
    assert {(r.id, r.code) for r in done.withheld().collect()} == {(broken, "invalid_body")}
    for r in rows.collect():
        now = after[r.source, r.collection, r.id]
        if r.collection != "a.one" or r.deleted_at is not None:
            assert (now.seq, now.payload) == (r.seq, r.payload)
        else:
            assert '"n"' not in now.payload and (now.deleted_at is not None) == (now.id == broken)
            assert now.payload_bytes > 70_000 or now.id != large
    left = {(r.source, r.collection): r.rows for r in done.undeclared.collect()}
    assert left and all(name == "b.two" for _, name in left)
    assert reproject(done.records.checkpoint(), narrow).changes.isEmpty()
    gone = reproject(spoiled, narrow, withhold_undeclared=True).records
    assert gone.filter("collection = 'b.two' AND deleted_at IS NULL").isEmpty()


def one_row(name):
    return (F.col("collection") == "a.one") & (F.col("id") == name) & F.col("deleted_at").isNull()


def test_reprojection_moves_no_row_to_find_out(spark):
    rows = apply_ops(None, frame(spark, random_ops(random.Random(8), 80)), SPECS).records.checkpoint()
    seen = []
    import feedgate.plans.apply as plan

    real = plan.save
    try:
        plan.save = lambda f, label, *p: seen.append((label, f._jdf.queryExecution().executedPlan().toString())) or real(f, label, *p)
        reproject(rows, SpecSet([SPECS["a.one"]]))
    finally:
        plan.save = real
    assert "Exchange" not in dict(seen)["reprojected"]
