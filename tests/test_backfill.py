"""Raw documents kept by choice, and what a wider specification brings back."""

from datetime import date

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from feedgate.operators import gates
from feedgate.operators.merge import merge_records
from feedgate.plans.apply import apply_ops
from feedgate.plans.backfill import RawZone, backfill, moves, newly_declared
from feedgate.spec import SpecSet
from test_merge import frame, op


def spec(**fields):
    return SpecSet.parse([{"collection": "a.one", "id": "$.id", "fields": {"sku": {"type": "string"}, **fields}}])


NARROW = spec()
WIDE = spec(n={"type": "number"})
WIDER = spec(n={"type": "number"}, list={"type": "array", "items": {"type": "object", "allow": ["x"]}})


def test_places_that_are_new():
    assert newly_declared(NARROW, WIDE) == {"a.one": ["n"]}
    assert newly_declared(WIDE, WIDER) == {"a.one": ["list", "list[]", "list[].x"]}
    assert newly_declared(WIDE, spec(n={"type": "string"})) == {"a.one": ["n"]} and newly_declared(WIDER, NARROW) == {}


def test_only_what_lost_the_place_and_still_stands_comes_back(spark, tmp_path):
    first = [
        op(1, 0, "plain"), op(1, 1, "n", payload='{"sku":"x","n":1}'), op(1, 2, "text", payload='{"n":"no number"}'),
        op(1, 3, "changed", payload='{"n":2}'), op(1, 4, "gone", payload='{"n":3}'), op(1, 5, "other", payload='{"junk":1}'),
        op(1, 6, "both", payload='{"n":4,"list":[{"x":5,"y":6}]}'), op(1, 7, "again", payload='{"n":5}'),
    ]
    then = [op(2, 0, "changed", payload='{"sku":"y"}'), op(2, 1, "gone", "delete", payload=None), op(2, 2, "again", payload='{"n":6}')]
    zone, records = RawZone(spark, str(tmp_path / "zone")), None
    assert zone.index().isEmpty()
    for ops in (first, then):
        sent = frame(spark, ops)
        applied = apply_ops(records, sent, NARROW)
        zone.keep(applied, sent)
        records = (applied.changes if records is None else merge_records(records, applied.changes)).checkpoint()
    labels = {(r.id, r.label) for r in zone.index().collect()}
    assert ("both", "list") in labels and ("other", "junk") in labels and not any(name == "plain" for name, _ in labels)
    done = backfill(records, zone, NARROW, WIDE)
    # "again" was sent once more, but its released content was the same: the record stands where the first one put it.
    got = {r.id: r.payload for r in done.changes.collect()}
    assert got == {"n": '{"n":1,"sku":"x"}', "both": '{"n":4}', "again": '{"n":5}'}
    assert {r.id: r.outcome for r in done.outcomes.collect()} == {"n": "stored", "both": "stored", "again": "stored", "text": "unchanged"}
    after = done.records.checkpoint()
    assert sorted(r.seq for r in done.changes.collect()) == [records.agg(F.max("seq")).first()[0] + k for k in (1, 2, 3)]
    assert backfill(after, zone, NARROW, WIDE).changes.isEmpty()
    # A second widening finds the moved document by its new position.
    assert backfill(after, zone, WIDE, WIDER).changes.isEmpty()
    zone.follow(moves(done), WIDE)
    assert {r.id: r.payload for r in backfill(after, zone, WIDE, WIDER).changes.collect()} == {"both": '{"list":[{"x":5}],"n":4}'}


def test_expired_documents_do_not_come_back(spark, tmp_path):
    sent = frame(spark, [op(1, 0, "n", payload='{"n":1}')])
    applied = apply_ops(None, sent, NARROW)
    zone = RawZone(spark, str(tmp_path / "zone"))
    records = applied.records.checkpoint()
    zone.keep(applied, sent)
    zone.expire(date(2000, 1, 1))
    assert not backfill(records, zone, NARROW, WIDE).changes.isEmpty()
    zone.expire(date(2999, 1, 1))
    assert zone.raw().isEmpty() and zone.index().isEmpty()
    assert backfill(records, zone, NARROW, WIDE).changes.isEmpty()


def test_no_side_that_grows_is_broadcast(spark, tmp_path, monkeypatch):
    """Every side that has a row per document is joined by a shuffle, from its rows and not its files."""
    monkeypatch.setattr(gates, "MAX_BROADCAST_BYTES", 1000, raising=False)
    plans, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, *a, **k: plans.append(w._df._jdf.queryExecution().executedPlan().toString()) or real(w, *a, **k))
    sent = frame(spark, [op(1, n, f"k{n}", payload=f'{{"sku":"x","n":{n}}}') for n in range(200)])
    applied = apply_ops(None, sent, NARROW)
    zone, records = RawZone(spark, str(tmp_path / "zone")), applied.records.checkpoint()
    plans.clear()
    zone.keep(applied, sent)
    done = backfill(records, zone, NARROW, WIDE)
    got = {r.id: (r.payload, r.seq) for r in done.records.collect()}
    assert got == {f"k{n}": (f'{{"n":{n},"sku":"x"}}', 201 + n) for n in range(200)}
    zone.follow(moves(done), WIDE)
    plans += [f._jdf.queryExecution().executedPlan().toString() for f in (done.changes, done.outcomes, done.records)]
    # What is left is the numbers of earlier rows, one per range.
    assert not [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line and "_part" not in line]
