"""Gates, batch verdicts, sources, the record table and streams."""

import json
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedgate.operators import counters, gates
from feedgate.operators.replica import fold_feed
from feedgate.plans.apply import apply_ops
from feedgate.sources import envelopes, scratch
from feedgate.sources.table import RecordTable
from feedgate.spec import SpecError, SpecSet
from feedgate.streaming.apply import apply_stream, feed_stream
from test_merge import SPECS, frame, model_rows, op, random_ops, snapshot
from model import Table


def verdicts(spark, ops, **options):
    applied = apply_ops(None, frame(spark, ops), SPECS, **options)
    return {r.batch_id: (r.ord, r.status, r.code) for r in applied.rejects.collect()}, applied


def test_codes_of_single_operations(spark):
    cases = {
        "missing_payload": [op(1, 0, "a", payload=None)],
        "missing_id": [op(2, 0, None)],
        "invalid_payload": [op(3, 0, "a", payload="[1]")],
        "payload_too_large": [op(4, 0, "a", payload='{"sku":"%s"}' % ("x" * 70000))],
        "payload_on_delete": [dict(op(5, 0, "a", "delete"), payload="{}")],
        "invalid_body": [op(6, 0, "a", payload="{oops")],
        "unknown_collection": [op(7, 0, "a", collection="c.three")],
        "invalid_path": [op(8, 0, "a", collection="Upper")],
        "unauthorized": [op(9, 0, "a", source=None)],
    }
    ops = [o for group in cases.values() for o in group]
    ops += [
        op(10, 0, None, "delete"), op(11, 0, "a/b"), op(12, 0, "a", "replace"),
        op(13, 0, None, payload='{"id":"x y","sku":"s"}'), op(14, 0, None, payload='{"id":" x"}'),
        op(15, 0, "a", payload="null"), op(16, 0, "a", payload='{"junk":"%s"}' % ("x" * 70000)),
        op(17, 0, None, payload="[1]"),
    ]
    got, applied = verdicts(spark, ops)
    for code, [o] in cases.items():
        assert got[o["batch_id"]][2] == code
    assert got["b4"] == (0, 413, "payload_too_large") and got["b7"][1] == 404 and got["b9"][1] == 401
    assert got["b10"][2] == "missing_id" and got["b11"][2] == "invalid_body" and got["b12"][2] == "invalid_body"
    assert got["b14"][2] == "missing_id" and got["b15"][2] == "missing_payload" and got["b17"][2] == "missing_id"
    assert "b13" not in got and "b16" not in got
    assert {r.id for r in applied.records.collect()} == {"x y", "a"}


def test_a_batch_is_all_or_nothing(spark):
    ops = [op(1, 0, "fine"), op(1, 1, "big", payload='{"sku":"%s"}' % ("x" * 70000)), op(1, 2, "z", payload=None)]
    ops += [op(2, n, f"k{n}") for n in range(5)]
    ops += [op(3, 0, "a", payload=None), op(3, 1, "b", payload="{bad")]
    ops += [op(4, n, f"m{n}") for n in range(4)] + [op(4, 4, "m", payload=None)]
    got, applied = verdicts(spark, ops, max_batch_ops=4)
    assert got == {
        "b1": (1, 413, "payload_too_large"),
        "b2": (None, 400, "batch_too_large"),
        "b3": (1, 400, "invalid_body"),  # a body that cannot be read hides the earlier error
        "b4": (None, 400, "batch_too_large"),
    }
    assert applied.records.isEmpty() and applied.outcomes.isEmpty()


def test_dropped_totals_stop_at_the_failing_operation(spark):
    junk = lambda n: '{"junk":%d,"sku":[%d]}' % (n, n)
    ops = [op(1, 0, "a", payload=junk(1)), op(1, 1, "b", payload='{"more":1,"sku":"%s"}' % ("x" * 70000)),
           op(1, 2, "c", payload=junk(2))]
    ops += [op(2, 0, "a", payload=junk(3)), op(2, 1, "b", payload=None)]
    ops += [op(3, 0, "a", payload=junk(4)), op(3, 1, "b", payload="{bad")]
    ops += [op(4, 0, "a", payload=junk(5))]
    _, applied = verdicts(spark, ops)
    totals = counters.dropped_totals(applied.staged, applied.rejects)
    assert {(r.field, r.reason, r.total) for r in totals.collect()} == {
        ("junk", "unknown_key", 3), ("sku", "type_mismatch", 3), ("more", "unknown_key", 1)
    }
    assert {r.id: [d.path for d in r.dropped] for r in applied.results().collect()} == {"a": ["junk", "sku"]}


def test_credentials_decide_the_source(spark):
    tokens = spark.createDataFrame(
        [("h1", "erp", "x", None), ("h2", "shop", "y", datetime(2024, 1, 1))],
        "token_hash string, source string, label string, revoked_at timestamp",
    )
    rows = [dict(op(n, 0, "a", source="forged"), token_hash=t) for n, t in enumerate(["h1", "h2", "h3", None])]
    ops = frame(spark, rows).join(
        spark.createDataFrame([(f"b{n}", t) for n, t in enumerate(["h1", "h2", "h3", None])], "batch_id string, token_hash string"),
        "batch_id",
    )
    applied = apply_ops(None, ops, SPECS, credentials=tokens)
    assert {r.batch_id for r in applied.rejects.collect() if r.code == "unauthorized"} == {"b1", "b2", "b3"}
    assert [(r.source, r.id) for r in applied.records.collect()] == [("erp", "a")]


def test_identifier_and_digest_gates(spark):
    ids = {"a": None, "": "empty", "x" * 512: None, "x" * 513: "too_long", "é" * 257: "too_long", "a/b": "char",
           "a?": "char", "a#": "char", "a\n": "char", " a": "boundary", "a ": "boundary", "a b": None, "ä": None}
    rows = spark.createDataFrame([(i,) for i in ids], "id string")
    assert {r.id: r.ident_error for r in gates.identifier_gate(rows).collect()} == ids
    names = {"a": None, "a.b-c_d": None, "A": "char", "a\n": "char", ".a": "boundary", "a-": "boundary",
             "": "empty", "x" * 129: "too_long", "ä": "char", "0": None}
    rows = spark.createDataFrame([(i,) for i in names], "id string")
    assert {r.id: r.ident_error for r in gates.identifier_gate(rows, grammar="name").collect()} == names
    digests = spark.createDataFrame([("A" * 64,), ("z" * 63,), ("z" * 64,), (None,)], "content_hash string")
    usable, bad = gates.digest_gate(digests)
    assert [r[0] for r in usable.collect()] == ["a" * 64]
    assert {r.digest_error for r in bad.collect()} == {"length", "not_hex", "missing"}
    known, unknown = gates.collection_gate(spark.createDataFrame([("a.one",), ("x",), (None,)], "collection string"), SPECS)
    assert known.count() == 1 and {r.code for r in unknown.collect()} == {"unknown_collection"}


def test_batch_files(spark, tmp_path):
    folder = tmp_path / "a.one"
    folder.mkdir()
    bodies = {
        1: '[{"op":"upsert","id":"a","payload":{"sku":"x", "n":5.0}},{"op":"delete","id":"b"},{"op":"upsert","payload":{"id":7}}]',
        2: '[{"op":"upsert","id":"a","payload":{},"extra":1}]',
        3: '{"op":"upsert"}',
        4: '[{"op":"delete","id":"a"}] trailing',
        5: '[{"op":"upsert","id":5,"payload":{}}]',
        6: '[{"op":"upsert","id":null,"payload":null}]',
        7: '[{"op":"upsert","id":"s","payload":"text"}]',
        8: "[]",
        9: '[{"op":"delete","id":"' + "x" * 400 + '"}]',
        10: '[{"op":"upsert","id":"a","payload":{"n":1e400}}]',
        11: "[7]",
    }
    for number, text in bodies.items():
        (folder / f"{number}.json").write_text(text)
    ops = envelopes.read_batches(spark, str(folder), source="erp", max_body_bytes=300).cache()
    applied = apply_ops(None, ops, SPECS)
    got = {int(r.batch_id.split("/")[-1][:-5]): r.code for r in applied.rejects.collect()}
    assert got == {2: "invalid_body", 3: "invalid_body", 4: "invalid_body", 5: "invalid_body", 6: "missing_payload",
                   7: "invalid_payload", 9: "payload_too_large", 10: "invalid_body", 11: "invalid_body"}
    assert {r.id: r.payload for r in applied.records.collect()} == {"a": '{"n":5,"sku":"x"}', "7": "{}"}
    assert [r.ord for r in ops.filter("batch_seq = 1").orderBy("ord").collect()] == [0, 1, 2]


def test_table_commits_and_compaction(spark, tmp_path):
    table, model = RecordTable(spark, str(tmp_path / "t"), SPECS), Table(SPECS)
    rng = random.Random(21)
    assert table.read().isEmpty() and table.max_seq() == 0
    for run in range(4):
        ops = random_ops(rng, 80, first_batch=run * 10)
        applied = apply_ops(table.read(), frame(spark, ops), SPECS, start=table.max_seq())
        number = table.commit(applied.changes, batch=("s", run), reports={"rejects": applied.rejects})
        assert table.commit(applied.changes.limit(0), batch=("s", run)) == number  # a replay changes nothing
        assert table.committed("s", run) == number and table.committed("t", run) is None
        model.run(ops)
        assert snapshot(table.read()) == model_rows(model)
        if run == 1:
            assert table.compact() == 2
            assert snapshot(table.read()) == model_rows(model)
    assert table.commits() == [1, 2, 3, 4] and table.bases() == [2]
    replica = fold_feed(None, table.feed())
    assert snapshot(replica) == {k: v for k, v in model_rows(model).items() if not v[1]}
    assert table.max_seq() == model.seq and table.reports("rejects").isEmpty() and table.reports("none") is None
    only = table.read(collections=["a.one"])
    assert snapshot(only) == {k: v for k, v in model_rows(model).items() if k[1] == "a.one"}
    table.compact()
    table.expire(keep_bases=1, keep_commits=1)
    assert table.commits() == [4] and table.bases() == [4]
    assert snapshot(table.read()) == model_rows(model) and table.max_seq() == model.seq
    table.purge_tombstones(10**9)
    assert snapshot(table.read()) == {k: v for k, v in model_rows(model).items() if not v[1]}
    assert table.last_commit() == 5 and table.max_seq() == model.seq


def test_scan_of_one_collection_reads_no_other(spark, tmp_path):
    table = RecordTable(spark, str(tmp_path / "t"), SPECS)
    table.commit(apply_ops(None, frame(spark, random_ops(random.Random(1), 60)), SPECS, start=0).changes)
    table.compact()
    rows = table.read(collections=["b.two"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "b.two" in plan.split("PartitionFilters: [")[1][:80]


def test_stream_commits_are_its_own(spark, tmp_path):
    """A table with history, two streams, replays, and a report that outlives a failing consumer."""
    table, model = RecordTable(spark, str(tmp_path / "t"), SPECS), Table(SPECS)
    first = random_ops(random.Random(5), 40)
    model.run(first)
    table.commit(apply_ops(None, frame(spark, first), SPECS, start=0).changes)
    for number, name in enumerate(("one", "two")):
        ops = random_ops(random.Random(6 + number), 40, first_batch=100 * (number + 1))
        bad = [{**ops[0], "batch_id": f"bad-{name}", "batch_seq": 900 + number, "op": "bogus"}]
        model.run(ops)
        envelopes.write_lines(frame(spark, ops + bad), str(tmp_path / name))

        def fail(*_):
            raise RuntimeError("the consumer died")

        stream = lambda: envelopes.stream_lines(spark, str(tmp_path / name))  # noqa: B023, E731
        with pytest.raises(Exception, match="consumer died"):
            apply_stream(stream(), table, str(tmp_path / f"cp-{name}"), on_applied=fail).awaitTermination(300)
        apply_stream(stream(), table, str(tmp_path / f"cp-{name}")).awaitTermination(300)
        assert snapshot(table.read()) == model_rows(model)
    assert table.commits() == [1, 2, 3]
    assert sorted(r.batch_id for r in table.reports("rejects").collect()) == ["bad-one", "bad-two"]
    assert table.reports("results").count() == 80


def test_intermediate_tables_go(spark, tmp_path):
    with scratch.scoped(spark):
        kept = scratch.save(spark.range(5), "gone")
        path = kept.inputFiles()[0]
        assert kept.count() == 5
    assert not os.path.exists(path.removeprefix("file://").removeprefix("file:"))


def test_stream_equals_batch(spark, tmp_path):
    rng, model = random.Random(33), Table(SPECS)
    ops = random_ops(rng, 150)
    model.run(ops)
    inbox = tmp_path / "in"
    for batch in sorted({o["batch_seq"] for o in ops}):
        part = frame(spark, [o for o in ops if o["batch_seq"] == batch]).coalesce(1)
        envelopes.write_lines(part, str(inbox))
    table = RecordTable(spark, str(tmp_path / "t"), SPECS)
    for _ in range(2):  # the second start finds nothing new
        stream = envelopes.stream_lines(spark, str(inbox), files_per_trigger=2)
        query = apply_stream(stream, table, str(tmp_path / "cp"))
        query.awaitTermination(300)
        assert snapshot(table.read()) == model_rows(model)
    assert len(table.commits()) == 4
    query = feed_stream(table).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    copy = fold_feed(None, spark.read.parquet(str(tmp_path / "out")))
    assert snapshot(copy) == {k: v for k, v in model_rows(model).items() if not v[1]}


@pytest.mark.parametrize(
    "change",
    [
        {"fields": {}}, {"fields": {"a.b": {"type": "string"}}}, {"fields": {"a": {"type": "object", "allow": []}}},
        {"fields": {"a": {"type": "array", "items": {"type": "object", "allow": []}}}},
        {"fields": {"a": {"type": "string", "indexed": True}}}, {"fields": {"a": {"type": "any"}}},
        {"filters": ["nope"]}, {"filters": ["pages"]}, {"filters": ["shelf", "shelf"]}, {"sort": ["pages"]},
        {"sort": ["seq", "seq"]}, {"colection": 1}, {"collection": "Bad"}, {"id": ""}, {"cache": {"max_age": 1}},
    ],
)
def test_specs_that_are_refused(change):
    good = {"collection": "c", "id": "$.id", "fields": {"shelf": {"type": "string", "index": True}, "pages": {"type": "number"}},
            "filters": ["shelf"], "sort": ["seq", "shelf"]}
    SpecSet.parse([good])
    with pytest.raises(SpecError):
        SpecSet.parse([{**good, **change}])


def test_spec_files(tmp_path):
    spec = {"collection": "c", "id": "id", "fields": {"a": {"type": "object", "allow": ["x"]}}}
    (tmp_path / "c.json").write_text(json.dumps(spec))
    loaded = SpecSet.load(tmp_path / "c.json")
    assert loaded["c"].id_path == ("id",) and loaded["c"].shared_max_age == 300
    with pytest.raises(SpecError):
        SpecSet.load(tmp_path / "c.json", tmp_path / "c.json")
