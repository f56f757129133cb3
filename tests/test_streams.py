"""Whole batches in streams, state kept in the stream, consumers and expiry."""

import random
import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedgate.operators.counters import OutcomeCounter
from feedgate.operators.indexing import with_index_columns
from feedgate.operators.merge import detect_outcomes
from feedgate.operators.replica import fold_feed
from feedgate.plans.apply import RECORD, apply_ops, judge
from feedgate.sources import envelopes, scratch
from feedgate.sources.table import Expired, RecordTable
from feedgate.streaming.apply import apply_stream, follow_feed
from feedgate.streaming import outcomes
from test_merge import SPECS, frame, op, random_ops

WHEN = datetime(2024, 1, 1)


def history(spark, path, runs=4, seed=21):
    """A table of so many commits of rows made by hand, and what it held after each."""
    table, rng, states, seq = RecordTable(spark, str(path), SPECS), random.Random(seed), [{}], 0
    for _ in range(runs):
        states.append(dict(states[-1]))
        seq = more(spark, table, rng, states[-1], seq)
    return table, states


def more(spark, table, rng, state, seq):
    when = datetime(2024, 1, 1)
    for key in sorted(rng.sample(range(20), 10)):
        seq += 1
        gone = rng.random() < 0.4
        payload = "{}" if gone else f'{{"sku":"{seq}"}}'
        state["erp", "a.one", f"k{key}"] = (seq, payload, gone)
    last = seq - 10
    rows = [(*k, s, p, "h", len(p), when, when if gone else None) for k, (s, p, gone) in state.items() if s > last]
    table.commit(with_index_columns(spark.createDataFrame(rows, RECORD), SPECS))
    return seq


def held(rows):
    return {(r.source, r.collection, r.id): (r.seq, r.payload, r.deleted_at is not None) for r in rows.collect()}


def test_versions_are_whole_or_refused(spark, tmp_path):
    table, states = history(spark, tmp_path / "t")
    for n in range(5):
        assert held(table.read(upto=n)) == states[n]
    table.compact()
    table.expire(keep_commits=1)
    assert table.expired() == 3 and table.commits() == [4]
    assert held(table.read()) == held(table.read(upto=4)) == states[4]
    for n in (1, 2, 3):
        with pytest.raises(Expired):
            table.read(upto=n)
        with pytest.raises(Expired):
            table.feed(after=n - 1)
    assert held(table.feed(after=3)).keys() <= states[4].keys()
    assert table.feed(after=4).isEmpty() and table.read(upto=0).isEmpty()
    with pytest.raises(ValueError):
        table.read(upto=9)


def test_an_older_base_still_serves_its_version(spark, tmp_path):
    table, states = history(spark, tmp_path / "t", runs=2)
    table.compact()
    more(spark, table, random.Random(1), {}, table.max_seq())
    now = held(table.read())
    table.compact()
    table.expire(keep_commits=1)
    assert held(table.read(upto=2)) == states[2] and held(table.read(upto=3)) == now


def test_consumers_hold_back_what_they_have_to_read(spark, tmp_path):
    table, states = history(spark, tmp_path / "t")
    table.register("slow", 2, now=1000, lease_seconds=100)
    table.register("fast", 4, now=1000, lease_seconds=100)
    assert table.low_watermark(now=1050) == 2 and table.low_watermark(now=1101) == 4
    table.compact()
    table.expire(keep_commits=1, now=1050)
    assert table.commits() == [3, 4] and table.expired() == 2
    # A consumer that stopped at 2 sees everything after it.
    copy = fold_feed(table.spark.createDataFrame([], table.schema), table.feed(after=2))
    assert held(copy).keys() <= states[4].keys()
    with pytest.raises(ValueError, match="slow"):
        table.purge_tombstones(table.max_seq(), now=1050)
    before, rows = table.seq_of(2), table.read().collect()
    table.purge_tombstones(now=1050)
    assert table.purged() == before
    left = {r.seq: r.deleted_at is not None for r in table.read().collect()}
    assert left == {r.seq: r.deleted_at is not None for r in rows if r.deleted_at is None or r.seq > before}
    assert len(left) < len(rows)
    assert {r.seq for r in table.changed_since(before).collect()} == {r.seq for r in rows if r.seq > before}
    with pytest.raises(Expired):
        table.changed_since(before - 1)
    # Its lease over, the slow one is not waited for, and is told so when it comes back.
    table.expire(keep_commits=1, now=2000)
    assert table.commits() == [4]
    with pytest.raises(Expired):
        table.feed(after=2)
    with pytest.raises(Expired):
        table.register("slow", 2)
    table.register("slow", 4)
    assert {n: c.commit for n, c in table.consumers().items()} == {"slow": 4, "fast": 4}
    table.unregister("fast")
    assert set(table.consumers()) == {"slow"}
    with pytest.raises(ValueError):
        table.register("a/b", 4)


def files_of(tmp_path, version):
    root = tmp_path / "t" / "base" / f"v={version}"
    return {str(f.relative_to(root)): f.stat().st_mtime_ns for f in root.rglob("*.parquet")}


def test_compaction_rewrites_only_collections_that_changed(spark, tmp_path):
    table = RecordTable(spark, str(tmp_path / "t"), SPECS)

    def commit(*rows):
        full = [("erp", c, i, s, "{}" if gone else '{"sku":"x"}', "h", 2, WHEN, WHEN if gone else None) for c, i, s, gone in rows]
        table.commit(with_index_columns(spark.createDataFrame(full, RECORD), SPECS))

    def now():
        return {(r.collection, r.id): r.seq for r in table.read().collect()}

    commit(("a.one", "x", 1, False), ("b.two", "y", 2, False), ("b.two", "z", 3, False))
    assert table.compact() == 1
    before = files_of(tmp_path, 1)
    commit(("b.two", "y", 4, False))
    assert table.compact() == 2 == table.compact()
    assert files_of(tmp_path, 1) == before and all("collection=b.two" in name for name in files_of(tmp_path, 2))
    assert now() == {("a.one", "x"): 1, ("b.two", "y"): 4, ("b.two", "z"): 3}
    assert {r.seq for r in table.read(upto=1).collect()} == {1, 2, 3}
    table.expire(keep_bases=1, keep_commits=1)
    assert table.bases() == [1, 2] and now() == {("a.one", "x"): 1, ("b.two", "y"): 4, ("b.two", "z"): 3}
    commit(("a.one", "x", 5, True))
    assert now()["a.one", "x"] == 5
    table.compact()
    commit(("a.one", "x", 6, False))
    table.compact()
    assert table.bases() == [1, 2, 3, 4] and now() == {("a.one", "x"): 6, ("b.two", "y"): 4, ("b.two", "z"): 3}
    table.expire(keep_bases=1, keep_commits=1)
    assert table.bases() == [1, 2, 4] and now() == {("a.one", "x"): 6, ("b.two", "y"): 4, ("b.two", "z"): 3}
    assert table.max_seq() == 6 and {r.id for r in table.read(collections=["a.one"]).collect()} == {"x"}
    # A purge writes all of the table, and nothing before it is needed any more.
    commit(("b.two", "y", 7, True), ("b.two", "z", 8, True))
    table.purge_tombstones()
    assert now() == {("a.one", "x"): 6}
    table.expire(keep_bases=1, keep_commits=1)
    assert len(table.bases()) == 1 and now() == {("a.one", "x"): 6}


def pieces(spark, path, *parts):
    """Line files as they come: each part a list of (batch, ops of it that are there, number it declares)."""
    for part in parts:
        ops = [o | {"n": n} for listed, n in part for o in listed]
        lines = frame(spark, [{k: v for k, v in o.items() if k != "n"} for o in ops])
        counts = spark.createDataFrame([(o["batch_id"], o["ord"], o["n"]) for o in ops], "batch_id string, ord int, batch_ops int")
        envelopes.write_lines(lines.join(counts, ["batch_id", "ord"]).coalesce(1), str(path))
        yield


def run_pieces(spark, tmp_path, *parts, **options):
    table = RecordTable(spark, str(tmp_path / "t"), SPECS)
    for _ in pieces(spark, tmp_path / "in", *parts):
        apply_stream(envelopes.stream_lines(spark, str(tmp_path / "in")), table, str(tmp_path / "cp"), **options).awaitTermination(300)
    rejects = {r.batch_id: r.code for r in table.reports("rejects").collect()}
    return table, rejects


def test_a_batch_split_over_micro_batches_is_stored_whole(spark, tmp_path):
    b1 = [op(1, n, f"k{n}") for n in range(3)]
    b2 = [op(2, 0, "z")]
    table, rejects = run_pieces(spark, tmp_path, [(b1[:1], 3)], [(b1[1:2], 3), (b2, 1)], [(b1[2:], 3)])
    assert rejects == {} and len(table.commits()) == 3
    seen = [sorted(r.id for r in table.feed(n - 1, n).collect()) for n in (1, 2, 3)]
    assert seen == [[], ["z"], ["k0", "k1", "k2"]]


def test_a_split_batch_with_a_fault_leaves_nothing(spark, tmp_path):
    b1 = [op(1, 0, "k1"), op(1, 1, "k2", "bogus")]
    table, rejects = run_pieces(spark, tmp_path, [(b1[:1], 2)], [(b1[1:], 2)])
    assert rejects == {"b1": "invalid_body"} and table.read().isEmpty()


def test_what_never_comes_is_refused_whole(spark, tmp_path):
    b1 = [op(1, 0, "a"), op(1, 1, "b")]
    table, rejects = run_pieces(spark, tmp_path, [(b1, 3)], [([op(2, 0, "c")], 1)], patience_seconds=0.0)
    assert rejects == {"b1": "incomplete_batch"} and [r.id for r in table.read().collect()] == ["c"]
    # Sent again as a whole it is stored.
    for _ in pieces(spark, tmp_path / "in", [(b1 + [op(1, 2, "d")], 3)]):
        apply_stream(envelopes.stream_lines(spark, str(tmp_path / "in")), table, str(tmp_path / "cp")).awaitTermination(300)
    assert sorted(r.id for r in table.read().collect()) == ["a", "b", "c", "d"]


def test_undeclared_and_disagreeing_numbers_are_refused(spark, tmp_path):
    parts = [([op(1, 0, "a"), op(1, 1, "b")], None), ([op(2, 0, "c")], 1), ([op(2, 1, "d")], 2), ([op(3, 0, "e"), op(3, 1, "f")], 1)]
    table, rejects = run_pieces(spark, tmp_path, parts)
    assert rejects == {"b1": "incomplete_batch", "b2": "invalid_body", "b3": "invalid_body"} and table.read().isEmpty()


def test_waiting_operations_outlive_expiry_and_failures(spark, tmp_path):
    b1 = [op(1, 0, "a"), op(1, 1, "b")]
    table, _ = run_pieces(spark, tmp_path, [(b1[:1], 2)])
    for n in range(3):  # other writers come in between
        table.commit(apply_ops(table.read(), frame(spark, [op(50 + n, 0, f"x{n}")]), SPECS, start=table.max_seq()).changes)
    table.compact()
    table.expire(keep_bases=1, keep_commits=1)
    assert 1 in table.commits()

    def fail(*_):
        raise RuntimeError("the consumer died")

    for _ in pieces(spark, tmp_path / "in", [(b1[1:], 2)]):
        for options in ({"on_applied": fail}, {}):
            query = apply_stream(envelopes.stream_lines(spark, str(tmp_path / "in")), table, str(tmp_path / "cp"), **options)
            if options:
                with pytest.raises(Exception, match="consumer died"):
                    query.awaitTermination(300)
            else:
                query.awaitTermination(300)
    assert sorted(r.id for r in table.read().collect()) == ["a", "b", "x0", "x1", "x2"]
    table.compact()
    table.expire(keep_bases=1, keep_commits=1)
    assert table.commits() == [max(table.commits())]


def test_followers_are_waited_for_and_told_of_gaps(spark, tmp_path):
    table, _ = history(spark, tmp_path / "t")
    seen = []

    def step(batch, number):
        seen.extend(r.seq for r in batch.collect())

    def follow(name, **options):
        seen.clear()
        follow_feed(table, name, str(tmp_path / f"cp-{name}"), step, files_per_trigger=1, **options).awaitTermination(300)
        return sorted(seen)

    whole = sorted(r.seq for r in table.feed().collect())
    assert follow("all") == whole and table.consumers()["all"].commit == 3
    begin = table.seq_of(2)
    assert follow("late", after_seq=begin) == [seq for seq in whole if seq > begin]
    table.compact()
    table.expire(keep_commits=1)
    assert table.commits() == [4] and follow("all") == []
    with pytest.raises(Expired):
        follow("new")
    assert follow("from3", after_seq=table.seq_of(3)) == [seq for seq in whole if seq > table.seq_of(3)]
    # A consumer whose lease is over is not waited for.
    table.unregister("all"), table.unregister("late"), table.unregister("from3")
    table.register("lost", 3, lease_seconds=-1)
    more(spark, table, random.Random(9), {}, table.max_seq())
    table.compact()
    table.expire(keep_commits=1)
    with pytest.raises(Expired):
        follow("lost")


def test_oversized_files_are_never_read(spark, tmp_path):
    folder = tmp_path / "a.one"
    folder.mkdir()
    (folder / "1.json").write_text('[{"op":"upsert","id":"a","payload":{}}]')
    (folder / "2.json").write_text("[" + " " * 5000 + "]")
    key = "spark.sql.sources.binaryFile.maxLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "1000")
    try:
        ops = envelopes.read_batches(spark, str(folder), source="erp", max_body_bytes=900)
        assert {(r.batch_id[-6:], r.envelope_error) for r in ops.collect()} == {("1.json", None), ("2.json", "body_too_large")}
    finally:
        spark.conf.set(key, before)


@pytest.fixture
def state_store(spark):
    key, provider = outcomes.STORE
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    yield
    spark.conf.set(key, before)


def test_state_in_the_stream_equals_the_batch_and_reads_the_base_once(spark, tmp_path, state_store):
    rng = random.Random(3)
    first, rest = random_ops(rng, 60), random_ops(rng, 90, first_batch=100)
    table = RecordTable(spark, str(tmp_path / "t"), SPECS)
    table.commit(apply_ops(None, frame(spark, first), SPECS, start=0).changes)
    base = scratch.save(table.read(), "base")
    where = base.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    judged = judge(frame(spark, rest), SPECS)
    numbers = sorted({o["batch_seq"] for o in rest})
    expected = {(r.batch_id, r.ord): r.outcome for r in detect_outcomes(outcomes.accepted_upserts(judged), base).collect()}
    assert {"stored", "unchanged", "tombstoned"} == set(expected.values())
    for turn in range(3):
        part = [o for o in rest if numbers.index(o["batch_seq"]) * 3 // len(numbers) == turn]
        envelopes.write_lines(frame(spark, part).coalesce(1), str(tmp_path / "in"))
        stream = outcomes.accepted_upserts(judge(envelopes.stream_lines(spark, str(tmp_path / "in")), SPECS))
        writer = outcomes.stream_outcomes(stream, base).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
        if turn == 0:
            shutil.rmtree(where)  # nothing may read the base again
    got = {(r.batch_id, r.ord): r.outcome for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == expected


def test_commits_keep_the_outcomes_they_counted(spark, tmp_path):
    table = RecordTable(spark, str(tmp_path / "t"), SPECS)
    assert table.outcome_totals().count() == 0
    rng = random.Random(8)
    refused = [op(900, 0, "k1", collection="a.none")]
    for ops in (random_ops(rng, 60), random_ops(rng, 80, first_batch=300), refused, []):
        if ops:
            envelopes.write_lines(frame(spark, ops).coalesce(1), str(tmp_path / "lines"))
        # The last run finds nothing new, and counts nothing twice.
        lines = envelopes.stream_lines(spark, str(tmp_path / "lines"))
        apply_stream(lines, table, str(tmp_path / "state")).awaitTermination()
    want = {}
    for number in table.commits():
        for row in spark.read.parquet(f"{table.path}/log/commit={number}/_reports/results").collect():
            key = number, row.collection, row.outcome
            want[key] = want.get(key, 0) + 1
    assert len({number for number, *_ in want}) == 2 and len(table.commits()) == 3
    assert {(r.commit, r.collection, r.outcome): r.total for r in table.outcome_totals().collect()} == want


def test_outcomes_are_counted_as_they_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", "stored"), ("a", "stored"), ("b", "tombstoned"), ("c", "stored"), (None, None)], "collection string, outcome string")
    counter = OutcomeCounter(["a", "b", "x"])
    counter.watch(rows.repartition(3)).write.parquet(str(tmp_path / "out"))
    assert counter.totals() == [("a", "stored", 2), ("b", "tombstoned", 1)]
    nothing = OutcomeCounter([])
    nothing.watch(rows.limit(0)).write.parquet(str(tmp_path / "none"))
    assert nothing.totals() == []
