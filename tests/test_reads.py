"""Listings, feeds, budgets, digests, walks, checksums, drift, validators and shapes."""

import hashlib
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feedgate.functions.exact import canonical
from feedgate.functions.labels import label_path
from feedgate.limits import EMPTY_DOCUMENT_HASH, clamp_bytes, clamp_records
from feedgate.operators import counters, freshness, integrity, reads, replica, shapes, summary, walk
from feedgate.operators.indexing import with_index_columns
from feedgate.plans.apply import RECORD
from feedgate.spec import CollectionSpec, FieldSpec

SPEC = CollectionSpec(
    "c.one", ("id",),
    {
        "sku": FieldSpec.scalar("string", True), "stock": FieldSpec.scalar("number", True),
        "active": FieldSpec.scalar("boolean", True), "price": FieldSpec.scalar("number"),
        "attributes": FieldSpec.object(["sku"]),
    },
    filters=("sku", "stock", "active"),
)
WHEN = datetime(2024, 5, 1, 12, 30, 1, 250000)


def record(id, seq, payload="{}", deleted=False, source="erp", collection="c.one"):
    text = "{}" if deleted else payload
    digest = hashlib.sha256(text.encode()).hexdigest()
    return (source, collection, id, seq, text, digest, len(text.encode()), WHEN, WHEN if deleted else None)


def table(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def doc(size):
    return '{"sku":"%s"}' % ("x" * (size - 10))


def ids(frame):
    return [r.id for r in frame.orderBy("seq").collect()]


@pytest.fixture(scope="module")
def stock(spark):
    rows = [
        record("a", 1, '{"active":true,"sku":"s1","stock":3}'),
        record("b", 2, '{"attributes":{"sku":"s1"},"sku":"s2","stock":3}'),
        record("c", 3, "{}", deleted=True),
        record("d", 5, '{"active":false,"sku":"s1","stock":9007199254740993}'),
        record("e", 4, '{"stock":2.5}'),
        record("a", 6, '{"sku":"s1"}', source="shop"),
    ]
    return table(spark, rows)


@pytest.mark.parametrize("indexed", [False, True])
def test_listing_and_filters(spark, stock, indexed):
    records = with_index_columns(stock, SPEC) if indexed else stock
    page = lambda *f, **k: ids(reads.listing(records, SPEC, "erp", f, **k))
    assert page() == ["a", "b", "e", "d"]
    assert page(("sku", "s1")) == ["a", "d"]
    assert page(("stock", "3")) == page(("stock", "3.0")) == ["a", "b"]
    assert page(("stock", "2.5")) == ["e"]
    assert page(("stock", "9007199254740993")) == ["d"] and page(("stock", "9007199254740992")) == []
    assert page(("sku", "s1"), ("active", "true")) == ["a"]
    assert page(after=2) == ["e", "d"] and page(limit=0) == ["a"]
    assert ids(reads.listing(records, SPEC, "nobody")) == []


@pytest.mark.parametrize(
    "pairs,reason",
    [
        ([("nope", "1")], "unknown_field"), ([("a.b", "1")], "unknown_field"),
        ([("price", "1")], "not_filterable"), ([("attributes", "1")], "not_filterable"),
        ([("stock", "many")], "wrong_type"), ([("stock", "1_0")], "wrong_type"),
        ([("stock", " 1")], "wrong_type"), ([("stock", "nan")], "wrong_type"),
        ([("stock", "inf")], "wrong_type"), ([("stock", "1e999")], "wrong_type"),
        ([("active", "yes")], "wrong_type"), ([("sku", "a"), ("sku", "a")], "duplicate"),
    ],
)
def test_filters_that_are_refused(pairs, reason):
    with pytest.raises(reads.FilterError) as error:
        reads.parse_filter(SPEC, pairs)
    assert error.value.reason == reason


def test_feed_keeps_tombstones_and_lookup_hides_them(spark, stock):
    assert ids(reads.changes(stock, SPEC, "erp")) == ["a", "b", "c", "e", "d"]
    assert ids(reads.changes(stock, SPEC, "erp", since=2, limit=2)) == ["c", "e"]
    assert reads.lookup(stock, "erp", "c.one", "c").isEmpty()
    assert reads.lookup(stock, "erp", "c.one", "c", served=False).count() == 1
    keys = spark.createDataFrame([("erp", "c.one", i) for i in "acz"], "source string, collection string, id string")
    assert ids(reads.lookup_many(stock, keys)) == ["a"]
    assert ids(reads.lookup_many(stock, keys, served=False)) == ["a", "c"]


def test_byte_budget(spark):
    rows = [record(i, n, doc(1000)) for n, i in enumerate("abc", 1)]
    records = table(spark, rows)
    seen, cursor = [], None
    for _ in range(3):
        page = reads.listing(records, SPEC, "erp", after=cursor, max_bytes=1500).collect()
        seen += [r.id for r in page]
        cursor = page[-1].next_cursor
    assert seen == ["a", "b", "c"] and cursor is None
    [only] = reads.listing(table(spark, [record("big", 1, doc(5000))]), SPEC, "erp", max_bytes=100).collect()
    assert only.id == "big" and only.next_cursor is None
    full = reads.changes(records, SPEC, "erp", limit=3).collect()
    assert {r.next_cursor for r in full} == {3}  # a full page offers a cursor even at the end
    assert (clamp_records(0), clamp_records(9999), clamp_bytes(None)) == (1, 1000, 1024 * 1024)


def walk_model(rows, limit, budget):
    pages, count, spent, page = {}, 0, 0, 1
    for seq, size in sorted(rows):
        if count and (count == limit or spent + size > budget):
            page, count, spent = page + 1, 0, 0
        pages[seq], count, spent = page, count + 1, spent + size
    return pages


@pytest.mark.parametrize("limit,budget,block", [(7, 900, 10), (3, 10**6, 4), (50, 400, 64), (1, 10, 5), (20, 1500, 10**6)])
def test_walk_matches_the_sequential_walk(spark, limit, budget, block):
    rng = random.Random(limit)
    rows = []
    for seq in range(1, 900):
        where = rng.choice(["c.one", "c.one", "c.one", "c.two"])
        rows.append(record(f"i{seq}", seq * 3, doc(rng.choice([12, 40, 200, 700])), collection=where))
    records = table(spark, rows)
    got = {}
    for r in walk.page_walk(records, limit, budget, block_rows=block).collect():
        got.setdefault(r.collection, {})[r.seq] = r.page
    for where in ("c.one", "c.two"):
        assert got[where] == walk_model([(r[3], r[6]) for r in rows if r[1] == where], limit, budget)


def test_page_summary_follows_the_listing(spark):
    rng = random.Random(4)
    records = table(spark, [record(f"i{n}", n, doc(rng.choice([20, 300]))) for n in range(1, 61)])
    expected, cursor = [], None
    while True:
        page = reads.listing(records, SPEC, "erp", after=cursor, limit=9, max_bytes=1000).orderBy("seq").collect()
        expected.append((len(page), page[0].seq, page[-1].seq, page[0].next_cursor))
        cursor = page[0].next_cursor
        if cursor is None:
            break
    got = walk.page_summary(records, 9, 1000, block_rows=11).orderBy("page").collect()
    assert [(r.records, r.first_seq, r.last_seq, r.next_cursor) for r in got] == expected


def test_first_pages(spark, stock):
    page = reads.first_pages(stock, limit=2)
    assert sorted((r.source, r.id, r.next_cursor) for r in page.collect()) == [
        ("erp", "a", 2), ("erp", "b", 2), ("shop", "a", None)
    ]
    cursors = spark.createDataFrame([("erp", "c.one", 3)], "source string, collection string, cursor long")
    assert ids(reads.first_pages(stock, cursors=cursors)) == ["e", "d", "a"]


def checksum_model(pairs):
    text = canonical([[i, h] for i, h in sorted(pairs, key=lambda p: p[0].encode())])
    return hashlib.sha256(text.encode()).hexdigest()


def test_checksums_and_buckets(spark):
    rng = random.Random(8)
    rows = []
    for n in range(400):
        ident = rng.choice(["é", "z", "a\\", 'q"', "😀", "דּ", "~"]) + str(n)
        rows.append(record(ident, n, doc(20 + n % 30), rng.random() < 0.2, collection=rng.choice(["c.one", "c.one", "c.two"])))
    rows.append(record("gone", 999, "{}", True, collection="c.dead"))
    records = table(spark, rows)
    want = {
        c: checksum_model([(r[2], r[5]) for r in rows if r[1] == c and r[8] is None])
        for c in ("c.one", "c.two", "c.dead")
    }
    got = {r.collection: r for r in summary.manifests(records).collect()}
    assert {c: got[c].checksum for c in got} == want
    buckets = {}
    for r in rows:
        if r[8] is None:
            number = int(hashlib.sha256(r[2].encode()).hexdigest()[:8], 16) % 8
            buckets.setdefault((r[1], number), []).append((r[2], r[5]))
    digests = summary.bucket_digests(records.repartition(5), buckets=8)
    assert {(r.collection, r.bucket): r.digest for r in digests.collect()} == {k: checksum_model(v) for k, v in buckets.items()}
    one = {r.collection: r.digest for r in summary.bucketed_checksums(digests).collect()}
    text = ",".join(f"{n}:{checksum_model(v)}" for (c, n), v in sorted(buckets.items()) if c == "c.one")
    assert one["c.one"] == hashlib.sha256(text.encode()).hexdigest()
    assert want["c.dead"] == summary.EMPTY_CHECKSUM == hashlib.sha256(b"[]").hexdigest()
    assert got["c.dead"]["count"] == 0 and got["c.dead"].max_seq == 999


def test_digests_and_drift(spark):
    records = table(spark, [record(i, n, doc(20 + n)) for n, i in enumerate(["a", "b", "c", "d"], 1)] + [record("t", 9, deleted=True)])
    page = reads.digest_page(records, "erp", "c.one", limit=2).orderBy("id").collect()
    assert [(r.id, r.next_cursor) for r in page] == [("a", "b"), ("b", "b")]
    rest = reads.digest_page(records, "erp", "c.one", "b").collect()
    assert sorted(r.id for r in rest) == ["c", "d"] and rest[0].next_cursor is None
    theirs = summary.live(records).filter("id <> 'b'").withColumn(
        "content_hash", F.when(F.col("id") == "c", "0" * 64).otherwise(F.col("content_hash"))
    ).unionByName(table(spark, [record("new", 1)]))
    assert {(r.id, r.drift) for r in summary.drift_report(records, theirs).collect()} == {
        ("b", "extra"), ("c", "changed"), ("new", "missing")
    }
    agreed = summary.collection_checksums(records)
    assert summary.drift_report(records, theirs, agreed).isEmpty()


def test_validators(spark):
    frame = spark.createDataFrame(
        [('"abc"', '"abc"'), ('"x", "abc" , "y"', '"abc"'), ("*", '"q"'), ('W/"abc"', '"abc"'),
         ('"abc"', 'W/"abc"'), ('"abc"', '"abd"'), (None, '"abc"')], "held string, now string")
    got = [r[0] for r in frame.select(freshness.is_fresh(F.col("held"), F.col("now"))).collect()]
    assert got == [True, True, True, True, True, False, False]
    chosen = reads.parse_filter(SPEC, [("sku", "s1")])
    one = spark.range(1).select(
        freshness.listing_validator(F.lit(7), F.lit(3), 5).alias("l"),
        freshness.listing_validator(F.lit(7), F.lit(3), 5, chosen).alias("f"),
        freshness.changes_validator(F.lit(None).cast("long"), F.lit(None).cast("long")).alias("c"),
        freshness.manifest_validator(F.lit(7)).alias("m"),
    ).first()
    fingerprint = hashlib.sha256(b'{"sku":"s1"}').hexdigest()[:16]
    assert tuple(one) == ('"l.7.3.5"', f'"l.7.3.5.{fingerprint}"', '"c.0.0.100"', '"m.7"')
    held = spark.createDataFrame([("a", '"1"'), ("b", '"2"'), ("c", "*")], "view string, held string")
    now = spark.createDataFrame([("a", '"1"'), ("b", '"9"')], "view string, validator string")
    assert {r.view for r in freshness.stale_views(held, now).collect()} == {"b", "c"}


def test_served_shapes(spark, stock):
    page = reads.listing(stock, SPEC, "erp", limit=2)
    body = json.loads(shapes.page_bodies(page, stock).first().body)
    assert [r["id"] for r in body["records"]] == ["a", "b"]
    assert body["next_cursor"] == 2 and body["max_seq"] == 5
    assert body["records"][0] == {
        "id": "a", "seq": 1, "ingested_at": "2024-05-01T12:30:01.250000Z",
        "content_hash": hashlib.sha256(b'{"active":true,"sku":"s1","stock":3}').hexdigest(),
        "payload": {"active": True, "sku": "s1", "stock": 3},
    }
    feed = json.loads(shapes.page_bodies(reads.changes(stock, SPEC, "erp"), stock, change=True).first().body)
    dead = feed["changes"][2]
    assert dead["deleted"] is True and dead["payload"] == {} and dead["content_hash"] == EMPTY_DOCUMENT_HASH
    manifest = json.loads(shapes.manifest_bodies(summary.manifests(stock)).filter("source='shop'").first().body)
    assert manifest["count"] == 1 and manifest["max_seq"] == 6


def test_integrity(spark, stock):
    clean = {r.rule: r.violations for r in integrity.integrity_report(stock).collect()}
    assert set(clean.values()) == {0} and len(clean) == 8
    bad = [("erp", "c.one", "a", -1, "{}", "xyz", 2, WHEN, None), ("erp", "c.one", "a/b", 2, '{"a":1}', "0" * 64, 2, WHEN, WHEN)]
    found = {r.rule: r.violations for r in integrity.integrity_report(stock.unionByName(table(spark, bad))).collect()}
    assert found["content_hash_format"] == 1 and found["tombstone_payload"] == 1 and found["id_grammar"] == 1
    assert found["seq_negative"] == 1 and found["key_unique"] == 1 and found["seq_unique"] == 1


def test_replica(spark, stock):
    feed = stock.unionByName(table(spark, [record("b", 8, doc(30)), record("a", 9, deleted=True), record("b", 1, doc(40))]))
    copy = replica.fold_feed(None, feed)
    assert {(r.source, r.id, r.seq) for r in copy.collect()} == {("erp", "b", 8), ("erp", "d", 5), ("erp", "e", 4), ("shop", "a", 6)}
    later = replica.fold_feed(copy, table(spark, [record("d", 10, deleted=True), record("b", 2, doc(50))]))
    assert {(r.source, r.id, r.seq) for r in later.collect()} == {("erp", "b", 8), ("erp", "e", 4), ("shop", "a", 6)}


def test_label_paths(spark):
    paths = ["images[3]", "a.b", "a[0].b[12]", "x[1][2]", "[", "a]b[7"]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in frame.select(label_path(F.col("p"))).collect()] == [
        "images[]", "a.b", "a[].b[]", "x[][]", "[", "a]b["
    ]
    outcomes = spark.createDataFrame([("c", "stored"), ("c", "stored"), ("c", "unchanged")], "collection string, outcome string")
    assert {(r.outcome, r.total) for r in counters.outcome_totals(outcomes).collect()} == {("stored", 2), ("unchanged", 1)}


def test_free_field_names_have_columns_of_their_own(spark):
    names = ["SKU", "sku", "a b", "q\"uote", "ap'os", "ba`ck", "both\"'", "_53", "br[0]", "back\\slash", "ü"]
    spec = CollectionSpec("c.one", ("id",), {n: FieldSpec.scalar("string", True) for n in names}, filters=tuple(names))
    rows = [record(f"r{i}", i + 1, json.dumps({n: f"v{i}-{k}" for k, n in enumerate(names)})) for i in range(3)]
    records = with_index_columns(table(spark, rows), spec)
    assert len({c.lower() for c in records.columns}) == len(records.columns) == 9 + len(names)
    for k, name in enumerate(names):
        chosen = reads.parse_filter(spec, [(name, f"v1-{k}")])
        for frame in (records, table(spark, rows)):
            assert [r.id for r in frame.filter(reads.filter_column(spec, chosen, frame.columns)).collect()] == ["r1"]


def test_sorted_listing_reaches_every_row_once(spark):
    spec = CollectionSpec("c.one", ("id",), {"sku": FieldSpec.scalar("string", True), "n": FieldSpec.scalar("number")}, sort=("seq", "sku"))
    rows = [record(f"r{i}", i + 1, json.dumps({"sku": "bca"[i % 3]} if i % 4 else {}), deleted=i == 5) for i in range(23)]
    plain = table(spark, rows)
    want = sorted((r for r in rows if r[8] is None), key=lambda r: (json.loads(r[4]).get("sku") is None, json.loads(r[4]).get("sku") or "", r[3]))
    for frame in (plain, with_index_columns(plain, spec)):
        got, after = [], None
        while True:
            page = reads.sorted_listing(frame, spec, "erp", "sku", after=after, limit=4).collect()
            got += [r.id for r in page]
            if not page or page[0].next_cursor is None:
                break
            after = (page[0].next_value, page[0].next_cursor)
        assert got == [r[2] for r in want]
    for field in ("n", "seq", "nope"):
        with pytest.raises(reads.FilterError):
            reads.sorted_listing(plain, spec, "erp", field)
