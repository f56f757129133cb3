import random
import re

import pytest

from feedgate.llm import mixing
from feedgate.llm.catalog import QUERIES


def brute_targets(sizes, passes=3):
    """sizes: {source: words}, water-filled one pass after the other."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(passes * sizes[n] for n in full)
        free = [n for n in names if n not in full]
        share = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = {n for n in free if share[n] > passes * sizes[n]}
        if not over:
            return {**{n: float(passes * sizes[n]) for n in full}, **share}
        full |= over


def brute_seats(weights, seats, most):
    given = [0] * len(weights)
    for _ in range(min(seats, sum(most))):
        best = max((i for i in range(len(weights)) if given[i] < most[i]), key=lambda i: (weights[i] / (2 * given[i] + 1), -i))
        given[best] += 1
    return given


def mask(value):
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def spark_hash(*values):
    """Spark's xxhash64 over longs, ints and strings, each seeded by the one before."""
    import xxhash

    h = 42
    for kind, value in values:
        if value is None:
            continue
        data = value.encode() if kind == "s" else int(value).to_bytes(8 if kind == "l" else 4, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h & ((1 << 64) - 1))
    return mask(h)


def brute_mix(rows, block=mixing.BLOCK_WORDS, seed=mixing.SEED):
    """(id, source, size) rows to {id: (size, source_size, target, taken)}, word stream by word stream."""
    sizes = {}
    for _, source, size in rows:
        sizes[source] = sizes.get(source, 0) + size
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    targets = brute_targets(sizes)
    blocks = {n: -(-sizes[n] // block) for n in names}
    quotas = dict(zip(names, brute_seats([targets[n] for n in names], round(sum(targets.values()) / block), [3 * blocks[n] for n in names])))
    out = {}
    for source in names:
        n, total = blocks[source], min(quotas[source] * block, 3 * sizes[source])
        full = total // sizes[source] if total else 0
        rest = int((total - full * sizes[source]) / block + 0.5)
        if n and rest >= n:
            full, rest = full + 1, 0
        picked = set()
        lengths = [min(mixing.SHARD_BLOCKS, n - first) for first in range(0, n, mixing.SHARD_BLOCKS)]
        for shard, take in enumerate(brute_seats(lengths, rest, lengths)):
            first, after = shard * mixing.SHARD_BLOCKS, min((shard + 1) * mixing.SHARD_BLOCKS, n)
            h = spark_hash(("i", seed), ("s", source), ("l", shard))
            step, turn = mixing._STEPS[h % len(mixing._STEPS)], (h >> 8) % mixing.SHARD_BLOCKS
            picked |= {k for k in range(first, after) if ((k - first) * step + turn) % (after - first) < take}
            assert len([k for k in picked if first <= k < after]) == take
        keyed = [(spark_hash(("i", seed), ("l", i), ("l", size)), i, size) for i, s, size in rows if s == source]
        at = 0
        for h, i, size in sorted(keyed, key=lambda r: ((r[0] & ((1 << 64) - 1)) >> 33, r[0], r[1], r[2])):
            taken = full * size + sum(1 for w in range(at, at + size) if w // block in picked)
            out[i] = (size, sizes[source], pytest.approx(targets[source], rel=1e-12), taken)
            at += size
    return out


def test_seats_equal_the_greedy_sequence():
    draw = random.Random(4)
    for _ in range(200):
        n = draw.randint(1, 9)
        weights = [draw.choice([0.0, draw.random() * 50, 5.0]) for _ in range(n)]
        most = [draw.randint(0, 30) for _ in range(n)]
        seats = draw.randint(0, 60)
        want = brute_seats(weights, seats, [m if w else 0 for m, w in zip(most, weights)])
        assert mixing.sainte_lague(weights, seats, [m if w else 0 for m, w in zip(most, weights)]) == want


def test_shard_quotas_equal_the_greedy_sequence():
    draw = random.Random(7)
    for _ in range(400):
        shard = draw.choice([1, 2, 7, 16])
        blocks = draw.randint(0, 60)
        seats = draw.randint(0, blocks)
        lengths = [min(shard, blocks - first) for first in range(0, blocks, shard)]
        whole, each, more, last = mixing.shard_quotas(blocks, seats, shard)
        got = [each + (i < more) for i in range(whole)] + ([last] if blocks % shard else [])
        assert got == brute_seats(lengths, seats, lengths), (blocks, seats, shard)
        assert sum(got) == seats and last * (blocks % shard == 0) == 0


def test_a_source_of_empty_texts_is_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 100)
    rows = mixing.plan_sources({"empty": 0, "a": 50}, counts={"empty": 1001, "a": 1})
    assert {r[0]: r[6] for r in rows} == {"empty": 11, "a": 1}
    seen = []
    real = mixing.save
    monkeypatch.setattr(mixing, "save", lambda frame, label, *p: seen.append(label) or real(frame, label, *p))
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a b c', '') AS text", "IF(id % 3 = 0, 'w', 'empty') AS source")
    out = mixing.mix(docs)
    assert out.count() == 3000 and out.where("source_size = 0 AND taken <> 0").isEmpty() and "mix-plan" in seen
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


def test_targets_share_everything():
    draw = random.Random(5)
    for _ in range(100):
        sizes = {draw.choice([None, *"abcdefgh"]) or None: draw.randint(0, 10 ** draw.randint(0, 6)) for _ in range(draw.randint(1, 8))}
        names = sorted(sizes, key=lambda n: (n is None, n or ""))
        got = mixing.targets([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
        assert got == pytest.approx([brute_targets(sizes)[n] for n in names])
        assert sum(got) == pytest.approx(sum(sizes.values()))
        assert all(t <= 3 * sizes[n] + 1e-6 for t, n in zip(got, names))


def test_whole_table_against_plain_version(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = brute_mix([(d.doc_id, d.source, len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))) for d in docs])
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in QUERIES["op10_source_mixing"](spark, folder).collect()}
    assert got == want


@pytest.mark.parametrize("bucket", [65_536, 300])
def test_large_sources_shards_and_odd_rows(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_WORDS", bucket)
    monkeypatch.setattr(mixing, "GROUP_BUCKETS", 4)
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 16)
    draw = random.Random(6)
    rows = [(i, draw.choice(["b", "b", "a", None, "é"]), draw.choice([0, 1, 40, 300])) for i in range(300)] + [(900, "z", 0), (901, "b", 20_000)]
    frame = spark.createDataFrame([(i, "w " * n if n else draw.choice([None, ""]), s, "k") for i, s, n in rows], "doc_id long, text string, source string, size string")
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.mix(frame).collect()}
    assert got == brute_mix(rows)
    by_source = {}
    for i, source, size in rows:
        by_source.setdefault(source, [0, 0])
        by_source[source][0] += got[i][3]
        by_source[source][1] = got[i][2]
        assert got[i][3] <= 3 * size
    assert all(abs(taken - target) <= 2 * mixing.BLOCK_WORDS for taken, target in by_source.values())
    kept = mixing.mix(frame, keep=frame.columns)
    assert kept.columns == ["text", "source", "doc_id", "size", "source_size", "target", "taken"]
    assert {r.doc_id: r.taken for r in kept.collect()} == {i: v[3] for i, v in got.items()}
    assert mixing.mix(frame.limit(0)).count() == 0
    twice = frame.where("doc_id < 5")
    assert mixing.mix(twice.unionByName(twice)).count() == 10
