import random
import re

import numpy as np
import pytest
import xxhash

from feedgate.llm import simhash
from feedgate.llm.components import components


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """(id, fingerprint) pairs to component ids, by comparing all."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            least[find(i)] = min(least.get(find(i), name), name)
    return [least.get(find(i)) for i in range(len(rows))]


def test_fingerprint_equals_plain_form():
    draw = random.Random(1)
    texts = [None, "", " \n", "One", "one two three", "A b C d e", "ÄÖ ä\x0bx y z w v", "x " * 300]
    texts += [" ".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 700))) for _ in range(40)]
    for text in texts:
        assert simhash.simhash(text) == brute_fingerprint(text)


@pytest.mark.parametrize("largest", [3, 60, 400])
def test_forest_connects_what_all_pairs_connect(largest):
    draw = np.random.default_rng(largest)
    groups, values = [], []
    for number in range(30 if largest < 400 else 3):
        size = int(draw.integers(1, largest + 1))
        centre = draw.integers(0, 2**63, 6, dtype=np.uint64)
        for _ in range(size):
            value = centre[draw.integers(6)]
            for bit in draw.integers(0, 64, int(draw.integers(0, 5))):
                value ^= np.uint64(1) << np.uint64(bit)
            groups.append(number)
            values.append(value)
    groups, values = np.array(groups), np.array(values, np.uint64)
    got = simhash.forest(groups, values)
    for number in set(groups.tolist()):
        rows = np.flatnonzero(groups == number)
        want = brute_components([(int(i), int(values[i])) for i in rows])
        assert got[rows].tolist() == want


def test_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)
    draw = random.Random(2)
    centres = [draw.getrandbits(64) for _ in range(5)]
    values = {0}
    for _ in range(300):
        value = draw.choice(centres)
        for _ in range(draw.randint(0, 5)):
            value ^= 1 << draw.randrange(64)
        values.add(value)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    roots = {r.node: r.root for r in components(edges).collect()}
    got = [roots.get(v, v) for (v,) in signed]
    want = brute_components([(i, v) for i, v in enumerate(values)])
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_rows_of_every_kind(spark):
    near = "the quick brown fox jumps over the lazy dog and runs away from here again " * 8
    rows = [(5, near), (3, near.upper()), (3, near), (9, None), (8, ""), (None, near), (7, near + "now"), (1, "other words")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = simhash.near_duplicates(frame).collect()
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows])
    key = lambda row: (row[0] is None, str(row))
    assert sorted((tuple(r) for r in got), key=key) == sorted(
        ((i, f"{brute_fingerprint(t):016x}", c) for (i, t), c in zip(rows, want)), key=key
    )
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = brute_components(rows)
    assert got == {i: (f, c) for (i, f), c in zip(rows, want)}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 4)], "a long, b long")
    got = {(r.node, r.root) for r in components(edges).collect()}
    assert got == {(i, 0) for i in range(61)}
