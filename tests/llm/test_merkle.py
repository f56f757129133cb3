import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from feedgate.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text=None):
    values = (row[0], row[3], row[2], row[4], row[1] if text is None else text)
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def above(digests, paths):
    """Hashes runs of sixteen until one node remains; paths: per node the positions whose proofs go through it."""
    proofs = {}
    while len(digests) > 1:
        upper, reached = [], []
        for start in range(0, len(digests), 16):
            run = digests[start : start + 16]
            merged = []
            for place in range(len(run)):
                for leaf in paths[start + place]:
                    proofs.setdefault(leaf, []).append((run[:place], run[place + 1 :]))
                merged += paths[start + place]
            upper.append(H(*run))
            reached.append(merged)
        digests, paths = upper, reached
    return digests[0], proofs


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    subroots, out, owners = [], [], []
    for source in sources:
        mine = sorted((r for r in rows if r[3] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        leaves = [leaf_of(r) for r in mine]
        subroot, proofs = above(leaves, [[i] for i in range(len(leaves))])
        subroots.append(subroot)
        owners.append([(r, leaf, subroot, proofs.get(i, [])) for i, (r, leaf) in enumerate(zip(mine, leaves))])
    root, upper = above(subroots, [[i] for i in range(len(subroots))])
    for number, group in enumerate(owners):
        for row, leaf, subroot, proof in group:
            proof = proof + upper.get(number, [])
            changed = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None:
                lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1])
                changed = leaf_of(row, lowered)
            folded = changed
            for before, after in proof:
                folded = H(*before, folded, *after)
            flat = H(*(d for before, after in proof for d in (*before, *after)))
            out.append((row[0], leaf, subroot, root, flat, folded, folded == root))
    return out


def compared(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    got = merkle.verified(merkle.manifest(frame))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def row(n, source, text="Some Text"):
    return (n, text, "en", source, n, "clash")


def test_heights_up_to_three_levels_and_odd_runs(spark):
    sizes = {"one": 1, "two": 2, "run": 16, "odd": 17, "square": 256, "more": 257, "large": 1100}
    compared(spark, [row(n * 7 % 5000 + k * 5000, s) for k, (s, size) in enumerate(sizes.items()) for n in range(size)])


def test_more_sources_than_a_run_and_a_square(spark):
    compared(spark, [row(n, f"s{n % 300}", "Ä b") for n in range(700)])


@pytest.mark.parametrize("n", [1, 2, 16, 17])
def test_one_source(spark, n):
    compared(spark, [row(k, "only") for k in range(n)])


def test_nulls_repeats_ties_long_texts_and_sources_by_bytes(spark):
    rows = [
        (None, None, None, None, None, None), (None, "A", None, None, 1, ""), (5, "", "en", None, 0, "x"),
        (5, "X", "en", "", 1, "x"), (5, "X", "en", "", 1, "y"), (5, "Y", "de", "", 1, "x"), (-3, "Q", "de", "", 1, "x"),
        (7, "Long Text " * 100_000, "en", "é", 9, "x"), (8, "z", "en", "z", 9, "x"), (9, "z", "en", "\U0001f600", 9, "x"),
        (10, "z", "en", "￿", 9, "x"), (11, "-", "en", "-", 9, "x"), (12, "1:a", "en", "1:a", None, "x"),
    ]
    compared(spark, rows + [row(n, "null") for n in range(40)])


def test_empty_table(spark):
    assert merkle.verified(merkle.manifest(spark.createDataFrame([], SCHEMA))).collect() == []


def test_any_change_is_found_and_segments_prove_a_leaf_alone(spark):
    docs = spark.createDataFrame([row(n, f"s{n % 3}") for n in range(100)], SCHEMA)
    changed = lambda: F.when(F.col("doc_id") % 2 == 0, merkle.leaf_digest(n_chars=F.col("n_chars") + 1))
    rows = merkle.manifest(docs, tampered=changed)
    assert {(r.doc_id % 2 == 1, r.verified) for r in merkle.verified(rows).collect()} == {(True, True), (False, False)}
    for r in rows.collect():
        digest = r.leaf
        for segment in r.segments:
            digest = H(segment.before, digest, segment.after)
        assert digest == r.root


def test_rounds_double_the_distance(spark, monkeypatch):
    """Seven levels of pairs take three joins."""
    monkeypatch.setattr(merkle, "FAN_OUT", 2)
    seen = []
    real = merkle.save
    monkeypatch.setattr(merkle, "save", lambda frame, label, *p: seen.append(label) or real(frame, label, *p))
    docs = spark.createDataFrame([row(n, "s") for n in range(200)], SCHEMA)
    rows = merkle.manifest(docs).collect()
    assert seen.count("pointers") == 1 + 3 and all(len(r.segments) == 8 for r in rows)
    for r in rows:
        digest = r.leaf
        for segment in r.segments:
            digest = H(segment.before, digest, segment.after)
        assert digest == r.root
