import hashlib
import math
import random

import numpy as np
import pytest

from feedgate.llm import vector_codes as V

NAN, INF = float("nan"), float("inf")


def test_sequency_order_counts_sign_changes():
    for size in (1, 2, 4, 8, 32):
        basis = V.hadamard(np.eye(size, dtype=np.int64))  # row i: coefficients of the i-th unit vector
        rows = basis.T  # row s: the s-th Walsh function
        assert [int((np.diff(row) != 0).sum()) for row in rows] == list(range(size))
        assert (rows @ rows.T == size * np.eye(size)).all()


@pytest.mark.parametrize("length", [0, 1, 3, 7, 8, 13])
@pytest.mark.parametrize("largest", [2, 5000, 10**30])
def test_nearest_equals_brute_force(length, largest):
    rng = random.Random(length)
    number = lambda: rng.randint(-largest, largest)
    entries = [[[number() for _ in range(length)] for _ in range(16)] for _ in range(V.PARTS)]
    vectors = [[[number() for _ in range(length)] for _ in range(V.PARTS)] for _ in range(200)]
    books = V.Codebooks(V._narrow(np.array(entries, dtype=object).reshape(V.PARTS, 16, length)))
    codes, distances = books.encode(V._narrow(np.array(vectors, dtype=object).reshape(200, V.PARTS, length)))
    for i, vector in enumerate(vectors):
        for p, part in enumerate(vector):
            sums = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in entries[p]]
            assert int(distances[i, p]) == min(sums) and codes[i, p] == sums.index(min(sums))


def test_entries_are_eliminated_early():
    rng = np.random.default_rng(1)
    entries = V.hadamard(rng.integers(-4000, 4000, (16, 32)))
    vectors = entries[rng.integers(0, 16, 500)] + rng.integers(-50, 50, (500, 32))
    _, _, terms = V.nearest(vectors, entries)
    assert terms < 500 * 16 * 32 / 4


def brute(rows):
    """The contract on (vec_id, vector, label) rows, with plain numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    longest = max(len(r[1]) for r in kept)
    length = -(-longest // 8)

    def parts(vector):
        numbers = [math.floor(4096 * x) if abs(x) < 2.0**52 else 4096 * int(x) for x in vector]
        numbers += [0] * (8 * length - len(numbers))
        return [tuple(numbers[p * length : (p + 1) * length]) for p in range(8)]

    vectors = [parts(r[1]) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0))
    books = [[vectors[i][p] for i in order[:16]] for p in range(8)]

    def assign(part, p):
        sums = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in books[p]]
        return sums.index(min(sums)), min(sums)

    for _ in range(6):
        moved = []
        for p in range(8):
            members = {}
            for vector in vectors:
                members.setdefault(assign(vector[p], p)[0], []).append(vector[p])
            moved.append(
                [tuple(sum(c) // len(members[e]) for c in zip(*members[e])) if e in members else entry for e, entry in enumerate(books[p])]
            )
        books = moved
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out, by_label = [], {}
    for row, vector in zip(kept, vectors):
        found = [assign(vector[p], p) for p in range(8)]
        error = sum(d for _, d in found)
        out.append((row[0], "".join(f"{e:02x}" for e, _ in found), error, row[2]))
        by_label[row[2]] = by_label.get(row[2], 0) + error
    big = {label for label in by_label if any(e >= 2**63 for _, _, e, at in out if at == label) or by_label[label] >= 2**63}
    return [(i, c, e if e < 2**63 else None, None if at in big else by_label[at], digest) for i, c, e, at in out]


def compared(spark, rows, kind="double"):
    frame = spark.createDataFrame([(*r, "clash") for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string")
    got = V.compress(frame.repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:4] if None not in r else str(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def sample(n, size, seed=3, spread=0.3):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(size)], rng.choice([0, 1, None])) for i in range(n)]


def test_floats_equal_brute_force(spark):
    compared(spark, sample(120, 24), "float")


def test_unusable_vectors_nulls_repeats_and_ties(spark):
    rows = sample(40, 16)
    rows += [(100, None, 1), (101, [None] + [0.0] * 15, 1), (102, [NAN] * 16, 1), (103, [INF] * 16, 0), (0, None, 0), (1, [-INF] * 16, 0)]
    rows += [(2, [0.25] * 16, 7), (2, [0.25] * 16, 7), (50, [0.0] * 16, None), (51, [-0.0] * 16, None), (None, [0.5] * 16, 7)]
    rows = [r for r in rows if r[0] != 2 or r[1] == [0.25] * 16]
    compared(spark, rows)


def test_shorter_vectors_odd_lengths_and_empty_ones(spark):
    compared(spark, [(i, v[: 3 + i % 9], at) for i, v, at in sample(30, 11)] + [(99, [], 1)])
    compared(spark, [(1, [], 0), (2, [], 0)])


def test_fewer_vectors_than_entries(spark):
    compared(spark, sample(5, 16))


def test_components_beyond_64_bits(spark):
    rows = sample(30, 8, spread=1e6) + [(200, [1e300] * 8, 5), (201, [-1e300] + [1.0] * 7, 5), (202, [3e9] * 8, 6), (-1, [2e17] * 8, 9)]
    compared(spark, rows)


def test_empty_tables(spark):
    assert V.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    none = spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")
    out = V.compress(none)
    assert out.collect() == [] and out.columns[0] == "vec_id"
