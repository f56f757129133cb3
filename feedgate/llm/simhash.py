"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit where over half of a text's shingle hashes have it. Equal fingerprints are
one candidate. Two fingerprints that differ in at most RADIUS = 4 bits agree in at least two of six
blocks of bits, so each goes to the fifteen buckets of its pairs of blocks and no link is missed.
In a bucket the fingerprints are stored as vertical bit planes: one machine word holds the same bit
of 64 of them. Distances of 64 pairs at once are counted by carry-save adders over the planes, and
words in which every pair has exceeded the radius are abandoned.

A bucket with more than BLOCK fingerprints is cut into blocks, and every pair of blocks is a group
of its own. A bucket emits a spanning forest of its links, never all pairs; components() joins them.

Defined results: null texts and texts without words have fingerprint zero, linked like any other.
A document without id gets the component of its fingerprint, and is never its smallest id.
Repeated rows stay repeated; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedgate.llm.common import lower_bytes, small_batches
from feedgate.llm.components import components
from feedgate.sources.scratch import save

SHINGLE = 4
HASH_SEED = 42
RADIUS = 4
#: Bits of the six blocks; a link agrees in at least two of them.
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of a bucket that are compared in one group; rows gathered before comparing.
BLOCK = 2048
CHUNK = 131_072
#: Groups up to this size are compared by shifting planes, larger ones row by plane.
SHIFTED = 96

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text's word shingles."""
    words = lower_bytes(text or "").split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, HASH_SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    counts, total = np.zeros(64, np.int64), len(starts)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, 65_280):
        spans = zip(starts[at : at + 65_280].tolist(), ends[at : at + 65_280].tolist())
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in spans], np.uint64)
        counts += _bit_counts(hashes)
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # 255 ones still fit a byte
    counts = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        counts += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return counts


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    values = np.fromiter((simhash(text) for text in texts), np.uint64, len(texts))
    return pd.Series(values.view(np.int64))


# ---------------------------------------------------------------- bit-sliced comparison


def planes(values: np.ndarray, spare: int = 0) -> np.ndarray:
    """64 rows of words: bit i of row p is bit p of value i. `spare` words of zeros follow."""
    words = -(-len(values) // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(values)] = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)
    return np.concatenate([packed, np.zeros((64, spare), np.uint64)], axis=1) if spare else packed


def close_lanes(valid: np.ndarray, diff: Callable[[int, np.ndarray], np.ndarray], radius: int) -> np.ndarray:
    """The lanes of `valid` whose pair differs in at most `radius` (under 8) bits.

    diff(p, at): for the words numbered `at`, the lanes that differ in bit p.
    """
    at = np.flatnonzero(valid)
    state = np.zeros((4, len(at)), np.uint64)  # three counter bits and overflow
    alive = valid[at]
    for plane in range(64):
        one, two, four, over = state
        carry = diff(plane, at)
        one_carry = one & carry
        one ^= carry
        two_carry = two & one_carry
        two ^= one_carry
        over |= four & two_carry
        four ^= two_carry
        if plane % 8 == 7:
            more, equal = over.copy(), ~over
            for bit, counter in ((4, four), (2, two), (1, one)):
                if radius & bit:
                    equal &= counter
                else:
                    more |= equal & counter
                    equal &= ~counter
            alive &= ~more
            keep = alive != 0
            if not keep.all():
                at, alive, state = at[keep], alive[keep], np.ascontiguousarray(state[:, keep])
                if not len(at):
                    break
    result = np.zeros_like(valid)
    result[at] = alive
    return result


def _lanes(words: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(words)
    if not len(at):
        return at
    bits = np.unpackbits(words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return at[row] * 64 + bit


def _union(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Merges the trees of the pairs; every node ends directly under its root, the smallest."""
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent[:] = above


def forest(group: np.ndarray, values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the first row of its component within its group; rows come ordered by group."""
    parent = np.arange(len(values))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, len(group)])
    number = np.repeat(np.arange(len(starts)), sizes)
    small = np.flatnonzero(((sizes > 1) & (sizes <= SHIFTED))[number]) if len(group) else starts
    if len(small):
        _shifted(parent, small, number[small], values[small], int(sizes[sizes <= SHIFTED].max()), radius)
    for start, size in zip(starts[sizes > SHIFTED], sizes[sizes > SHIFTED]):
        _by_row(parent, int(start), values[start : start + size], radius)
    return parent


def _shifted(parent, rows, number, values, largest, radius) -> None:
    """Compares each row with the row `shift` places on, all rows at once, for every shift."""
    for shift in range(1, largest):
        same = number[shift:] == number[:-shift]
        if not same.any():
            return
        if shift & (shift - 1) == 0 and shift > 1:  # leave out groups that are done
            size = np.bincount(number)[number]
            keep = size > shift
            rows, number, values = rows[keep], number[keep], values[keep]
            same = number[shift:] == number[:-shift]
        if shift & (shift - 1) == 0:
            table = planes(values, spare=2 + SHIFTED // 64)
        words = -(-len(values) // 64)
        lanes = np.zeros(words * 64, np.uint8)
        lanes[: len(same)] = same
        valid = np.packbits(lanes, bitorder="little").view(np.uint64)
        skip, turn = divmod(shift, 64)

        def diff(p, at, table=table, skip=skip, turn=turn):
            moved = table[p, at + skip]
            if turn:
                moved = (moved >> np.uint64(turn)) | (table[p, at + skip + 1] << np.uint64(64 - turn))
            return table[p, at] ^ moved

        left = _lanes(close_lanes(valid, diff, radius))
        if len(left):
            _union(parent, rows[left], rows[left + shift])


def _by_row(parent, start, values, radius) -> None:
    """Compares 256 rows at a time with all rows behind them, 64 to a word."""
    table = planes(values)
    words = table.shape[1]
    position = np.arange(words * 64)
    for first in range(0, len(values), 256):
        some = values[first : first + 256]
        signs = np.where((some[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), _ONES, np.uint64(0))
        later = (position[None, :] > np.arange(first, first + len(some))[:, None]) & (position < len(values))
        valid = np.packbits(later, axis=1, bitorder="little").view(np.uint64).ravel()

        def diff(p, at, signs=signs):
            row, word = np.divmod(at, words)
            return table[p, word] ^ signs[p, row]

        lanes = _lanes(close_lanes(valid, diff, radius))
        row, other = np.divmod(lanes, words * 64)
        if len(lanes):
            _union(parent, row + first + start, other + start)


# ---------------------------------------------------------------- the distributed join


def _bucket_keys(value: str) -> list:
    """The keys of the buckets of a fingerprint: number of the pair of blocks, and their bits."""
    at, blocks = 0, []
    for bits in BLOCK_BITS:
        blocks.append(f"(shiftrightunsigned({value}, {at}) & {(1 << bits) - 1}L)")
        at += bits
    pairs = list(combinations(range(len(blocks)), len(blocks) - RADIUS))
    return [F.expr(f"({n}L << 22) | ({blocks[i]} << 11) | {blocks[j]}") for n, (i, j) in enumerate(pairs)]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the groups of a partition that is sorted by group."""
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def linked(part: list[np.ndarray]) -> pa.RecordBatch:
        key, pair, values = part
        parent = forest(_numbered(key, pair), values.view(np.uint64))
        child = np.flatnonzero(parent != np.arange(len(parent)))
        ends = np.unique(np.stack([values[parent[child]], values[child]], 1), axis=0) if len(child) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    for batch in batches:
        held.append(tuple(batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "pair", "fp")))
        rows += batch.num_rows
        if rows >= CHUNK:
            whole = [np.concatenate(column) for column in zip(*held)]
            number = _numbered(whole[0], whole[1])
            cut = int(np.searchsorted(number, number[-1]))
            if cut:
                yield linked([column[:cut] for column in whole])
            held, rows = [tuple(column[cut:] for column in whole)], len(number) - cut
    if rows:
        yield linked([np.concatenate(column) for column in zip(*held)])


def _numbered(key: np.ndarray, pair: np.ndarray) -> np.ndarray:
    change = (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
    return np.r_[0, np.cumsum(change)]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) edges that connect exactly the fingerprints that links within RADIUS connect.

    `distinct` has one column fp of different fingerprints.
    """
    buckets = distinct.select(F.explode(F.array(*_bucket_keys("fp"))).alias("key"), "fp")
    large = buckets.groupBy("key").count().where(F.col("count") > BLOCK)
    large = save(large.select(F.col("key").alias("large"), F.expr(f"CAST(ceil(count / {BLOCK}) AS INT)").alias("parts")), "large-buckets")
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    pairs = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(
            F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1),
            lambda other: F.least(other, own) * F.col("parts") + F.greatest(other, own),
        )
    )
    grouped = buckets.join(large, F.col("key") == F.col("large"), "left").select("key", F.explode(pairs).alias("pair"), "fp")
    dealt = grouped.repartition("key", "pair").sortWithinPartitions("key", "pair")
    return dealt.mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (smallest id reachable by links) of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp"))
    docs = save(docs, "fingerprints")
    first = save(docs.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    nodes = components(save(links(first.select("fp")), "links"))
    rooted = first.join(nodes, F.col("fp") == F.col("node"), "left")
    rooted = save(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    least = save(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    labels = save(rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias("label"), "component_id"), "labels")
    joined = docs.join(labels, F.col("fp") == F.col("label"))
    return joined.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
