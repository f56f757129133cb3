"""Vector codes by product quantisation in whole numbers, searched in the Walsh-Hadamard domain.

Each component x becomes floor(SCALE * x). Vectors are cut into PARTS parts of equal length; each part
position has a codebook of at most ENTRIES entries, which starts as that part of the vectors of smallest
ids and is moved to the floor of its parts' means ROUNDS times. A code names the nearest entry per part.

Nearest entries are found in the Walsh-Hadamard domain: parts and entries are padded with zeros to a
power of two, D, and transformed with additions only. Squared differences of coefficients then sum up
to D times the squared distance. They are added in order of sequency, slow changes first; once an
entry's sum so far exceeds the whole distance of another one, it is dropped. All sums are whole numbers,
so the result is exact; components too large for 64 bits are handled as Python's.

Spark deals out the vectors: they are written once as short byte strings, each round reads them in
tasks that keep one sum per entry, and Spark adds the tasks' sums. Only codebooks, whose size depends on
the length of a vector alone, come to the driver.

Defined results: a vector that is null or holds a null, NaN or infinite component is dropped. Rows of
equal id are all kept; the codebooks order them by their components, null ids last. Fewer vectors than
ENTRIES make smaller codebooks. Vectors shorter than the longest are taken to end in zeros, and a length
that PARTS does not divide is filled up likewise; empty vectors have distance zero to everything. An error
beyond 64 bits is null, as is the sum of a label that has one. An empty table gives no rows. Other
columns are not returned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedgate.llm.common import quoted
from feedgate.sources.scratch import save

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Numbers of a step in memory at once.
CHUNK = 1 << 18
#: Coefficients added between two looks at what can be dropped.
STRIDE = 2

_LIMB = 32
_LONG = 1 << 63


# -- numbers


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite numbers, as 64-bit integers or, where they do not fit, Python's."""
    wide = values.astype(np.float64)
    if not wide.size or np.abs(wide).max() < 2.0**48:
        return np.floor(wide * SCALE).astype(np.int64)
    # From 2 ** 52 on, floats are whole numbers.
    exact = [int(x) * SCALE if abs(x) >= 2.0**52 else math.floor(x * SCALE) for x in wide.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(wide.shape)


def sequency_order(size: int) -> list[int]:
    """Rows of the Hadamard matrix by their number of sign changes."""
    bits = size.bit_length() - 1
    gray = (s ^ (s >> 1) for s in range(size))
    return [int(f"{g:0{bits}b}"[::-1], 2) if bits else 0 for g in gray]


def hadamard(parts: np.ndarray) -> np.ndarray:
    """The transform of the last axis, padded with zeros to a power of two, in order of sequency."""
    length = parts.shape[-1]
    size = 1 << max(length - 1, 0).bit_length()
    out = np.zeros((*parts.shape[:-1], size), dtype=parts.dtype)
    out[..., :length] = parts
    half = 1
    while half < size:
        pairs = out.reshape(*parts.shape[:-1], size // (2 * half), 2, half)
        sums, differences = pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]
        out = np.stack([sums, differences], axis=-2).reshape(*parts.shape[:-1], size)
        half *= 2
    return out[..., sequency_order(size)]


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each transformed part, the lowest of equals, its scaled squared distance, and terms added."""
    rows, size = vectors.shape
    first = min(STRIDE, size)
    sums = ((vectors[:, None, :first] - entries[None, :, :first]) ** 2).sum(axis=2)
    # The whole distance to the entry that looks best so far bounds the least distance.
    guess = sums.argmin(axis=1)
    bound = sums[np.arange(rows), guess] + ((vectors[:, first:] - entries[guess, first:]) ** 2).sum(axis=1)
    terms = rows * len(entries) * first + rows * (size - first)
    row, entry = np.nonzero(sums <= bound[:, None])
    left = sums[row, entry]
    for start in range(first, size, STRIDE):
        part = slice(start, start + STRIDE)
        left = left + ((vectors[row, part] - entries[entry, part]) ** 2).sum(axis=1)
        terms += len(row) * min(STRIDE, size - start)
        stays = left <= bound[row]
        row, entry, left = row[stays], entry[stays], left[stays]
    # What is left is whole distances; the guess is always among them.
    whole_sums = np.repeat(bound[:, None] + 1, len(entries), axis=1)
    whole_sums[row, entry] = left
    codes = whole_sums.argmin(axis=1)
    return codes, whole_sums[np.arange(rows), codes], terms


class Codebooks:
    """PARTS codebooks of whole numbers, with their transforms."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries  # PARTS x ENTRIES x length
        self.transformed = hadamard(entries)
        length, size = entries.shape[2], self.transformed.shape[2]
        # No sum of squares passes 63 bits while all components stay within this.
        self.safe = math.isqrt((1 << 60) // (max(length, 1) * size))
        self.largest = max((abs(x) for x in entries.ravel().tolist()), default=0)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and squared distances, rows x PARTS, of vectors as rows x PARTS x length."""
        entries, largest = self.transformed, max(self.largest, abs(vectors).max() if vectors.size else 0)
        exact = largest > self.safe
        coefficients = hadamard(vectors.astype(object) if exact else vectors.astype(np.int64))
        entries = entries.astype(object if exact else np.int64)
        found = [nearest(coefficients[:, part], entries[part])[:2] for part in range(entries.shape[0])]
        codes, sums = (np.stack(column, axis=1) for column in zip(*found))
        return codes, sums // entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


# -- jobs


def packed(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, str]:
    """Usable vectors as (vec_id, label, vector), a vector being its components' bytes; and their type."""
    names = [F.col(quoted(name)).alias(to) for name, to in ((id_col, "vec_id"), (label_col, "label"), (vector_col, "vector"))]
    rows = vectors.select(*names)
    kind = rows.schema["vector"].dataType
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{vector_col} is no array")
    type_name = "float32" if isinstance(kind.elementType, T.FloatType) else "float64"
    rows = rows.withColumn("vector", F.col("vector").cast("array<float>" if type_name == "float32" else "array<double>"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("vector", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            flat = column.flatten()
            numbers = flat.to_numpy(zero_copy_only=False).astype(type_name)
            usable = np.isfinite(numbers)  # nulls have become NaN
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            bad = np.concatenate([[0], np.cumsum(~usable)])
            keep = (bad[ends] == bad[ends - lengths]) & column.is_valid().to_numpy(zero_copy_only=False)
            picked = np.flatnonzero(keep)
            bytes_of = [numbers[ends[i] - lengths[i] : ends[i]].tobytes() for i in picked.tolist()]
            kept = batch.select(["vec_id", "label"]).take(pa.array(picked))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(bytes_of, pa.binary())], names=["vec_id", "label", "vector"])

    return save(rows.mapInArrow(pack, schema), "vectors"), type_name


def _cut(strings: list[bytes], type_name: str, length: int) -> np.ndarray:
    """Byte strings as whole numbers, rows x PARTS x length, filled up with zeros."""
    out = np.zeros((len(strings), PARTS * length), dtype=type_name)
    for row, string in enumerate(strings):
        numbers = np.frombuffer(string, type_name)
        out[row, : len(numbers)] = numbers
    return whole(out).reshape(len(strings), PARTS, length)


def _chunks(batch: pa.RecordBatch, type_name: str, length: int) -> Iterator[tuple[int, np.ndarray]]:
    rows = max(1, CHUNK // max(1, PARTS * length))
    strings = batch.column("vector")
    for start in range(0, len(strings), rows):
        yield start, _cut(strings.slice(start, rows).to_pylist(), type_name, length)


def _moved(vectors: DataFrame, books: Codebooks, type_name: str) -> Codebooks:
    """Codebooks after one round. Tasks send one sum per entry and component, in limbs that Spark can add."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    n_entries, length = books.entries.shape[1:]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((PARTS, n_entries, length), dtype=object)
        counts = np.zeros((PARTS, n_entries), dtype=np.int64)
        for batch in batches:
            for _, chunk in _chunks(batch, type_name, length):
                codes, _ = shared.value.encode(chunk)
                for part in range(PARTS):
                    counts[part] += np.bincount(codes[:, part], minlength=n_entries)
                    for entry in np.unique(codes[:, part]).tolist():
                        totals[part, entry] += chunk[codes[:, part] == entry, part].sum(axis=0).astype(object)
        rows = [(part, entry, -1, 0, int(n)) for (part, entry), n in np.ndenumerate(counts) if n]
        for (part, entry, at), total in np.ndenumerate(totals):
            sign, rest, limb = (1 if total > 0 else -1), abs(int(total)), 0
            while rest:
                rows.append((part, entry, at, limb, sign * (rest & ((1 << _LIMB) - 1))))
                rest, limb = rest >> _LIMB, limb + 1
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)], names=["part", "entry", "at", "limb", "n"]
        )

    parts = vectors.select("vector").mapInArrow(sums, "part int, entry int, at int, limb int, n long")
    # As many rows as the codebooks have numbers, whatever the number of vectors.
    added = parts.groupBy("part", "entry", "at", "limb").agg(F.sum("n").alias("n")).collect()
    totals: dict[tuple[int, int, int], int] = {}
    for part, entry, at, limb, n in added:
        totals[part, entry, at] = totals.get((part, entry, at), 0) + (n << (_LIMB * limb))
    moved = books.entries.astype(object)
    for part, entry, at in np.ndindex(*moved.shape):
        count = totals.get((part, entry, -1), 0)
        if count:
            moved[part, entry, at] = totals.get((part, entry, at), 0) // count
    return Codebooks(_narrow(moved))


def _narrow(numbers: np.ndarray) -> np.ndarray:
    fits = all(-_LONG <= x < _LONG for x in numbers.ravel().tolist())
    return numbers.astype(np.int64) if fits else numbers


def _encoded(vectors: DataFrame, books: Codebooks, type_name: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    length = books.entries.shape[2]
    schema = T.StructType(
        [*vectors.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for _, chunk in _chunks(batch, type_name, length):
                codes, distances = shared.value.encode(chunk)
                texts += [row.tobytes().hex() for row in codes.astype(np.uint8)]
                errors += [e if e < _LONG else None for e in distances.astype(object).sum(axis=1).tolist()]
            columns = [*batch.select(["vec_id", "label"]).columns, pa.array(texts, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    return vectors.mapInArrow(encode, schema)


def train(vectors: DataFrame, type_name: str) -> Codebooks | None:
    """Codebooks fitted on all packed vectors; none if there are no vectors."""
    width = np.dtype(type_name).itemsize
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    if not seeds:
        return None
    longest = vectors.agg(F.max(F.octet_length("vector"))).first()[0] // width
    start = _cut([bytes(row[0]) for row in seeds], type_name, -(-longest // PARTS))
    books = Codebooks(_narrow(start.transpose(1, 0, 2).astype(object)))
    for _ in range(ROUNDS):
        books = _moved(vectors, books, type_name)
    return books


def compress(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector."""
    rows, type_name = packed(vectors, id_col, vector_col, label_col)
    books = train(rows, type_name)
    if books is None:
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (("code", "string"), ("error", "long"), ("label_error", "long"))]
        return rows.select("vec_id", *none, F.lit(None).cast("string").alias("codebooks_sha256"))
    coded = save(_encoded(rows, books, type_name), "codes")
    total, known = F.sum(F.col("error").cast("decimal(20,0)")), F.count("error") == F.count(F.lit(1))
    by_label = coded.groupBy("label").agg(F.when(known, total).alias("total"))
    fits = F.col("total") <= F.lit(_LONG - 1)
    # One short row per label, written so that its size is known; a hot label is no group to be held.
    by_label = save(by_label.select(F.col("label").alias("_label"), F.when(fits, F.col("total").cast("long")).alias("label_error")), "labels")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
