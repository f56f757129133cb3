"""Repeated passages by content-defined chunking with a gear rolling hash; exact windows decide.

A text's words, A-Z lower-cased and joined by single spaces, are one byte string. A gear hash
h = 2 h + gear[byte] rolls over it, and is kept to the last 16 bytes. A word end is a cut where its
hash is the smallest (the last of equal ones) among some REACH word ends that follow each other; a chunk
runs from cut to cut, so an insertion changes only the chunks around it. Chunks are deduplicated by a
digest of their words; one of fewer than LEAST words is digested together with the chunks after it, up
to that many.

From the ninth word on a passage's hashes depend on the passage alone. The first REACH of these word ends have
a smallest one and so have the last REACH; these are cuts wherever the passage stands, as are those
between them and no others, and they lie at least LEAST words apart. So two copies of PASSAGE words
have a digested chunk in common, always, and every chunk between these two cuts is in both. Windows of
PASSAGE words all of whose chunks are repeated, in any documents, are digested (128 bits) in turn, and those found in more than one
document are reported, joined where they overlap. So each reported word lies in PASSAGE words that
another document has too, if not always the same document along one passage.

Of the documents that have one text, only the one with the smallest id has its windows digested; the passages are all of theirs.
Chunks and windows are counted by partial aggregation, so a passage that a third of all documents share is
one short row for each task; the joins back are ones that adaptive execution splits.

Defined results: null texts and texts of fewer than PASSAGE words have no passages. Rows with equal id
and text are one document. Passages inside one document only are not reported. An empty table gives no
rows. Ids are whole numbers or null; a column of another type is refused with TypeError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedgate.llm.common import arrow_rows, lower_bytes, small_batches
from feedgate.sources.scratch import new_path, save, scoped

#: Words of a passage: over fifty.
PASSAGE = 51
#: Words of the shortest digest of a chunk.
LEAST = 8
_HASH_BYTES = 16
#: Words of a passage before the first whose hash depends on the passage alone: each has a byte and a space at least.
_UNSURE = _HASH_BYTES // 2
#: Word ends of which the smallest is a cut: the first and the last so many of a passage are LEAST words apart.
REACH = (PASSAGE - _UNSURE - LEAST + 1) // 2

_GEAR = np.random.default_rng(9).integers(0, 1 << 32, 256, dtype=np.uint32)

_CHUNKS = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("after", pa.int32()), ("d1", pa.int64())])
_WINDOWS = pa.schema([("version", pa.int64()), ("mark", pa.int64()), ("several", pa.bool_()), ("first", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])
_BATCH = 50_000


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the span it covers."""
    rolled, span = _GEAR[data], 1
    while span < _HASH_BYTES:
        longer = rolled.copy()
        longer[span:] += rolled[:-span] << np.uint32(span)
        rolled, span = longer, span * 2
    return rolled


def smallest(joined: bytes, ends: np.ndarray) -> np.ndarray:
    """Of each REACH word ends that follow each other, or of all of a shorter text: the one of the smallest hash.

    `ends`: where each word ends in `joined`.
    """
    hashes = gear_hash(np.frombuffer(joined, np.uint8))[ends - 1].astype(np.uint64)
    # Of equal hashes the last: numbers count down in the low half.
    lowest, span = hashes << np.uint64(32) | np.uint64(0xFFFFFFFF) - np.arange(len(ends), dtype=np.uint64), 1
    while span < REACH and len(lowest) > 1:
        step = min(span, REACH - span, len(lowest) - 1)
        lowest, span = np.minimum(lowest[:-step], lowest[step:]), span + step
    return (np.uint64(0xFFFFFFFF) - (lowest & np.uint64(0xFFFFFFFF))).astype(np.int64)


def cuts(joined: bytes, ends: np.ndarray) -> np.ndarray:
    """Numbers of words (from 1) after which a chunk ends; the last is the end of the text."""
    places = np.unique(smallest(joined, ends)) + 1
    return np.append(places[places < len(ends)], len(ends))


def _joined(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words as one byte string, and where each begins and ends in it."""
    words = lower_bytes(text or "").split()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def _digests(joined: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A row of two numbers for each part of the byte string."""
    digests = [xxhash.xxh3_128_digest(joined[i:j]) for i, j in zip(starts.tolist(), stops.tolist())]
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _reached(places: np.ndarray) -> np.ndarray:
    """For each chunk: the first cut at least LEAST words from its beginning, or the end of the text."""
    firsts = np.r_[0, places[:-1]]
    return places[np.minimum(np.searchsorted(places, firsts + LEAST), len(places) - 1)]


def chunks(text: str | None) -> tuple[int, list[tuple[int, int, int, int]]]:
    """A digest of the text, and (first word, words, digest, digest) of each chunk."""
    joined, begins, ends = _joined(text)
    if not len(ends):
        return 0, []
    places = cuts(joined, ends)
    firsts = np.r_[0, places[:-1]]
    digests = _digests(joined, begins[firsts], ends[_reached(places) - 1])
    result = list(zip(firsts.tolist(), (places - firsts).tolist(), digests[:, 0].tolist(), digests[:, 1].tolist()))
    return int(np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))).view(np.int64)), result


def windows(text: str, afters: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First words of the windows all of whose chunks are repeated, and the windows' digests.

    `afters`: the cuts that end repeated chunks. A window's chunks are those digested between the first and
    the last of the cuts that it has wherever it stands.
    """
    joined, begins, ends = _joined(text)
    places, lowest = cuts(joined, ends), smallest(joined, ends) + 1
    starts = np.arange(len(ends) - PASSAGE + 1)
    since, until = lowest[starts + _UNSURE], lowest[starts + PASSAGE - REACH]
    low, high = np.searchsorted(places, since) + 1, np.searchsorted(_reached(places), until, "right")
    # Digests that the text's end cut short are not the passage's.
    high = np.minimum(high, np.searchsorted(places, len(ends) - LEAST, "right") + 1)
    repeated = np.r_[0, np.cumsum(np.isin(places, afters))]
    firsts = starts[repeated[high] - repeated[low] == high - low]
    return firsts, _digests(joined, begins[firsts], ends[firsts + PASSAGE - 1])


def _batches(parts: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(names, numbers, digests) of each text as batches of many; the names are repeated for each number."""
    held: list[tuple] = []
    count = 0

    def batch() -> pa.RecordBatch:
        each = pa.array(np.repeat(np.arange(len(held)), [len(numbers) for _, numbers, _ in held]))
        names = [pa.array(column, field.type).take(each) for field, column in zip(schema, zip(*(names for names, _, _ in held)))]
        numbers = np.concatenate([numbers for _, numbers, _ in held]).astype(np.int32)
        digests = np.concatenate([digests for _, _, digests in held])
        columns = [*names, *map(pa.array, (numbers, *map(np.ascontiguousarray, digests.T)))]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for part in parts:
        held.append(part)
        count += len(part[1])
        if count >= _BATCH:
            yield batch()
            held, count = [], 0
    if held:
        yield batch()


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple]:
        for name, version, text in arrow_rows(batches, "id", "version", "text"):
            found = np.array(chunks(text)[1], np.int64).reshape(-1, 4)
            afters = found[:, 0] + found[:, 1]
            if len(afters) and afters[-1] >= PASSAGE:
                # The first chunk begins at no cut, the last ones may be cut short. Half a digest will do where windows decide.
                whole = (found[:, 0] > 0) & (found[:, 0] + LEAST <= afters[-1])
                yield (name, version), afters[whole], found[whole, 2:3]

    return _batches(parts(), _CHUNKS)


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts() -> Iterator[tuple]:
        for *names, text, afters in arrow_rows(batches, "version", "mark", "several", "text", "afters"):
            yield names, *windows(text, afters)

    return _batches(parts(), _WINDOWS)


_PASSAGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("n", T.IntegerType())]))


def join_windows(firsts: list[int]) -> list[tuple[int, int]]:
    """First word and words of the longest stretches of windows that overlap."""
    runs: list[list[int]] = []
    for first in sorted(firsts):
        if runs and first < runs[-1][1]:
            runs[-1][1] = first + PASSAGE
        else:
            runs.append([first, first + PASSAGE])
    return [(first, after - first) for first, after in runs]


def _repeated(rows: DataFrame, counted: DataFrame, label: str, *digest: str) -> DataFrame:
    """The rows whose digest is counted as one that more than one document has."""
    repeated = save(counted.where("low <> high").select(*(F.col(name).alias(f"r_{name}") for name in digest)), label)
    return rows.join(repeated, [F.col(name) == F.col(f"r_{name}") for name in digest], "left_semi")


def _distinct_texts(candidates: DataFrame) -> DataFrame:
    """A row for each text of the candidates: the smallest id that has it, and whether several have it."""
    some, all_of_them = F.count("id"), F.count(F.lit(1))
    several = F.coalesce(F.min("id") < F.max("id"), F.lit(False)) | ((some > 0) & (some < all_of_them))
    texts = candidates.groupBy("version", "mark").agg(F.min("id").alias("t_id"), several.alias("several"), F.first("afters").alias("afters"))
    return texts.withColumnRenamed("version", "t_version")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that shares passages with others.

    id, passages (array of first word and number of words), repeated_words.
    """
    spark = docs.sparkSession
    kind = docs.select(id_col).schema[0].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{id_col} is {kind.simpleString()}, not a whole number")
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # So many words have as many characters, and one between each two.
    rows = rows.where(F.length("text") >= 2 * PASSAGE - 1).select("id", F.xxhash64("text").alias("version"), "text")
    found_kind = "version long, mark long, several boolean, first int, d1 long, d2 long"
    holders, place = new_path(spark, "holders"), new_path(spark, "windows")
    with scoped(spark):
        cut = save(rows.mapInArrow(_chunk_rows, "id long, version long, after int, d1 long"), "chunks")
        # One number for a document, so that the counts stay fixed-width rows in a hash table.
        owner = F.xxhash64("id", "version")
        counted = cut.groupBy("d1").agg(F.min(owner).alias("low"), F.max(owner).alias("high"))
        repeated = _repeated(cut, counted, "repeated-chunks", "d1")
        # Copies of a text have the same repeated chunks; its hash and the least digest of these tell texts apart.
        marked = repeated.groupBy("id", "version").agg(F.collect_set("after").alias("afters"), F.min("d1").alias("mark"))
        candidates = save(marked, "candidates")
        candidates.select("id", "version", "mark").write.parquet(holders)
        texts = save(_distinct_texts(candidates), "texts")
        around = rows.join(texts, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("version") == F.col("t_version")))
        around = around.select("version", "mark", "several", "text", "afters")
        around.mapInArrow(_window_rows, found_kind).write.parquet(place)
    found = spark.read.schema(found_kind).parquet(place)
    # One number for a text, even; the odd one after it stands for its other copies.
    owner = F.xxhash64("version", "mark").bitwiseAND(F.lit(-2))
    counted = found.groupBy("d1", "d2").agg(F.min(owner).alias("low"), F.max(owner + F.col("several").cast("long")).alias("high"))
    by_text = _repeated(found, counted, "repeated-windows", "d1", "d2").groupBy("version", "mark").agg(F.collect_set("first").alias("found"))

    @F.arrow_udf(_PASSAGES)
    def joined(found: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))
        lists = [[{"first": a, "n": n} for a, n in join_windows(one)] for one in found.to_pylist()]
        return pa.array(lists, kind)

    passages = by_text.select("version", "mark", joined("found").alias("passages"))
    held = spark.read.schema("id long, version long, mark long").parquet(holders)
    result = held.join(passages, ["version", "mark"]).select(F.col("id").alias(id_col), "passages")
    words = F.aggregate("passages", F.lit(0).cast("long"), lambda total, p: total + p["n"])
    return result.withColumn("repeated_words", words)
