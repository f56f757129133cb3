"""Quality scores from random-indexing word vectors and a two-layer network.

Tokens are runs of letters, of digits and of other signs, so a word and the signs on it are
neighbours. Every token has a sparse random index vector of +1 and -1, drawn from its hash. A unit's vector is
the sum of the index vectors of all neighbours its tokens have in the whole corpus, of unit length, times
its rarity. A token that makes up at least one in FREQUENT of all tokens is a unit of its own. Rarer ones have
too few neighbours for that: their units are their pieces (three bytes, with the edges as bytes), whose
vectors are averaged; pieces rarer than one in FREQUENT are one unit together. Tokens and pieces are counted
exactly, over all rows, so what is a unit does not depend on how rows are spread.

There can be no more than FREQUENT units of either kind, whatever the corpus, so their vectors are
broadcast, and none is shared by accident. Sums of neighbours and of vectors are of integers (vectors are
rounded to 1 / SCALE), so neither the order nor the repetition of tasks changes them. A document is the
mean of its tokens' vectors, with three counts.

Two layers in numpy are fitted on a bounded sample of labelled rows (TRAIN_ROWS); a temperature,
fitted on rows kept from it, calibrates the probability. What is collected is bounded by FREQUENT,
DIMENSIONS and TRAIN_ROWS; counts, vectors and scores cover all tokens of all rows.

Defined results: a null text is an empty one; texts without tokens are pooled to zeros and scored
like any other; rows are scored one by one, so repeated rows and ids stay; labels that are null do
not count; without labels of both kinds every score is the share of ones, or 0.5 with no label.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedgate.llm.common import arrow_rows, small_batches
from feedgate.sources.scratch import save

DIMENSIONS = 32
NONZERO = 2
#: A token, or a piece, is frequent if it makes up one in this many: so many units there are at most.
FREQUENT = 1 << 16
SCALE = 1 << 20
TRAIN_ROWS = 20_000
HIDDEN = 24
EXTRA = 3
SEED = 3

_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x00-\x20A-Za-z0-9\x80-\xff]+")
#: Different tokens a task keeps in mind, and tokens it works on at once.
_HELD_TOKENS = 300_000
_AT_ONCE = 250_000
#: Occurrences after which sums are handed over: each adds 2 * NONZERO at most, so 32 bits hold them.
_HELD_OCCURRENCES = 1 << 27

_SUMS = [f"s{i}" for i in range(DIMENSIONS)]


def tokens_of(text: str | None) -> list[bytes]:
    return _TOKEN.findall((text or "").encode("utf-8", "surrogatepass"))


def index_places(drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of index vectors, by the tokens' hashes; equal places add up."""
    turns = 8 * np.arange(NONZERO)
    return drawn[:, None] >> turns & DIMENSIONS - 1, 1 - 2 * (drawn[:, None] >> turns + 7 & 1)


def pieces_of(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every piece of every token as a number, and the place of its token in the list.

    A token has as many pieces as bytes. Zero, which no token has, stands for the edges.
    """
    joined = np.frombuffer(b"\0" + b"\0".join(tokens) + b"\0", np.uint8).astype(np.int32)
    middle = np.flatnonzero(joined[1:-1]) + 1
    numbers = joined[middle - 1] << 16 | joined[middle] << 8 | joined[middle + 1]
    return numbers, np.repeat(np.arange(len(tokens)), [len(token) for token in tokens])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and pieces of a task with counts; a piece is told by its leading zero."""

    def rows() -> Iterator[pa.RecordBatch]:
        tokens, often = list(found), np.fromiter(found.values(), np.int64, len(found))
        numbers, owner = pieces_of(tokens)
        different, place = np.unique(numbers, return_inverse=True)
        whole = np.bincount(place, often[owner], len(different)).astype(np.int64)
        names = [int(number).to_bytes(4, "big") for number in different]
        for units, counts in ((tokens, often), (names, whole)):
            for at in range(0, len(units), 10_000):
                columns = [pa.array(units[at : at + 10_000], pa.binary()), pa.array(counts[at : at + 10_000])]
                yield pa.RecordBatch.from_arrays(columns, names=["unit", "count"])

    found: Counter[bytes] = Counter()
    for (text,) in arrow_rows(batches, "text"):
        found.update(tokens_of(text))
        if len(found) >= _HELD_TOKENS:
            yield from rows()
            found.clear()
    if found:
        yield from rows()


@dataclass(frozen=True)
class Units:
    """What has a vector: frequent tokens, then frequent pieces, then all other pieces together."""

    words: list[bytes]
    pieces: np.ndarray
    """Numbers of pieces, ascending."""

    @cached_property
    def _by_word(self) -> dict[bytes, int]:
        return {word: i for i, word in enumerate(self.words)}

    def places(self, tokens: list[bytes]) -> np.ndarray:
        """Units of tokens, -1 for rare ones."""
        return np.fromiter(map(self._by_word.get, tokens, repeat(-1)), np.int64, len(tokens))

    def __len__(self) -> int:
        return len(self.words) + len(self.pieces) + 1

    @cached_property
    def _by_number(self) -> np.ndarray:
        """Unit by number of the piece; pages that no piece falls on take no memory."""
        table = np.zeros(1 << 24, np.int32)
        table[self.pieces] = np.arange(len(self.pieces)) - len(self.pieces)
        return table

    def of_pieces(self, numbers: np.ndarray) -> np.ndarray:
        return self._by_number[numbers] + (len(self) - 1)


def find_units(docs: DataFrame, *, frequent: int = FREQUENT) -> tuple[Units, int]:
    """Frequent tokens and pieces of all rows of ``docs`` (text), and the number of all tokens."""
    parts = docs.select("text").mapInArrow(_tally, "unit binary, count long")
    counts = save(parts.groupBy("unit").agg(F.sum("count").alias("count")), "tokens")
    piece = F.startswith("unit", F.lit(b"\0"))
    sums = {row.piece: row.total for row in counts.groupBy(piece.alias("piece")).agg(F.sum("count").alias("total")).collect()}
    least = F.when(piece, sums.get(True, 0)).otherwise(sums.get(False, 0))
    # Shares add up to one, so there are at most `frequent` of either kind.
    top = [bytes(row.unit) for row in counts.where(F.col("count") * frequent >= least).select("unit").collect()]
    words = sorted(unit for unit in top if unit[0])
    pieces = np.array(sorted(int.from_bytes(unit, "big") for unit in top if not unit[0]), np.int32)
    return Units(words, pieces), sums.get(False, 0)


def _grown(table: np.ndarray, size: int) -> np.ndarray:
    """The table with room for so many rows, at least twice what it had if that is not enough."""
    if size <= len(table):
        return table
    more = np.zeros((max(size, 2 * len(table)), *table.shape[1:]), table.dtype)
    more[: len(table)] = table
    return more


class _Held(dict):
    """Tokens of a task numbered as they come, with their counts and sums of neighbours' index vectors."""

    def __init__(self) -> None:
        self.fresh: list[int] = []
        self.seen = self.drawn = 0
        self.counts, self.sums = np.zeros(1 << 16, np.int64), np.zeros((1 << 16, DIMENSIONS), np.int32)
        self.places, self.signs = np.zeros((1 << 16, NONZERO), np.int64), np.zeros((1 << 16, NONZERO), np.int32)

    def __missing__(self, token: bytes) -> int:
        number = self[token] = len(self)
        self.fresh.append(zlib.crc32(token, SEED))
        return number

    def add(self, ids: list[np.ndarray], left: list[np.ndarray], right: list[np.ndarray]) -> None:
        """Occurrences, and pairs of neighbours."""
        for name in ("counts", "sums", "places", "signs"):
            setattr(self, name, _grown(getattr(self, name), len(self)))
        self.places[self.drawn : len(self)], self.signs[self.drawn : len(self)] = index_places(np.array(self.fresh, np.int64))
        self.drawn, self.fresh = len(self), []
        own, one, other = np.concatenate(ids), np.concatenate(left), np.concatenate(right)
        self.seen += len(own)
        self.counts += np.bincount(own, minlength=len(self.counts))
        flat = self.sums.reshape(-1)
        for at, by in ((one, other), (other, one)):
            places, signs = self.places[by], self.signs[by]
            for k in range(NONZERO):
                np.add.at(flat, at * DIMENSIONS + places[:, k], signs[:, k])

    def hand_over(self, units: Units, counts: np.ndarray, sums: np.ndarray) -> None:
        """Adds what is held to the units, ``sums`` by dimension: to a token's own, or to all its pieces'."""
        if not self:
            return
        tokens, own = list(self), np.ascontiguousarray(self.sums[: len(self)].T)
        place = units.places(tokens)
        words, rest = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        numbers, owner = pieces_of([tokens[i] for i in rest])
        unit, source = units.of_pieces(numbers), rest[owner]
        # Tokens are different, so no place comes twice. Whole numbers below 2 ** 53 are exact as weights.
        counts[place[words]] += self.counts[words]
        counts += np.bincount(unit, self.counts[source], len(counts)).astype(np.int64)
        for i in range(DIMENSIONS):
            sums[i, place[words]] += own[i, words]
            sums[i] += np.bincount(unit, own[i][source], len(counts)).astype(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch], units: Units) -> Iterator[pa.RecordBatch]:
    """Occurrences and sums of neighbours' index vectors over a task: one row per unit that occurs."""
    counts, sums = np.zeros(len(units), np.int64), np.zeros((DIMENSIONS, len(units)), np.int64)
    held, ids, left, right, waiting = _Held(), [], [], [], 0
    for (text,) in arrow_rows(batches, "text"):
        tokens = tokens_of(text)
        for at in range(0, len(tokens), _AT_ONCE):
            # The token before the stretch is a neighbour of its first, and counted with its own stretch.
            begin = max(at - 1, 0)
            some = np.fromiter(map(held.__getitem__, tokens[begin : at + _AT_ONCE]), np.int64)
            ids.append(some[at - begin :])
            left.append(some[:-1])
            right.append(some[1:])
            waiting += len(some)
            if waiting >= _AT_ONCE:
                held.add(ids, left, right)
                ids, left, right, waiting = [], [], [], 0
                if len(held) >= _HELD_TOKENS or held.seen >= _HELD_OCCURRENCES:
                    held.hand_over(units, counts, sums)
                    held = _Held()
    if ids:
        held.add(ids, left, right)
    held.hand_over(units, counts, sums)
    seen = np.flatnonzero(counts)
    for at in range(0, len(seen), 10_000):
        some = seen[at : at + 10_000]
        columns = [pa.array(some), pa.array(counts[some]), *(pa.array(sums[i, some]) for i in range(DIMENSIONS))]
        yield pa.RecordBatch.from_arrays(columns, names=["unit", "count", *_SUMS])


def unit_vectors(docs: DataFrame, units: Units, total: int) -> np.ndarray:
    """The units' vectors times rarity and SCALE in whole numbers, from all rows of ``docs`` (text)."""
    shared = docs.sparkSession.sparkContext.broadcast(units)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _contexts(batches, shared.value)

    types = ", ".join(f"{name} long" for name in ("unit", "count", *_SUMS))
    parts = docs.select("text").mapInArrow(contexts, types)
    vectors = np.zeros((len(units), DIMENSIONS), np.int64)
    rows = parts.groupBy("unit").agg(*(F.sum(name).alias(name) for name in ("count", *_SUMS))).collect()  # a row per unit
    for row in rows:
        sums = np.array(row[2:], float)
        length = max(np.sqrt((sums * sums).sum()), 1e-9)
        vectors[row["unit"]] = np.rint(sums / length * np.log1p(total / row["count"]) * SCALE)
    return vectors


class _Vectors(dict):
    """Tokens numbered as they come, and their vectors in whole numbers."""

    def __init__(self, units: Units, vectors: np.ndarray) -> None:
        self.units, self.vectors, self.columns = units, vectors, np.ascontiguousarray(vectors.T.astype(float))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.done, self.rows = 0, np.zeros((1 << 16, DIMENSIONS), np.int32)

    def __missing__(self, token: bytes) -> int:
        number = self[token] = len(self)
        return number

    def complete(self) -> np.ndarray:
        """Vectors of all tokens numbered so far; of a rare token its pieces' mean, rounded down."""
        if self.done < len(self):
            fresh = list(islice(self, self.done, None))
            place = self.units.places(fresh)
            rows, rest = self.vectors[place], np.flatnonzero(place < 0)
            tokens = [fresh[i] for i in rest]
            numbers, owner = pieces_of(tokens)
            unit, sizes = self.units.of_pieces(numbers), np.array([len(token) for token in tokens], np.int64)
            means = [np.bincount(owner, column[unit], len(rest)).astype(np.int64) // sizes for column in self.columns]
            rows[rest] = np.array(means).T
            self.rows = _grown(self.rows, len(self))
            # A component is at most the rarity times SCALE, far below 2 ** 31.
            self.rows[self.done : len(self)] = rows
            self.done = len(self)
        return self.rows


def _pooled(batches: Iterator[pa.RecordBatch], units: Units, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
    held = _Vectors(units, vectors)

    def pool(some: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        table, row = held.complete(), np.zeros(DIMENSIONS + EXTRA)
        for ids, often in some:
            found, n = np.zeros(DIMENSIONS, np.int64), int(often.sum())
            for at in range(0, len(ids), 100_000):
                found += often[at : at + 100_000] @ table[ids[at : at + 100_000]]
            row[:DIMENSIONS] = found / SCALE / max(n, 1)
            row[DIMENSIONS:] = np.log1p(n), len(ids) / max(n, 1), np.sqrt((row[:DIMENSIONS] ** 2).sum())
            yield row.astype(np.float32)

    for batch in batches:
        rows, some, waiting = [], [], 0
        for text in batch.column("text").to_pylist():
            found = Counter(tokens_of(text))
            ids = np.fromiter(map(held.__getitem__, found), np.int64, len(found))
            some.append((ids, np.fromiter(found.values(), np.int64, len(found))))
            waiting += len(found)
            if waiting >= _AT_ONCE:
                rows.extend(pool(some))
                some, waiting = [], 0
                if len(held) >= _HELD_TOKENS:
                    held.forget()
        rows.extend(pool(some))
        flat = np.array(rows, np.float32).reshape(-1, DIMENSIONS + EXTRA)
        offsets = pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], names=["id", "x"])


def pooled(docs: DataFrame, units: Units, vectors: np.ndarray) -> DataFrame:
    """id and x of ``docs`` (id, text): the mean token vector, then log of its tokens, share of different ones, and length."""
    shared = docs.sparkSession.sparkContext.broadcast((units, vectors))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pooled(batches, *shared.value)

    types = T.StructType().add("id", docs.schema["id"].dataType).add("x", T.ArrayType(T.FloatType()))
    return docs.select("id", "text").mapInArrow(rows, types)


# ---------------------------------------------------------------- the network


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, spare: np.ndarray) -> Network:
    """Adam on the rows that are not `spare`; the temperature has the least log loss on those that are."""
    width = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(width)
    scale = np.maximum(x.std(0) if len(x) else np.ones(width), 1e-6)
    draw = np.random.default_rng(SEED)
    params = [draw.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), 0.0]
    share = y.mean() if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        constant = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return Network(mean, scale, params[0] * 0, params[1], params[2] * 0, constant, 1.0)
    own = np.flatnonzero(~spare) if 0 < y[~spare].sum() < (~spare).sum() else np.arange(len(y))
    first, second = [0.0 * p for p in params], [0.0 * p for p in params]
    z, steps = (x - mean) / scale, 0
    for _ in range(max(30, min(400, 400_000 // len(own)))):
        for rows in np.array_split(draw.permutation(own), max(1, len(own) // 256)):
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            error = (_sigmoid(hidden @ params[2] + params[3]) - y[rows]) / len(rows)
            back = np.outer(error, params[2]) * (1 - hidden**2)
            slopes = [z[rows].T @ back + 1e-4 * params[0], back.sum(0), hidden.T @ error + 1e-4 * params[2], error.sum()]
            steps += 1
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope**2
                rate = 0.01 * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
                params[i] = params[i] - rate * first[i] / (np.sqrt(second[i]) + 1e-8)
    plain = Network(mean, scale, *params, 1.0)
    temperature = 1.0
    if spare.any():
        logits, want = plain.logit(x[spare]), y[spare]
        tried = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, logits / t) - want * logits / t) for t in tried]
        temperature = float(tried[int(np.argmin(loss))])
    return Network(mean, scale, *params, temperature)


def score_documents(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """id, held_out, score and predicted of every row; labels of held-out ids are never looked at."""
    held = lambda name: F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 3 == 1
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    units, total = find_units(rows)
    points = save(pooled(rows, units, unit_vectors(rows, units, total)), "pooled")

    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held(id_col))
    known = known.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id", "y").limit(TRAIN_ROWS)
    train = points.join(F.broadcast(known), F.col("id") == F.col("label_id")).select("id", "x", "y")
    # An id that many rows carry could exceed the sample's bound: the bound holds for the rows.
    train = train.orderBy(F.xxhash64("id", "x"), "id", "y").limit(TRAIN_ROWS).select("id", "x", "y")
    found = train.withColumn("spare", F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(5)) == 0).collect()
    x = np.array([row["x"] for row in found], float).reshape(-1, DIMENSIONS + EXTRA)
    network = fit(x, np.array([row["y"] for row in found]), np.array([row["spare"] for row in found], bool))

    @F.arrow_udf(T.DoubleType())
    def scored(points: pa.Array) -> pa.Array:
        flat = points.flatten().to_numpy().astype(float)
        return pa.array(network.score(flat.reshape(-1, DIMENSIONS + EXTRA)))

    result = points.select("id", held("id").alias("held_out"), scored("x").alias("score"))
    return result.select(
        F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
