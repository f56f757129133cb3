"""Benchmark contamination with one Aho-Corasick automaton over normalised items.

Items and documents are cut into words (runs of ASCII letters and digits and of everything beyond
ASCII, A-Z lower-cased). A window is WINDOW consecutive words of an item, or a whole shorter item.
Every window holds one of the item's blocks, which begin at multiples of half a window; so the
automaton's patterns are the blocks, written with three characters per word from a small alphabet, and
it grows by three states for each word of the benchmark. It scans a document's words once. Where a block stands, the words
around it are compared with the item's, up to a window on each side: every window that occurs is
found that way, and nothing else. Spans are mapped back to code points of the original text, for
which only documents with a match pay.

The benchmark, a stated set of queries, goes to every executor: its size is checked against
MAX_BENCHMARK_BYTES. A worker process builds its automaton once, whatever the benchmark's size.

Defined results: null and wordless texts have no words, no hits and are clean; an item without words
has no window; items of equal id count once, a null id as `null`; an empty benchmark hits nothing.
Rows are judged one by one, so repeated rows and ids, and further columns, stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedgate.llm.common import small_batches

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
HIT_SHARE = 20
#: A worker takes about 28 bytes for each of them.
MAX_BENCHMARK_BYTES = 32_000_000
#: Numbers for words; beyond them words share numbers, and are told apart where a block is compared.
WORD_NUMBERS = 1_000_000
#: A word's number is written in three digits of this base, the first from an alphabet of its own, so that
#: blocks are found at words only and no state has many successors, which are searched one by one.
_BASE, _DIGITS = 101, 3
_UNKNOWN = "\0" * _DIGITS

_SPACED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_ORIGINAL_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
        T.StructField(
            "spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
        ),
    ]
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACED).split()


class Matcher:
    """The automaton of a benchmark, given as (id, text) items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window, self.block = window, (window + 1) // 2
        self.reach = window - self.block
        self.number: dict[bytes, str] = {}
        self.words: list[list[bytes]] = []
        known: dict[bytes, bytes] = {}
        names_at: dict[tuple, tuple[int, int, int, set[str]]] = {}
        patterns: dict[str, list[tuple[int, int, int, set[str]]]] = {}
        for name, text in items:
            words = [known.setdefault(word, word) for word in normal_words(text)]
            at = len(self.words)
            self.words.append(words)
            # A short item is one window, and its own block.
            size = self.block if len(words) >= window else len(words)
            for start in range(0, len(words) - size + 1, self.block) if words else ():
                left, right = max(0, start - self.reach), start + size + self.reach
                # Blocks amid equal words are compared once, for all items that have them.
                context = (size, start - left, *words[left:right])
                place = names_at.get(context)
                if place is None:
                    place = names_at[context] = (at, start, size, set())
                    patterns.setdefault(self._written(words[start : start + size]), []).append(place)
                place[3].add(name)
        self.automaton = ahocorasick.Automaton()
        for pattern, places in patterns.items():
            self.automaton.add_word(pattern, places)
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def _written(self, words: list[bytes]) -> str:
        return "".join(self._characters(word) for word in words)

    def _characters(self, word: bytes) -> str:
        if word not in self.number:
            at = len(self.number) % WORD_NUMBERS
            high, rest = divmod(at, _BASE * _BASE)
            self.number[word] = chr(1 + _BASE + high) + chr(1 + rest // _BASE) + chr(1 + rest % _BASE)
        return self.number[word]

    def scan(self, words: list[bytes]) -> list[tuple[int, int, set[str]]]:
        """(first word, word after the last, items) of stretches in which every window is an item's."""
        if self.empty:
            return []
        number, found = self.number.get, []
        for last, places in self.automaton.iter("".join([number(word, _UNKNOWN) for word in words])):
            end = last // _DIGITS
            for item, start, size, names in places:
                theirs, first = self.words[item], end + 1 - size
                if words[first : end + 1] != theirs[start : start + size]:
                    continue  # words that share a number
                need = min(self.window, len(theirs))
                reach = self.reach if len(theirs) >= self.window else 0
                before = _common(reversed(words[max(0, first - reach) : first]), reversed(theirs[max(0, start - reach) : start]))
                after = _common(words[end + 1 : end + 1 + reach], islice(theirs, start + size, start + size + reach))
                if before + size + after >= need:
                    found.append((first - before, end + 1 + after, names))
        return found


def _common(one, other) -> int:
    """Equal words at the beginning of both."""
    count = 0
    for a, b in zip(one, other):
        if a != b:
            break
        count += 1
    return count


_built: dict[tuple[str, int], Matcher] = {}


def matcher(items: tuple[tuple[str, str], ...], digest: str, window: int) -> Matcher:
    """The automaton of a worker process, built for its first batch."""
    if (digest, window) not in _built:
        _built.clear()
        _built[digest, window] = Matcher(list(items), window)
    return _built[digest, window]


def judge_text(text: str | None, found: Matcher, share: int) -> dict:
    """One RESULT."""
    words = normal_words(text)
    hits = found.scan(words) if words else []
    items: set[str] = set()
    n_hit, spans = 0, []
    if hits:
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, [first for first, _, _ in hits], 1)
        np.add.at(depth, [after for _, after, _ in hits], -1)
        hit = np.cumsum(depth)[:-1] > 0
        n_hit = int(hit.sum())
        edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        places = [match.span() for match in _ORIGINAL_WORD.finditer(text)]
        spans = [
            {"start": places[first][0], "end": places[after - 1][1]} for first, after in zip(edges[::2], edges[1::2])
        ]
        items.update(*(names for _, _, names in hits))
    return {
        "n_words": len(words),
        "n_hit": n_hit,
        "n_items": len(items),
        "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
        "contaminated": n_hit > 0 and share * n_hit >= len(words),
        "spans": spans,
    }


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[tuple[tuple[str, str], ...], str]:
    """Different (id, text) items of a benchmark that is small enough, and a digest that names them."""
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0]
    if (size or 0) > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has over {MAX_BENCHMARK_BYTES} bytes; judge against parts of it")
    name = F.coalesce(F.col(item_col).cast("string"), F.lit("null"))
    rows = benchmark.where(F.col(text_col).isNotNull()).select(name, F.col(text_col)).distinct()
    items = tuple(sorted((item, text) for item, text in rows.toLocalIterator()))
    digest = hashlib.sha256()
    for item, text in items:
        for part in (item, text):
            data = part.encode("utf-8", "surrogatepass")
            digest.update(b"%d:" % len(data) + data)
    return items, digest.hexdigest()


def contamination(
    text: Column,
    benchmark: DataFrame,
    *,
    item_col: str = "item_id",
    text_col: str = "text",
    window: int = WINDOW,
    share: int = HIT_SHARE,
) -> Column:
    """A RESULT struct for each text: words, hit words, items, verdict, and hit spans in code points."""
    small_batches(benchmark.sparkSession)
    shared = benchmark.sparkSession.sparkContext.broadcast(_items(benchmark, item_col, text_col))

    @F.arrow_udf(RESULT)
    def judged(texts: pa.Array) -> pa.Array:
        found = matcher(*shared.value, window)
        return pa.array([judge_text(text.as_py(), found, share) for text in texts], _ARROW)

    return judged(text)
