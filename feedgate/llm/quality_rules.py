"""Quality rules as a short-circuit cascade.

A rule looks at lazily computed counts of a text and may reject it. On a seeded sample of about
SAMPLE_ROWS rows every rule's seconds and rejections are measured; rules then run by rejections per
second, most first, and a text stops at its first rejection. The order decides only how long it
takes: a text is kept if no rule rejects it, whatever the order.

Defined results: a null text is an empty one, has no words and is rejected for that. Rows are judged
one by one, so repeated rows and further columns stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedgate.llm.common import quoted, small_batches

SAMPLE_ROWS = 2000
SAMPLE_SEED = 6

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


class Counts:
    """What the rules ask about a text, each computed when it is first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [line for line in self.text.split("\n") if line.strip(_SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that the text has more than once."""
        if self.n_words < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(word, len(number)) for word in self.words], np.int64)
        pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(number) + ids[2:]
        _, place, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = (times > 1)[place]
        hit = np.zeros(self.n_words, bool)
        for shift in range(3):
            hit[shift : shift + len(twice)] |= twice
        return int(hit.sum())

    @cached_property
    def n_capital_words(self) -> int:
        """Words with some of A-Z and none of a-z, one-byte words left out."""
        return sum(1 for word in self.words if len(word) > 1 and word.isupper())


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Counts], bool]


#: Too few words, or over half of them in repeated windows.
BASE_RULES = (
    Rule("words", lambda c: c.n_words < 50),
    Rule("repeated_windows", lambda c: 100 * c.n_repeat_words > 50 * c.n_words),
)
#: Symbols, shouting, repeated lines, and words of unlikely length.
METHOD_RULES = (
    Rule("symbols", lambda c: 10 * c.n_symbols > 3 * c.n_words),
    Rule("capitals", lambda c: 10 * c.n_capital_words > 3 * c.n_words),
    Rule("repeated_lines", lambda c: 10 * c.n_dup_lines > 6 * len(c.lines)),
    Rule("word_length", lambda c: c.word_chars > 20 * c.n_words or c.word_chars < 2 * c.n_words),
)

VERDICT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def cascade_order(docs: DataFrame, rules: Sequence[Rule], *, text_col: str = "text") -> list[Rule]:
    """The rules by rejections per second on a sample; in the given order where the sample is empty."""
    small_batches(docs.sparkSession)
    rules = list(rules)
    rows = docs.count()
    sample = docs.select(F.col(text_col).alias("text")).sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), SAMPLE_SEED)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for i, rule in enumerate(rules):
                    start = time.perf_counter()
                    rejected[i] += bool(rule.rejects(Counts(text)))
                    seconds[i] += time.perf_counter() - start
        yield pa.RecordBatch.from_pydict({"rule": list(range(len(rules))), "seconds": seconds, "rejected": rejected})

    parts = sample.mapInArrow(measured, "rule long, seconds double, rejected long")
    totals = parts.groupBy("rule").agg(F.sum("seconds"), F.sum("rejected")).collect()
    worth = {rule: rejected / max(seconds, 1e-9) for rule, seconds, rejected in totals}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: (-worth.get(i, 0.0), i))]


def survives(text: str | None, ordered: Sequence[Rule]) -> bool:
    counts = Counts(text)
    return not any(rule.rejects(counts) for rule in ordered)


def kept(text: Column, ordered: Sequence[Rule]) -> Column:
    """Whether no rule rejects the text; stops at the first that does."""

    @F.arrow_udf(T.BooleanType())
    def judged(texts: pa.Array) -> pa.Array:
        return pa.array([survives(text, ordered) for text in texts.to_pylist()], pa.bool_())

    return judged(text)


def verdicts(text: Column, ordered: Sequence[Rule]) -> Column:
    """All base counts of a text and the verdict of the base rules and then of the cascade."""

    def one(text: str | None) -> dict:
        c = Counts(text)
        failed = any(rule.rejects(c) for rule in BASE_RULES)
        return {name: getattr(c, name) for name in VERDICT.names[:5]} | {
            "base_failed": failed,
            "kept": not failed and not any(rule.rejects(c) for rule in ordered),
        }

    @F.arrow_udf(VERDICT)
    def judged(texts: pa.Array) -> pa.Array:
        rows = [one(text) for text in texts.to_pylist()]
        columns = [
            pa.array([row[name] for row in rows], pa.bool_() if name in ("base_failed", "kept") else pa.int64())
            for name in VERDICT.names
        ]
        return pa.StructArray.from_arrays(columns, names=VERDICT.names)

    return judged(text)


def keep_good(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that no rule rejects, with their columns."""
    ordered = cascade_order(docs, [*BASE_RULES, *METHOD_RULES], text_col=text_col)
    return docs.where(kept(F.col(quoted(text_col)), ordered))
