"""Personal data: exact base kinds, and candidates that boosted trees select.

The base kinds (email, ip, card, phone) are patterns with a check. Beside them, generators of high
recall propose overlapping spans: number-like, handle-like and token-like ones. Trees boosted on
all candidates of all texts score each by its format and the text before it; candidates of equal
features and label are counted, and weigh as many. What the trees learn is to tell candidates that cover a checked base span, or that the text itself names as a secret, from
those that do not. A threshold for each
generator is calibrated on held-out candidates, and selected candidates that overlap no base span
are added. Everything that reads texts is SQL functions.

Offsets are code points, ends exclusive. Spark reports no positions of matches, so matches are
enclosed in a private-use character (in texts it is replaced by its neighbour, which no pattern
tells apart) and offsets are sums of the lengths of the pieces.

Defined results: a null text is empty and has no spans; a corpus without candidates of both kinds
selects none. Rows are judged one by one: repeated rows and further columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedgate.llm import boosting
from feedgate.llm.common import quoted

#: Features are counts. Up to so many they are exact; larger ones are rounded down to five binary digits, so
#: that long random tokens share their features and the rows that the trees are fitted on stay few.
EXACT = 32
PRECISION = 0.95

BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "handle", "token")

_LOCAL = "A-Za-z0-9._%+-"
#: As the plain patterns, with possessive repetition and starts at the edge of a run, so that long
#: runs cost linear time: an earlier start in the same run would have matched as well.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "number": r"(?<![0-9])[0-9][0-9 ().-]{5,}[0-9]",
    "handle": rf"(?<![{_LOCAL}])[{_LOCAL}]++\s?(?:@|\[at\]|\(at\))\s?[A-Za-z0-9.-]++",
    "token": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+={0,2}+",
}
#: What stands before a secret that says so. Other tokens are told by what these look like.
_NAMED = r"(?i)(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?$"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_MARK, _NEIGHBOUR = "\ue000", "\ue001"
_CONTEXT = 24
_SPANS = "array<struct<start:int,end:int,m:string,before:string>>"

FEATURES = ("digits", "letters", "length", "groups", "capitals", "dots", "at", "plus", "digits_before", "assigned")


def _matches(text: Column, kind: str) -> Column:
    """All matches as start, end, the match, and some text before it."""
    pieces = F.split(F.regexp_replace(text, PATTERNS[kind], f"{_MARK}$0{_MARK}"), _MARK)
    sized = F.transform(
        pieces,
        lambda piece, i: F.struct(
            F.length(piece).alias("n"),
            F.when(i % 2 == 1, piece).otherwise("").alias("m"),
            F.when(i % 2 == 1, "").otherwise(F.right(piece, F.lit(_CONTEXT))).alias("tail"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(_SPANS).alias("found"))

    def step(state: Column, piece: Column) -> Column:
        span = F.struct(
            state["at"].alias("start"),
            (state["at"] + piece["n"]).alias("end"),
            piece["m"].alias("m"),
            state["tail"].alias("before"),
        )
        return F.struct(
            (state["at"] + piece["n"]).alias("at"),
            piece["tail"].alias("tail"),
            F.when(piece["m"] == "", state["found"]).otherwise(F.concat(state["found"], F.array(span))).alias("found"),
        )

    return F.aggregate(sized, start, step, lambda state: state["found"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda digit, i: F.when(i % 2 == 0, digit.cast("int")).otherwise(
            digit.cast("int") * 2 - F.when(digit.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(values, F.lit(0), lambda total, value: total + value) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.rlike(match, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        digits = _digits(match)
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _may_hold(text: Column, kind: str) -> Column:
    """A cheap test that no text with a match fails."""
    signs = {"email": ("@",), "phone": ("+",), "handle": ("@", "[at]", "(at)")}.get(kind)
    if signs is None:
        return F.lit(True)
    test = F.contains(text, F.lit(signs[0]))
    for sign in signs[1:]:
        test = test | F.contains(text, F.lit(sign))
    return test


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _feature(span: Column, name: str) -> Column:
    m, before = span["m"], span["before"]
    value = {
        "digits": lambda: F.length(_digits(m)),
        "letters": lambda: F.length(F.regexp_replace(m, "[^A-Za-z]", "")),
        "length": lambda: F.length(m),
        "groups": lambda: F.size(F.split(F.regexp_replace(m, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")),
        "capitals": lambda: F.length(F.regexp_replace(m, "[^A-Z]", "")),
        "dots": lambda: F.length(F.regexp_replace(m, "[^.]", "")),
        "at": lambda: F.instr(m, "@"),
        "plus": lambda: F.when(F.rlike(before, F.lit(r"\+[0-9 (]*$")), 1).otherwise(0),
        "digits_before": lambda: F.length(_digits(before)),
        "assigned": lambda: F.when(F.rlike(before, F.lit(r"[=:][\s\"']*$")), 1).otherwise(0),
    }[name]()
    step = F.pow(F.lit(2.0), F.floor(F.log2(value.cast("double"))) - 4)
    return F.when(value <= EXACT, value.cast("double")).otherwise(F.floor(value / step) * step)


@dataclass(frozen=True)
class Selector:
    """Fitted trees and the least score that selects a candidate, for each generator."""

    models: dict[str, list]
    least: dict[str, float]


def _with_matches(docs: DataFrame, text_col: str, kinds: Sequence[str]) -> DataFrame:
    """Adds __text and, for each kind, __kind: its matches, for base kinds those that hold."""
    text = F.translate(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), _MARK, _NEIGHBOUR)
    docs = docs.withColumn("__text", text)
    found = {}
    for kind in kinds:
        spans = F.when(_may_hold(F.col("__text"), kind), _matches(F.col("__text"), kind)).otherwise(F.array().cast(_SPANS))
        if kind in BASE:
            spans = F.filter(spans, lambda span: _holds(kind, span["m"]))
        found[f"__{kind}"] = spans
    return docs.withColumns(found)


def _base() -> Column:
    return F.concat(*(F.col(f"__{kind}") for kind in BASE))


def fit_selector(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Selector:
    """Trees and thresholds from the candidates of all rows; half of them, by hash, are held out for the thresholds.

    The driver receives a row for each different combination of features and label, with its count.
    """
    key = F.xxhash64(F.col(quoted(id_col)), F.col(quoted(text_col)))
    texts = docs.select(key.alias("__key"), F.col(quoted(text_col)).alias("text"))
    found = _with_matches(texts, "text", [*BASE, *ADDED]).withColumn("__base", _base())
    rows = None
    for kind in ADDED:
        named = (lambda span: F.rlike(span["before"], F.lit(_NAMED))) if kind == "token" else (lambda span: F.lit(False))
        spans = F.transform(
            f"__{kind}",
            lambda span: F.struct(
                *(_feature(span, name).alias(name) for name in FEATURES),
                (F.exists("__base", lambda base: _overlap(base, span)) | named(span)).cast("int").alias("label"),
                span["start"].alias("start"),
            ),
        )
        part = found.select("__key", F.lit(kind).alias("kind"), F.explode(spans).alias("c"))
        rows = part if rows is None else rows.unionByName(part)
    held_out = F.pmod(F.xxhash64("__key", "kind", "c.start"), F.lit(2)) == 1
    counted = rows.groupBy("kind", held_out.alias("held"), *(F.col(f"c.{name}") for name in (*FEATURES, "label")))
    cells = counted.agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas().sort_values(["kind", "held", "label", *FEATURES])
    models, least = {}, {}
    for kind in ADDED:
        own = cells[cells["kind"] == kind]
        x, y, n = own[list(FEATURES)].to_numpy(float), own["label"].to_numpy(float), own["n"].to_numpy(float)
        held = own["held"].to_numpy(bool)
        models[kind], least[kind] = [], float("inf")
        if 0 < y[~held].sum() < len(y[~held]) or (len(y) and y[~held].all()):
            models[kind] = boosting.fit(x[~held], y[~held], n[~held])
            least[kind] = boosting.threshold(boosting.scores(models[kind], x[held]), y[held], PRECISION, n[held])
    return Selector(models, least)


def find(docs: DataFrame, selector: Selector, *, text_col: str = "text") -> DataFrame:
    """`docs` with __spans: array of (kind, start, end), base kinds first as listed, then by start."""
    kinds = [kind for kind in ADDED if selector.least[kind] < float("inf")]
    found = _with_matches(docs, text_col, [*BASE, *kinds]).withColumn("__base", _base())
    plain = "array<struct<kind:string,start:int,end:int>>"
    scored = "array<struct<kind:string,start:int,end:int,score:double>>"
    candidates = [F.array().cast(scored)]
    for kind in kinds:
        model, least = selector.models[kind], selector.least[kind]
        fresh = F.filter(f"__{kind}", lambda span: ~F.exists("__base", lambda base: _overlap(base, span)))
        rated = F.transform(
            fresh,
            lambda span: F.struct(
                F.lit(kind).alias("kind"),
                span["start"].alias("start"),
                span["end"].alias("end"),
                boosting.score_column(model, lambda i: _feature(span, FEATURES[i])).alias("score"),
            ),
        )
        candidates.append(F.filter(rated, lambda span: span["score"] >= F.lit(least)).cast(scored))
    found = found.withColumn("__selected", F.concat(*candidates))
    # Of overlapping candidates the one with the highest score stays, of equal ones the earliest.
    rank = lambda span: F.struct(-span["score"], span["start"], span["end"], span["kind"])
    best = F.filter(
        "__selected",
        lambda span: ~F.exists("__selected", lambda other: _overlap(other, span) & (rank(other) < rank(span))),
    )
    named = lambda spans, kind: F.transform(
        spans, lambda s: F.struct((kind if kind is not None else s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    ).cast(plain)
    base = [named(F.col(f"__{kind}"), F.lit(kind)) for kind in BASE]
    added = [
        F.array_sort(named(F.filter(best, lambda s: s["kind"] == kind), None)) for kind in kinds
    ]
    found = found.withColumn("__spans", F.concat(*base, *added, F.array().cast(plain)))
    return found.drop("__text", "__base", "__selected", *(f"__{kind}" for kind in [*BASE, *kinds]))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, selector: Selector, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`docs` with every span of the text replaced by its kind in brackets; null texts stay null."""
    found = find(docs, selector, text_col=text_col)
    text = F.col(quoted(text_col))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("pieces"))

    def step(state: Column, span: Column) -> Column:
        fresh = span["start"] >= state["at"]
        between = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        label = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
        return F.struct(
            F.greatest(state["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(state["pieces"], F.array(between, label))).otherwise(state["pieces"]).alias("pieces"),
        )

    ordered = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    clean = F.aggregate(
        ordered,
        start,
        step,
        lambda state: F.concat(F.array_join(state["pieces"], ""), F.substring(text, state["at"] + 1, F.length(text))),
    )
    value = F.when(text.isNull() | (F.size("__spans") == 0), text).otherwise(clean)
    return found.withColumn(text_col, value).drop("__spans")
