import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from feedgate.llm import contamination as c


def words_of(text):
    lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items):
    words, hit, names = words_of(text), set(), set()
    for name, item in items:
        parts = words_of(item)
        for k in range(max(1, len(parts) - 12) if parts else 0):
            window = parts[k : k + 13]
            for i in range(len(words) - len(window) + 1):
                if words[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    names.add(str(name))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)


def judge(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string, n_words string")
    frame = spark.createDataFrame(docs, "doc_id long, text string, contaminated string")
    got = frame.select("doc_id", "text", c.contamination(F.col("text"), bench).alias("r")).collect()
    return [(r.doc_id, r.text, tuple(r.r)[:5], [tuple(s) for s in r.r.spans]) for r in got]


def plain(text, items):
    r = c.judge_text(text, c.Matcher([(str(i), t) for i, t in items if t is not None], 13), 20)
    return tuple(r[name] for name in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))


@pytest.mark.parametrize("numbers", [1_000_000, 3, 1])
def test_random_texts_of_few_words_against_brute_force(monkeypatch, numbers):
    """Repeats, overlaps and near misses, also where words share numbers."""
    monkeypatch.setattr(c, "WORD_NUMBERS", numbers)
    rng = random.Random(numbers)
    hits = 0
    for _ in range(400):
        size = rng.choice([2, 3, 6])
        text = lambda n: " ".join(rng.choice("abcdef"[:size]) for _ in range(n))  # noqa: B023, E731
        items = [(k % 5, text(rng.choice([0, 1, 5, 12, 13, 14, 20, 26, 40]))) for k in range(rng.randint(1, 7))]
        source = rng.choice(items)[1].split()
        cut = rng.randint(0, len(source))
        doc = " ".join([text(rng.randint(0, 20)), *source[cut // 2 : cut + 15], text(rng.randint(0, 20))])
        assert plain(doc, items) == brute(doc, items), (doc, items)
        hits += plain(doc, items)[1] > 0
    assert hits > 100


def test_the_automaton_grows_with_the_words():
    words = [f"w{i}" for i in range(13_000)]
    items = [(str(k), " ".join(words[k * 130 : (k + 1) * 130])) for k in range(100)]
    found = c.Matcher(items, 13)
    assert found.automaton.get_stats()["nodes_count"] <= 3 * 13_000 + 1
    assert c.matcher(tuple(items), "d", 13) is c.matcher(tuple(items), "d", 13)


def test_a_large_benchmark_is_refused_and_not_cut(spark, monkeypatch):
    monkeypatch.setattr(c, "MAX_BENCHMARK_BYTES", 10)
    with pytest.raises(ValueError, match="10 bytes"):
        judge(spark, [(1, "x", "k")], [(1, "é" * 6, "x")])


@pytest.mark.parametrize("numbers", [1_000_000, 2])
def test_against_brute_force(spark, monkeypatch, numbers):
    monkeypatch.setattr(c, "WORD_NUMBERS", numbers)
    long = " ".join(f"w{i}" for i in range(30))
    items = [(2, long, "x"), (10, "Short Ünit, here!", "x"), (3, None, "x"), (4, " .,", "x"), (10, "Short Ünit, here!", "y"), (5, "w3 w4", "x")]
    docs = [
        (1, "before " + long.upper().replace(" ", " - ") + " after"),
        (2, "xshort ünit here y"),
        (3, "say short ünit... HERE and short ünit here"),
        (4, None),
        (5, ""),
        (6, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 " + "z " * 500),
        (7, " ".join(f"w{i}" for i in range(4, 25))),
        (7, "a b short ünit here " * 3),
    ]
    got = judge(spark, [(i, t, "k") for i, t in docs], items)
    assert len(got) == len(docs)
    for _, text, result, spans in got:
        assert result == brute(text, [(i, t) for i, t, _ in items if t])
        assert sum(len(words_of(text[a:b])) for a, b in spans) == result[1]


def test_empty_tables(spark):
    assert judge(spark, [(1, "some text", "k")], [])[0][2] == (2, 0, 0, hashlib.sha256(b"").hexdigest(), False)
    assert judge(spark, [], [(1, "a", "x")]) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = docs.select("doc_id", "text", c.contamination(F.col("text"), bench).alias("r")).collect()
    assert sum(r.r.n_hit > 0 for r in rows) > 0
    for r in rows:
        assert tuple(r.r)[:5] == brute(r.text, items)
