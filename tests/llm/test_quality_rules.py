import re
from collections import Counter

from pyspark.sql import functions as F

from feedgate.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    times = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if times[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_against_plain_form(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [None, "", " \n\t", "a", "a b c a b c a", "a\n a\na\n\n\n", "x y z", "#" * 70, "ü ü ü ü ü"]
    for text in texts:
        c = q.Counts(text)
        assert (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words) == brute(text)


def test_verdicts_and_columns(spark):
    clean = " ".join(f"w{i}ord" for i in range(60))
    texts = [clean, None, "", "a b c " * 60, " ".join(f"W{i}ORD!!" for i in range(60)), " ".join(f"w{i} |" for i in range(60)), clean]
    frame = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    order = q.cascade_order(frame, q.METHOD_RULES)
    assert {r.name for r in order} == {r.name for r in q.METHOD_RULES}
    rows = frame.select("doc_id", q.verdicts(F.col("text"), order).alias("v")).orderBy("doc_id").collect()
    assert [r.v.kept for r in rows] == [True, False, False, False, False, False, True]
    assert [r.v.base_failed for r in rows] == [False, True, True, True, False, False, False]
    good = q.keep_good(frame)
    assert good.columns == frame.columns
    assert sorted(r.doc_id for r in good.collect()) == [0, 6]
    assert q.keep_good(frame.limit(0)).count() == 0


def test_order_does_not_matter(spark):
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        rules = [*q.BASE_RULES, *q.METHOD_RULES]
        assert q.survives(row.text, rules) == q.survives(row.text, rules[::-1])


def test_labelled_good_documents_stay(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = [(r.quality, r.text) for r in docs.collect()]
    rules = [*q.BASE_RULES, *q.METHOD_RULES]
    bad = [q.survives(text, rules) for quality, text in rows if quality == 0]
    good = [q.survives(text, rules) for quality, text in rows if quality == 1 and q.Counts(text).n_words >= 50]
    assert sum(bad) <= 0.1 * len(bad)
    assert sum(good) >= 0.97 * len(good)
