import random

import numpy as np
import pytest

from feedgate.llm import substrings as s


def words(draw, n):
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(n)]


def test_gear_hash_is_the_rolling_one():
    data = np.frombuffer(b"some bytes that roll over a window of sixteen", np.uint8)
    fast, mask = s.gear_hash(data), (1 << 32) - 1
    for i in range(len(data)):
        h = 0
        for byte in data[max(0, i - 15) : i + 1].tolist():
            h = (2 * h + int(s._GEAR[byte])) & mask
        assert int(fast[i]) == h


def test_chunks_cover_texts_and_resist_insertions():
    draw = random.Random(1)
    for n in (1, 2, 3, 7, 50, 900):
        text = words(draw, n)
        _, found = s.chunks(" \n".join(text))
        assert [f for f, _, _, _ in found] == np.cumsum([0, *(k for _, k, _, _ in found[:-1])]).tolist()
        assert sum(k for _, k, _, _ in found) == n
    before = {c[2:] for c in s.chunks(" ".join(text))[1]}
    text[400:400] = words(draw, 3)
    after = {c[2:] for c in s.chunks(" ".join(text))[1]}
    assert len(after - before) <= 4
    assert s.chunks(None) == s.chunks(" \n") == (0, [])


def test_passages_of_fifty_words_are_found(spark):
    draw = random.Random(2)
    shared = [words(draw, draw.randint(51, 80)) for _ in range(25)]
    rows, holds = [], {}
    for i in range(400):
        text = words(draw, draw.randint(60, 200))
        if i % 4 == 0:
            passage, at = shared[i // 4 % 25], draw.randint(0, len(text))
            text[at:at] = [w.upper() if i % 8 else w for w in passage]
            holds[i] = (at, len(passage))
        rows.append((i, "\n".join(text), "k"))
    rows += [(900, None, "k"), (901, "", "k"), (902, "one two three", "k"), (903, rows[1][1], "k"), (903, rows[1][1], "k")]
    rows += [(910, "ha " * 300, "k"), (911, "so " + "ha " * 200, "k"), (912, "ha " * 9 + "end", "k"), (None, rows[5][1], "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, passages string")
    got = {r.doc_id: r.passages for r in s.repeated_passages(frame).collect()}
    assert set(got) == {*holds, 1, 903, 910, 911, 5, None}
    for i, (at, n) in holds.items():
        for first, length in got[i]:
            assert at - 3 <= first and first + length <= at + n + 3
        assert sum(p[1] for p in got[i]) >= s.PASSAGE
    assert s.repeated_passages(frame.limit(0)).count() == 0


def test_planted_tables_against_all_windows(spark):
    """Every document that shares 51 words with another is found."""
    docs = {r.doc_id: s.lower_bytes(r.text or "").split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    owners, many = {}, set()
    for name, text in docs.items():
        for i in range(len(text) - 50):
            window = tuple(text[i : i + 51])
            if owners.setdefault(window, name) != name:
                many.add(window)
    want = {name for name, text in docs.items() if any(tuple(text[i : i + 51]) in many for i in range(len(text) - 50))}
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id for r in s.repeated_passages(frame).collect()}
    assert len(want) > 10 and want <= got and len(got - want) <= 0.1 * len(docs)


def shared_words(docs, n=51):
    """Of each (id, text): the numbers of the words that lie in n words another document has too."""
    split = {doc: s.lower_bytes(doc[1] or "").split() for doc in docs}
    at = lambda doc: [(i, tuple(split[doc][i : i + n])) for i in range(len(split[doc]) - n + 1)]
    owners = {}
    for doc in split:
        for _, window in at(doc):
            owners.setdefault(window, set()).add(doc)
    found = [(doc, {j for i, window in at(doc) if len(owners[window]) > 1 for j in range(i, i + n)}) for doc in split]
    return sorted(((doc[0] is None, doc[0] or 0), sorted(held)) for doc, held in found if held)


def reported_words(frame):
    rows = [(r.doc_id, [j for p in r.passages for j in range(p[0], p[0] + p[1])], r.repeated_words) for r in s.repeated_passages(frame).collect()]
    assert all(n == len(held) == len(set(held)) for _, held, n in rows)
    return sorted(((name is None, name or 0), sorted(held)) for name, held, _ in rows)


def test_planted_tables_word_by_word(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = shared_words({(r.doc_id, r.text) for r in frame.collect()})
    assert len(want) > 10 and reported_words(frame) == want


def test_passages_around_the_least_length(spark):
    """51 words are found in any surroundings, 50 are not; neighbours from two documents are no passage."""
    draw = random.Random(3)
    rows = []
    for i in range(1500):
        passage = words(draw, 50 + i % 3)
        for copy in (0, 1):
            rows.append((2 * i + copy, " ".join(words(draw, draw.randint(0, 40)) + passage + words(draw, draw.randint(0, 40)))))
    left, right = words(draw, 40), words(draw, 40)
    rows += [(-1, " ".join(left + right)), (-2, " ".join(left)), (-3, " ".join(words(draw, 20) + right))]
    short = [draw.choice("ab") for _ in range(300)]
    rows += [(-4, " ".join(short)), (-5, " ".join(words(draw, 9) + short[100:151])), (-6, " ".join(short[200:250])), (-7, "ha " * 51), (-8, "ha " * 60), (-9, "ha " * 50), (None, "ha " * 51)]
    want = shared_words(rows)
    assert len(want) >= 2000
    assert reported_words(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_a_copy_of_the_least_length_has_a_key_in_common():
    draw = random.Random(4)
    for _ in range(5000):
        passage = words(draw, 51)
        keys = [
            {c[2:] for c in s.chunks(" ".join(words(draw, draw.randint(0, 30)) + passage + words(draw, draw.randint(0, 30))))[1]}
            for _ in (0, 1)
        ]
        assert keys[0] & keys[1]


def test_copies_that_runs_of_chunks_lost(spark):
    """51 words in surroundings that left runs of repeated chunks fewer than 24 words."""
    rows = []
    for seed in (1292, 2074, 3016, 5231, 5744):
        draw = random.Random(seed)
        passage = words(draw, 51)
        rows += [(len(rows) + copy, " ".join(words(draw, 20) + passage + words(draw, 20))) for copy in (0, 1)]
    got = reported_words(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == [((False, i), list(range(20, 71))) for i in range(10)]


def test_every_window_of_a_copy_is_a_candidate():
    """Few different words make many equal hashes and short chunks; no window that two texts share is lost."""
    draw = random.Random(7)
    for _ in range(500):
        letters = draw.choice([["a"], ["a", "b"], ["a", "b", "c", "dd"], [f"w{i}" for i in range(200)]])
        some = lambda n: [draw.choice(letters) for _ in range(n)]
        passage = some(draw.randint(51, 60))
        texts = [some(draw.randint(0, 40)) + passage + some(draw.randint(0, 40)) for _ in (0, 1)]
        held = [s.chunks(" ".join(text))[1] for text in texts]
        both = {c[2:] for c in held[0]} & {c[2:] for c in held[1]}
        shared = set.intersection(*({tuple(text[i : i + 51]) for i in range(len(text) - 50)} for text in texts))
        for text, found in zip(texts, held):
            firsts, _ = s.windows(" ".join(text), [c[0] + c[1] for c in found if c[2:] in both])
            assert {i for i in range(len(text) - 50) if tuple(text[i : i + 51]) in shared} <= set(firsts.tolist())


def test_ids_that_are_no_numbers_are_refused(spark):
    frame = spark.createDataFrame([("a", "one two")], "doc_id string, text string")
    with pytest.raises(TypeError, match="doc_id is string"):
        s.repeated_passages(frame)
