import random

import pytest
from pyspark.sql import functions as F

from feedgate.llm import catalog, licenses
from feedgate.llm.licenses import Automaton, Template, judge, parse, scan, words_of

MARKED = Template(
    "marked", "x",
    'a b <<beginOptional>>c <<beginOptional>>d<<endOptional>><<endOptional>> <<var;name="who";words="1-3">> e '
    '<<beginOptional>>a<<endOptional>> b',
)


def ends(items, words, at):
    """Brute force: every place a parsed template can end at, from a starting word."""
    if not items:
        return {at}
    item, rest = items[0], items[1:]
    if isinstance(item, bytes):
        return ends(rest, words, at + 1) if at < len(words) and words[at] == item else set()
    if isinstance(item, tuple):
        return set().union(*(ends(rest, words, at + n) for n in range(item[0], item[1] + 1) if at + n <= len(words)))
    return ends(rest, words, at) | set().union(*(ends(rest, words, end) for end in ends(item, words, at)))


def brute(templates, words):
    found = []
    for start in range(len(words)):
        for number, template in enumerate(templates):
            reached = ends(parse(template.text), words, start)
            if reached:
                found.append((number, start, max(reached) - start))
    return found


def test_automaton_equals_brute_force_on_small_alphabets():
    rng = random.Random(11)
    templates = (MARKED, Template("plain", "y", "a b"), Template("tail", "z", "b <<beginOptional>>b b<<endOptional>> a"))
    automaton = Automaton(templates)
    hits = 0
    for _ in range(8000):
        words = [rng.choice(b"abcde".decode()).encode() for _ in range(rng.randint(0, 14))]
        found = automaton.places(words)
        assert found == brute(templates, words), words
        hits += sum(1 for template, _, _ in found if template == 0)
    assert hits > 100


@pytest.mark.parametrize("template", licenses.TEMPLATES, ids=lambda t: t.name)
def test_every_template_accepts_its_wording_and_needs_each_mandatory_word(template):
    automaton = Automaton((template,))

    def written(items, full):
        out = []
        for item in items:
            if isinstance(item, bytes):
                out.append(item)
            elif isinstance(item, tuple):
                out += [b"zzz"] * item[1 if full else 0]
            elif full:
                out += written(item, full)
        return out

    for full in (True, False):
        words = written(parse(template.text), full)
        assert (0, 0, len(words)) in automaton.places(words)
    least = written(parse(template.text), False)
    for at, word in enumerate(least):
        if word != b"zzz":
            changed = [*least[:at], b"qqq", *least[at + 1 :]]
            assert (0, 0, len(least)) not in automaton.places(changed)


def test_forgetting_states_changes_nothing(monkeypatch):
    words = words_of("a b c d q q e a b a b x e b") * 5
    automaton = Automaton((MARKED,))
    expected = automaton.places(words)
    monkeypatch.setattr(licenses, "MAX_STATES", 1)
    assert expected and automaton.places(words) == expected == automaton.places(words)


@pytest.mark.parametrize("text", ["<<beginOptional>>a<<endOptional>>", "a <<var;name=\"x\";words=\"0-2\">>", "a <<beginOptional>>b", "a<<endOptional>>", "", "a <<var;name=\"x\">> b"])
def test_faulty_templates_are_refused(text):
    with pytest.raises(ValueError):
        Automaton((Template("t", "t", text),))


CASES = [
    (1, None), (2, ""), (3, "  \n"), (4, "MIT\tLicense, mit-license; MIT LICENSE"), (4, "MIT\tLicense, mit-license; MIT LICENSE"),
    (5, "Permission is hereby granted"), (None, "x Ä Released under the MIT License"), (6, "the general public licenses"),
    (7, "word " * 200_000 + "apache license"), (8, "mit licenseé"), (9, "SPDX-License-Identifier: BSD-3-Clause"),
]


def test_odd_rows_and_extra_columns(spark):
    rows = spark.createDataFrame([(i, t, "kept") for i, t in CASES], "doc_id long, text string, places string")
    out = rows.select("doc_id", "places", scan(F.col("text")).alias("r")).collect()
    assert len(out) == len(CASES) and all(row.places == "kept" for row in out)
    by_text = {(row.doc_id, row.r.n_words): row.r for row in out}
    assert by_text[1, 0].labels == by_text[2, 0].base_labels == "" and by_text[3, 0].score == 0.0
    assert (by_text[4, 6].n_base, by_text[4, 6].first_word, by_text[4, 6].last_word) == (3, 0, 4)
    assert by_text[5, 4].labels == "" and by_text[5, 4].first_word is None
    found = by_text[None, 7]
    assert found.labels == "mit" and [(p.template, p.start, p.end) for p in found.places][0] == ("mit-reference", 4, 34)
    assert by_text[6, 4].n_base == 0 and by_text[7, 200_002].first_word == 200_000 and by_text[8, 2].n_base == 0
    assert by_text[9, 6].labels == "bsd"
    assert rows.limit(0).select(scan(F.col("text")).alias("r")).count() == 0


def test_query_on_the_given_table_equals_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    automaton = Automaton((*licenses.BASE_PHRASES, *licenses.TEMPLATES))
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    rows = catalog.op11_license_scan(spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        expected = judge(texts[row.doc_id], automaton, 3)
        assert row.asDict() == {"doc_id": row.doc_id} | {k: v for k, v in expected.items() if k != "places"}
        words = [w.decode() for w in words_of(texts[row.doc_id])]
        base = [i for i in range(len(words)) if words[i : i + 2] in (["mit", "license"], ["apache", "license"]) or words[i : i + 3] == ["general", "public", "license"]]
        assert row.n_base == len(base) and row.first_word == (base[0] if base else None)
