import re
from collections import defaultdict

import corpus_pipeline as pipeline
import pytest
from test_contamination import brute as brute_hits
from test_mixing import brute_mix
from test_pii import brute as brute_pii
from test_simhash import brute_components, brute_fingerprint

from feedgate.llm import pii
from feedgate.llm import quality_rules as q

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    out = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = pipeline.save(stage(spark, before, FOLDER), "test-stage")
        was, now = ({r.doc_id: r for r in f.collect()} for f in (before, docs))
        if name != "source_mixing":
            assert docs.columns == before.columns
        out[name] = (was, now)
    was, now = out["quality_rules"]
    assert now == {i: r for i, r in was.items() if q.survives(r.text, [*q.BASE_RULES, *q.METHOD_RULES])}
    was, now = out["simhash_near_dedup"]
    groups = brute_components([(i, brute_fingerprint(r.text)) for i, r in was.items()])
    assert now == {i: was[i] for i in set(groups)}
    was, now = out["benchmark_decontamination"]
    assert now == {i: r for i, r in was.items() if not brute_hits(r.text, items)[4]}
    was, now = out["pii"]
    assert now.keys() == was.keys()
    for i, r in was.items():
        if brute_pii(r.text):
            assert not brute_pii(now[i].text) and now[i].n_chars == len(now[i].text)
        elif not re.search("[0-9@]", r.text):
            assert now[i] == r
    was, now = out["source_mixing"]
    sizes = {i: (r.source, len(r.text.split())) for i, r in was.items()}
    want = brute_mix([(i, s, n) for i, (s, n) in sizes.items()])
    assert {i: (r.size, r.source_size, r.target, r.taken, r.text) for i, r in now.items()} == {
        i: (*want[i], was[i].text) for i in want if want[i][3] > 0
    }


def test_run_gives_the_last_stage(spark):
    rows = pipeline.run(spark, FOLDER)
    again = pipeline.run(spark, FOLDER)
    assert rows.columns == again.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, again.collect())) and rows.count() > 50


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    text = " ".join(f"word{i} here{i * 7}" for i in range(60))
    other = " ".join(f"thing{i} there{i * 3}" for i in range(60)) + " x@y.zz"
    rows = [(1, text, "en", "a", 3, "k"), (1, text, "en", "a", 3, "k"), (None, text, None, None, None, None), (7, other, "en", None, 1, "v")]
    rows += [(None, other + " tail", "en", "b", 1, "v"), (8, None, None, "b", None, None), (9, "", "de", "b", 0, "k")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    frame = spark.createDataFrame(rows, kind)
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert 1 <= len(out) <= 3 and {r.component_id for r in out} <= {"k", "v", None}
    assert not any("x@y.zz" in r.text for r in out)
    kept = pipeline.without_near_duplicates(spark, frame, str(tmp_path))
    by_text = defaultdict(list)
    for r in kept.collect():
        by_text[brute_fingerprint(r.text)].append(r.doc_id)
    assert by_text[brute_fingerprint(text)] == [1]
    for _, stage in pipeline.STAGES:
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("kinds", [pii.ADDED])
def test_added_kinds_are_not_base_kinds(kinds):
    assert not set(kinds) & set(pii.BASE)
