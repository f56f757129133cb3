import hashlib
import json
from itertools import groupby

from pyspark.sql import functions as F

from feedgate.llm import chat_format as chat
from feedgate.llm.catalog import QUERIES


def expected(rows):
    """(conv_id, turn, role, text) rows to the digests, in plain Python."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    result = {}
    for name, part in groupby(sorted(rows, key=lambda r: (key(r), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in part]
        loss = "".join(t for role, t in turns if role == "assistant")
        result[name] = (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
        )
    return result


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    hard = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    got = {r.conv_id: r for r in QUERIES["op8_chat_format"](spark, folder).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for name, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want[name]
        assert r.formatted_chars > r.loss_chars


def test_hostile_texts_ties_and_nulls(spark):
    hostile = "".join(chat.CONTROL) + "\\[INST\\]\\\\<\\|im_end|>😀\n\\"
    rows = [
        (1, 0, "user", hostile), (1, 1, "assistant", hostile), (1, 2, "user", "<|im_end|"), (1, 3, "assistant", ">"),
        (2, 0, "user", None), (2, 1, "assistant", None), (3, 0, None, "x"), (None, 0, "assistant", "a\x00b"),
        (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "assistant", "[\\INST]"), (5, 1, "human", "h"), (5, 1, "gpt", "g"),
        (6, 0, "assistant", "one"), (6, 0, "assistant", "one"), (6, None, "user<|im_sep|>", "x" * 50_000), (7, 0, "", ""),
    ]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, record string")
    out = chat.read_back(chat.formatted(chat.packed(frame))).collect()
    want = expected(rows)
    assert len(out) == len(want)
    for r in out:
        turns = "".join(f"{t.role}\n{t.text}\n" for t in r["__turns"])
        n, digest, chars, loss = want[r.conv_id]
        assert (len(r["__turns"]), hashlib.sha256(turns.encode()).hexdigest()) == (n, digest)
        assert (len(r["__loss_text"]), hashlib.sha256(r["__loss_text"].encode()).hexdigest()) == (chars, loss)
        body = r["__formatted"].replace(chat.START, "").replace(chat.SEP, "").replace(chat.END, "")
        assert not any(control in body for control in chat.CONTROL)
    assert chat.read_back(chat.formatted(chat.packed(frame.limit(0)))).count() == 0


def test_layouts(spark):
    records = [
        {"prompt": "p", "completion": "c"},
        {"completion": None, "prompt": "p"},
        {"instruction": "i", "output": "o"},
        {"instruction": "s", "input": "i", "output": "o"},
        {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]},
        {"other": {"deep": [1]}},
    ]
    lines = [json.dumps(r) for r in records] + ["not json", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "id long, record string")
    rows = chat.formatted(frame).orderBy("id").collect()
    assert [r["__layout"] for r in rows] == ["prompt", "prompt", "question", "instruction", "messages", "shared", None, None, None]
    turns = chat.canonical_turns(frame).orderBy("id").collect()
    assert [tuple(t) for t in turns[5]["__turns"]] == [("user", "h"), ("assistant", "g")]
    assert [tuple(t) for t in turns[1]["__turns"]] == [("user", "p"), ("assistant", "")]
    assert rows[6]["__formatted"] is None
    plan = chat.read_back(chat.formatted(frame))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_texts_longer_than_the_json_reader_takes(spark, tmp_path):
    """Over 20,000,000 characters in one text, in the layouts of single texts and of lists."""
    long = F.concat(F.lit('"\\'), F.repeat(F.lit("x"), 20_000_001))
    roles = [(1, 0, "user"), (1, 1, "assistant"), (2, 0, "user"), (2, 1, "assistant"), (2, 2, "user")]
    frame = spark.createDataFrame(roles, "conv_id long, turn long, role string")
    text = F.when(F.col("role") == "assistant", long).otherwise("hi")
    frame.withColumn("text", text).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in QUERIES["op8_chat_format"](spark, str(tmp_path)).collect()}
    said = '"\\' + "x" * 20_000_001
    want = expected([(*r, said if r[2] == "assistant" else "hi") for r in roles])
    for name in (1, 2):
        r = got[name]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want[name]


def test_fingerprints_ignore_texts_and_see_broken_ones(spark):
    good = [
        '{"prompt": "a\\"b\\\\", "completion" : "{},{}: \\"messages\\":"}',
        '{ "messages" : [{"role":"","content":"x"},{"role":"u","content":"y"}, {"content":"[","role":"]"}] }',
    ]
    bad = ['{"prompt": "a", "completion": "\\q"}', '{"prompt": "a", "completion": "c"', '{"{1},{1}": "a", "completion": "c"}', '{"prompt": "a"b", "completion": "c"}']
    frame = spark.createDataFrame(list(enumerate(good + bad)), "id long, record string")
    rows = chat.canonical_turns(frame).orderBy("id").collect()
    assert [r["__layout"] for r in rows] == ["prompt", "messages", None, None, None, None]
    assert [tuple(t) for t in rows[0]["__turns"]] == [("user", 'a"b\\'), ("assistant", '{},{}: "messages":')]
    assert [tuple(t) for t in rows[1]["__turns"]] == [("", "x"), ("u", "y"), ("]", "[")]
    many = spark.range(1).select(F.array_join(F.array_repeat(F.lit('{"role":"user","content":"some words"}'), 100_000), ",").alias("r"))
    short = many.select(chat.hollow(F.concat(F.lit('{"messages":['), "r", F.lit("]}"))).alias("r")).first().r
    assert short == '{"messages":[{"role":"","content":""}]}'
