import random

from feedgate.llm import url_filter as u
from feedgate.llm.catalog import QUERIES, URL_RULES


def brute(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:end], rest[end:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    rules = [(v, h, p or "") for v, h, p in rules]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(((a, b, r, v) for a, b, r, v in fits), default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_random_urls_and_rules(spark):
    draw = random.Random(8)
    label = lambda: draw.choice(["a", "b", "net", "a-b", "a0", "ü", ""])
    host = lambda n: ".".join(label() for _ in range(n))
    path = lambda: "".join(draw.choice(["/", "/x", "/x/y", "z"]) for _ in range(draw.randint(0, 3)))
    rules = {(draw.choice(["block", "allow"]), host(draw.randint(1, 3)), draw.choice(["/", "/x/", "/x", ""])) for _ in range(60)}
    rules = [*sorted(rules), ("block", None, "/"), ("allow", "a", None)]
    urls = [None, "", "no scheme/x", "://", "http://", "http://NET/", "http://a.net?x://b/y", "x://a/x/y://c", "http://a.b.net/x" + "y" * 5000]
    urls += [f"{draw.choice(['http', ''])}://{host(draw.randint(1, 4))}{path()}{draw.choice(['', '?q', '#f', '?a#b'])}" for _ in range(500)]
    rows = [(i, x, "k") for i, x in enumerate(urls)] + [(5, urls[5], "k"), (None, "http://a/", "k")]
    frame = spark.createDataFrame(rows, "page_id long, url string, key string")
    out = u.judge_urls(frame, u.rules_frame(spark, rules))
    got = sorted(map(str, map(tuple, out.collect())))
    assert got == sorted(str((i, *brute(x, rules))) for i, x, _ in rows)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert u.judge_urls(frame.limit(0), u.rules_frame(spark, rules)).count() == 0
    assert {r.verdict for r in u.judge_urls(frame, u.rules_frame(spark, [])).collect()} == {"allow"}


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {tuple(r) for r in QUERIES["op2_url_filters"](spark, folder).collect()}
    assert got == {(p.page_id, *brute(p.url, URL_RULES)) for p in pages}


def test_long_rule_lists_in_blocks(spark, monkeypatch):
    """Blocks and lanes of few rows give what the rules give one by one; boundaries are not sent to every lane."""
    monkeypatch.setattr(u, "BLOCK_MARKS", 16)
    monkeypatch.setattr(u, "LANE_ROWS", 40)
    draw = random.Random(9)
    host = lambda n: ".".join(draw.choice("abcdefgh") for _ in range(n))
    rules = sorted({(draw.choice(["block", "allow"]), host(draw.randint(1, 4)), draw.choice(["", "/", "/x"])) for _ in range(400)})
    urls = [f"http://{host(draw.randint(1, 5))}{draw.choice(['', '/', '/x/y'])}" for _ in range(300)]
    urls += ["http://a.b/x"] * 200 + [None, "", "http://"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = u.judge_urls(frame, u.rules_frame(spark, rules))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str((i, *brute(x, rules))) for i, x in enumerate(urls))
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert u.judge_urls(frame.limit(0), u.rules_frame(spark, rules)).count() == 0
