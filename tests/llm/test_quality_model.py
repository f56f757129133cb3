import collections
import math
import zlib

import numpy as np
import pyarrow as pa

from feedgate.llm import quality_model as q


def auc(score, y):
    order = np.argsort(np.argsort(score))
    pos = y == 1
    return (order[pos].mean() - (pos.sum() - 1) / 2) / max((~pos).sum(), 1)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = q.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    score, y = np.array(held).T
    assert auc(score, y) > 0.9
    assert ((score >= 0.5) == y).mean() > 0.9


def test_labels_of_held_out_rows_do_not_count(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    one, two = ({r.doc_id: r.score for r in q.score_documents(docs, lab).collect()} for lab in (labels, flipped))
    assert one == two


def test_rows_of_every_kind(spark):
    rows = [(1, "good words here", "k"), (2, "bad### words###", "k"), (2, None, "k"), (None, "", "k"), (3, "x " * 9000, "k"), (3, "x " * 9000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in q.score_documents(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)] + [(None, 1), (1, None)], "doc_id long, quality int")
    out = q.score_documents(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert q.score_documents(docs.limit(0), labels).count() == 0


def index_vector(token):
    drawn = zlib.crc32(token, q.SEED)
    return [((drawn >> 8 * k) % q.DIMENSIONS, 1 - 2 * (drawn >> 8 * k + 7 & 1)) for k in range(q.NONZERO)]


def pieces(token):
    edged = b"\0" + token + b"\0"
    return [edged[i : i + 3] for i in range(len(token))]


def plain_points(texts, frequent):
    """Units, vectors and pooled texts, one token at a time."""
    split = [q.tokens_of(t) for t in texts]
    words = collections.Counter(t for tokens in split for t in tokens)
    parts = collections.Counter(p for tokens in split for t in tokens for p in pieces(t))
    known = {w for w, n in words.items() if n * frequent >= words.total()}
    known_parts = {p for p, n in parts.items() if n * frequent >= parts.total()}

    def units(token):
        return [token] if token in known else [("piece", p if p in known_parts else None) for p in pieces(token)]

    sums, counts = {}, collections.Counter()
    for tokens in split:
        for i, token in enumerate(tokens):
            for unit in units(token):
                counts[unit] += 1
                own = sums.setdefault(unit, [0] * q.DIMENSIONS)
                for j in (i - 1, i + 1):
                    if 0 <= j < len(tokens):
                        for place, sign in index_vector(tokens[j]):
                            own[place] += sign
    vectors = {}
    for unit, own in sums.items():
        length = max(math.sqrt(sum(v * v for v in own)), 1e-9)
        vectors[unit] = [v / length * math.log1p(words.total() / counts[unit]) for v in own]
    points = []
    for tokens in split:
        n = max(len(tokens), 1)
        mean = [sum(sum(vectors[u][i] for u in units(t)) / len(units(t)) for t in tokens) / n for i in range(q.DIMENSIONS)]
        points.append([*mean, math.log1p(len(tokens)), len(set(tokens)) / n, math.sqrt(sum(v * v for v in mean))])
    return points, known, known_parts


ODD = ["a b!! c", "b c 12", None, "", "a", "  ", "😀 über 7-7-7", "same same same " * 50, "y" * 5000, "\0\0a\0"]


def points_of(spark, texts, frequent, parts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(parts)
    units, total = q.find_units(rows, frequent=frequent)
    found = q.pooled(rows, units, q.unit_vectors(rows, units, total)).collect()
    return units, [list(r.x) for r in sorted(found, key=lambda r: r.id)]


def test_vectors_and_pooling_equal_plain_loops(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(15).collect()] + ODD
    for frequent in (1, 300, 1 << 30):
        units, got = points_of(spark, texts, frequent, 3)
        want, words, parts = plain_points(texts, frequent)
        assert units.words == sorted(words)
        assert [int(n).to_bytes(3, "big") for n in units.pieces] == sorted(parts)
        assert len(units.words) <= frequent and len(units.pieces) <= frequent
        assert np.allclose(got, want, atol=3e-5)
        # How rows are spread changes no bit.
        assert got == points_of(spark, texts, frequent, 1)[1]


def test_small_stretches_give_the_same_sums(spark, monkeypatch):
    texts = pa.RecordBatch.from_pydict({"id": pa.array(range(len(ODD))), "text": pa.array(ODD, pa.string())})
    units, _ = points_of(spark, ODD, 20, 1)
    vectors = np.arange(len(units) * q.DIMENSIONS).reshape(len(units), q.DIMENSIONS) * 1000

    def run():
        tally = collections.Counter()
        for part in q._tally(iter([texts])):
            for row in part.to_pylist():
                tally[row["unit"]] += row["count"]
        sums = sorted(tuple(row.values()) for part in q._contexts(iter([texts]), units) for row in part.to_pylist())
        return tally, sums, [row["x"] for part in q._pooled(iter([texts]), units, vectors) for row in part.to_pylist()]

    whole = run()
    monkeypatch.setattr(q, "_AT_ONCE", 3)
    monkeypatch.setattr(q, "_HELD_TOKENS", 2)
    assert run() == whole


def test_network_and_temperature_equal_plain_loops():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(600, 6))
    chance = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] * x[:, 2])))
    y, spare = (draw.random(600) < chance).astype(float), draw.random(600) < 0.25
    net = q.fit(x, y, spare)

    def logit(row):
        hidden = []
        for j in range(len(net.b1)):
            z = net.b1[j] + sum((row[i] - net.mean[i]) / net.scale[i] * net.w1[i][j] for i in range(len(row)))
            hidden.append(math.tanh(z))
        return net.b2 + sum(h * w for h, w in zip(hidden, net.w2))

    logits = [logit(row) for row in x]
    assert np.allclose(net.score(x), [1 / (1 + math.exp(-z / net.temperature)) for z in logits])

    def loss(t):
        return sum(math.log1p(math.exp(-(z if w else -z) / t)) for z, w, s in zip(logits, y, spare) if s)

    # No temperature of a finer grid is better by more than what a step of the fit's grid can cost.
    best = min(loss(math.exp(v)) for v in np.linspace(math.log(0.25), math.log(8), 400))
    assert loss(net.temperature) <= best + 0.05 * spare.sum() / 100
    # It learns: better than always the share, on rows the weights have not seen.
    share = y[~spare].mean()
    assert loss(net.temperature) < -sum(math.log(share if w else 1 - share) for w, s in zip(y, spare) if s) * 0.9
