"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import re

from feedgate.llm.chat_format import CONTROL
from feedgate.llm.licenses import BASE_PHRASES, TEMPLATES

_OP2 = """
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), best AS (
  SELECT n, arg_max(struct_pack(rule := rhost || rpath, verdict := r.verdict), length(rhost || rpath)) AS b
  FROM parts JOIN rules r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY n
)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (n)
"""

_OP1 = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS payload_digest
  FROM pages
), marked AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM rows
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM marked
"""

_OP5 = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM b, unnest(range(1, greatest(2, len(w) - 11))) AS r(i) WHERE len(w) > 0
), places AS (
  SELECT n, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT size FROM windows) AS s, unnest(range(1, len(w) - size + 2)) AS r(i)
), found AS (
  SELECT n, i, size, item FROM places JOIN windows USING (size, gram)
), words AS (
  SELECT n, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT n, i, size FROM found), unnest(range(size)) AS r(k) GROUP BY n
), items AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT n, item FROM found) GROUP BY n
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (n) LEFT JOIN items USING (n)
"""

_OP6 = r"""
WITH t AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), lines AS (
  SELECT n, count(*) - count(DISTINCT line) AS dup, count(*) AS all_lines
  FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n
), windows AS (
  SELECT n, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT n, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
), twice AS (
  SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, a, b, c) AS times FROM windows) WHERE times > 1
), repeated AS (
  SELECT n, count(DISTINCT i + k) AS hit FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY n
), counts AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
         coalesce(hit, 0) AS n_repeat_words, coalesce(all_lines, 0) AS all_lines,
         len(list_filter(w, lambda x: length(x) > 1 AND regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) AS capitals
  FROM t LEFT JOIN lines USING (n) LEFT JOIN repeated USING (n)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * capitals > 3 * n_words
            OR 10 * n_dup_lines > 6 * all_lines OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept
FROM counts
"""

_OP8 = """
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, ESCAPED AS safe FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + length(role) + 10 + length(safe) + 10)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


_OP11 = r"""
WITH t AS (
  SELECT row_number() OVER () AS n, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (
  SELECT n, doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS mit,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS apache,
         list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl
  FROM t
), patterns(label, confidence, pattern) AS (
  VALUES PATTERNS
), found AS (
  SELECT n, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(confidence) AS score
  FROM places JOIN patterns ON regexp_matches(joined, pattern) GROUP BY n
)
SELECT doc_id, len(w) AS n_words, len(mit) + len(apache) + len(gpl) AS n_base,
       list_min(mit || apache || gpl) AS first_word, list_max(mit || apache || gpl) AS last_word,
       array_to_string(list_filter(['apache', 'gpl', 'mit'], lambda x: (x = 'apache' AND len(apache) > 0)
                       OR (x = 'gpl' AND len(gpl) > 0) OR (x = 'mit' AND len(mit) > 0)), ',') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM places LEFT JOIN found USING (n)
"""


def _pattern(template: str) -> str:
    """The wording as a regular expression over words that each end in a space."""
    pattern = " "
    for piece in re.split(r"(<<[^<>]*>>)", template):
        if piece == "<<beginOptional>>":
            pattern += "(?:"
        elif piece == "<<endOptional>>":
            pattern += ")?"
        elif piece.startswith("<<"):
            pattern += "(?:[^ ]+ ){%s}" % re.search(r'words="(.*?)"', piece)[1].replace("-", ",")
        else:
            pattern += "".join(f"{word} " for word in re.findall("[a-z0-9]+", piece.lower()))
    return pattern


def _license_patterns() -> str:
    rows = ((t.label, t.confidence, _pattern(t.text)) for t in (*BASE_PHRASES, *TEMPLATES))
    return ", ".join(f"('{label}', {confidence}, '{pattern}')" for label, confidence, pattern in rows)


def _merkle() -> str:
    """Levels spelled out: 16 ** 6 leaves of a source, 16 ** 4 sources; a tree that is done passes its node on."""

    def framed(column: str) -> str:
        return f"coalesce(strlen({column}) || ':' || {column}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(framed, ("id", "source", "lang", "chars", text))) + ")"

    def level(name: str, below: str, done: int) -> str:
        joined = "string_agg(digest, '' ORDER BY p)"
        return (
            f"{name} AS (SELECT s, size, p // 16 AS p, CASE WHEN size > {done} THEN {joined} ELSE '' END AS run, "
            f"CASE WHEN size > {done} THEN sha256({joined}) ELSE max(digest) END AS digest FROM {below} GROUP BY s, size, p // 16)"
        )

    def step(name: str, before: str, runs: str, tree: str, place: str, power: int) -> str:
        left = f"substr(run, 1, (({place} // {power}) % 16) * 64)"
        right = f"substr(run, (({place} // {power}) % 16 + 1) * 64 + 1)"
        return (
            f"{name} AS (SELECT b.* EXCLUDE (proof, folded), proof || {left} || {right} AS proof, "
            f"CASE WHEN run = '' THEN folded ELSE sha256({left} || folded || {right}) END AS folded "
            f"FROM {before} b JOIN {runs} r ON r.s = {tree} AND r.p = {place} // {power * 16})"
        )

    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(id, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: {bits}), 4294967295)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        "d AS (SELECT *, doc_id::VARCHAR AS id, n_chars::VARCHAR AS chars FROM documents)",
        f"h AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, {leaf('text')} AS leaf, "
        f"CASE WHEN {crc} % 5 = 0 THEN {leaf(lowered)} END AS changed FROM d)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY s) AS size FROM h)",
        "s0 AS (SELECT s, p, size, leaf AS digest FROM l)",
        *(level(f"s{k}", f"s{k - 1}", 16 ** (k - 1)) for k in range(1, 7)),
        "t0 AS (SELECT 0 AS s, s AS p, count(*) OVER () AS size, digest FROM s6)",
        *(level(f"t{k}", f"t{k - 1}", 16 ** (k - 1)) for k in range(1, 5)),
        "f0 AS (SELECT *, '' AS proof, coalesce(changed, leaf) AS folded FROM l)",
        *(step(f"f{k}", f"f{k - 1}", f"s{k}", "b.s", "b.p", 16 ** (k - 1)) for k in range(1, 7)),
        "g0 AS (SELECT * FROM f6)",
        *(step(f"g{k}", f"g{k - 1}", f"t{k}", "0", "b.s", 16 ** (k - 1)) for k in range(1, 5)),
    ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, s6.digest AS subroot, t4.digest AS root, sha256(proof) AS proof_sha256, "
        "folded AS folded_root, folded = t4.digest AS verified FROM g4 JOIN s6 USING (s) CROSS JOIN t4"
    )


def _vector_codes() -> str:
    """Six rounds spelled out, distances over the components themselves."""
    distance = "list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        "kept AS (SELECT row_number() OVER () AS n, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v "
        "FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "cut AS MATERIALIZED (SELECT n, vec_id, label, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS x FROM kept, range(8) AS r(p))",
        "c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM cut "
        "QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 16)",
    ]
    for r in range(1, 8):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT n, p, any_value(v.x) AS x, arg_min(e, d * 16 + e) AS e, min(d) AS d FROM "
            f"(SELECT v.n, v.p, v.x, c.e, {distance} AS d FROM cut v JOIN c{r - 1} c USING (p)) AS v GROUP BY n, p)"
        )
        if r < 7:
            parts += [
                f"m{r} AS (SELECT p, e, list((s - ((s % k) + k) % k) // k ORDER BY i) AS x FROM (SELECT p, e, i, sum(x[i])::BIGINT AS s, "
                f"count(*) AS k FROM a{r}, unnest(range(1, len(x) + 1)) AS g(i) GROUP BY p, e, i) GROUP BY p, e)",
                f"c{r} AS MATERIALIZED (SELECT p, e, coalesce(m.x, c.x) AS x FROM c{r - 1} c LEFT JOIN m{r} m USING (p, e))",
            ]
    parts += [
        "coded AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a7 GROUP BY n)",
        "book AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c6)",
    ]
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, "
        "codebooks_sha256 FROM kept JOIN coded USING (n) CROSS JOIN book"
    )


def _escaped(column: str) -> str:
    sql = f"replace({column}, '\\', '\\\\')"
    for control in CONTROL:
        sql = f"replace({sql}, '{control}', '{control[0]}\\{control[1:]}')"
    return sql


_OP9 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS d, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), windows AS (
  SELECT d, doc_id, unnest(range(0, len(w) - 50)) AS i,
    unnest(list_transform(range(0, len(w) - 50), lambda i: array_to_string(w[i + 1 : i + 51], ' '))) AS words
  FROM texts WHERE len(w) > 50
), shared AS (
  SELECT words FROM windows GROUP BY words HAVING min(d) < max(d)
), begun AS (
  SELECT d, doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY d ORDER BY i) >= 51, true) AS begins
  FROM windows SEMI JOIN shared USING (words)
), runs AS (
  SELECT d, doc_id, i, count(*) FILTER (begins) OVER (PARTITION BY d ORDER BY i) AS run FROM begun
), passages AS (
  SELECT d, doc_id, min(i) AS first, max(i) + 51 - min(i) AS n FROM runs GROUP BY d, doc_id, run
)
SELECT doc_id, count(*) AS n_passages, CAST(sum(n) AS BIGINT) AS repeated_words,
  string_agg(first || ':' || n, ',' ORDER BY first) AS passages
FROM passages GROUP BY d, doc_id
"""

ORACLE: dict[str, str] = {
    "op1_warc": _OP1,
    "op2_url_filters": _OP2,
    "op5_benchmark_decontamination": _OP5,
    "op6_quality_rules": _OP6,
    "op8_chat_format": _OP8.replace("ESCAPED", _escaped("text")),
    "op9_substring_dedup": _OP9,
    "op12_merkle_manifest": _merkle(),
    "op13_vector_codes": _vector_codes(),
    "op11_license_scan": _OP11.replace("PATTERNS", _license_patterns()),
}
