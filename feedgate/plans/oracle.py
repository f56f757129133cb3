"""The catalogue's queries in SQL, written from the rules and not from the Spark code."""

from __future__ import annotations

# ---------------------------------------------------------------- derived inputs

_PARTS = """
parts AS (
  SELECT p_partkey, p_size, p_brand,
    '{"brand":' || to_json(p_brand)::VARCHAR || ',"cents":' || CAST(round(p_retailprice * 100) AS BIGINT)
      || CASE WHEN p_size % 2 = 0 THEN ',"grade":' || to_json(p_type)::VARCHAR ELSE '' END
      || ',"name":' || to_json(p_name)::VARCHAR || ',"size":' || p_size
      || ',"traits":{"shelf":' || p_size || ',"type":' || to_json(p_type)::VARCHAR || '}}' AS payload
  FROM part),
part_rows AS (
  SELECT 'erp' AS source, 'part.sheet' AS collection, CAST(p_partkey AS VARCHAR) AS id,
    row_number() OVER (ORDER BY p_partkey) AS seq, payload, sha256(payload) AS content_hash,
    CAST(strlen(payload) AS INTEGER) AS payload_bytes, p_brand, p_size
  FROM parts)"""

_EVENTS = """
ops AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS id, event_type,
    'user.activity-' || (event_id // 100) AS batch_id, event_id // 100 AS batch_seq,
    CAST(event_id % 100 AS INTEGER) AS ord,
    CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op,
    CAST(regexp_extract(props, '[0-9]+') AS INTEGER) // 50 AS tier
  FROM events),
docs AS (
  SELECT *, CASE WHEN op = 'upsert'
      THEN '{"tier":' || tier || ',"type":"' || event_type || '"}' END AS payload,
    row_number() OVER (PARTITION BY id ORDER BY event_id) AS turn
  FROM ops),
outcomes AS (
  SELECT now.*, CASE
      WHEN now.op = 'delete' AND before.op = 'upsert' THEN 'tombstoned'
      WHEN now.op = 'delete' THEN 'unchanged'
      WHEN before.op = 'upsert' AND before.payload = now.payload THEN 'unchanged'
      ELSE 'stored' END AS outcome
  FROM docs now LEFT JOIN docs before ON before.id = now.id AND before.turn = now.turn - 1),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY event_id) AS seq FROM outcomes WHERE outcome <> 'unchanged'),
event_rows AS (
  SELECT 'app' AS source, 'user.activity' AS collection, id, seq,
    coalesce(payload, '{}') AS payload, sha256(coalesce(payload, '{}')) AS content_hash,
    CAST(strlen(coalesce(payload, '{}')) AS INTEGER) AS payload_bytes,
    op = 'delete' AS deleted, ts, event_type
  FROM numbered n
  WHERE NOT EXISTS (SELECT 1 FROM numbered later WHERE later.id = n.id AND later.seq > n.seq))"""

_ORDERS = """
orders_in AS (
  SELECT o_orderkey, o_orderpriority, o_orderstatus,
    CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
    row_number() OVER (ORDER BY o_orderkey) AS first_seq, count(*) OVER () AS n
  FROM orders),
order_states AS (
  SELECT o_orderkey, o_orderpriority, first_seq, n,
    '{"cents":' || cents || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS was,
    '{"cents":' || cents || ',"priority":"' || o_orderpriority || '","status":"'
      || CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END || '"}' AS is_now
  FROM orders_in),
order_rows AS (
  SELECT 'erp' AS source, 'sales.order' AS collection, CAST(o_orderkey AS VARCHAR) AS id, first_seq AS seq,
    was AS payload FROM order_states WHERE was = is_now
  UNION ALL
  SELECT 'erp', 'sales.order', CAST(o_orderkey AS VARCHAR), n + row_number() OVER (ORDER BY o_orderkey),
    is_now FROM order_states WHERE was <> is_now)"""

_LINES = """
line_ops AS (
  SELECT l_orderkey || '-' || l_linenumber AS id, l_partkey,
    row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS n,
    '{"flags":{"returned":"' || l_returnflag || '","status":"' || l_linestatus || '"},"part":' || l_partkey || '}' AS payload
  FROM lineitem),
line_turns AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) AS turn FROM line_ops),
line_changes AS (
  SELECT now.id, now.n, now.l_partkey, now.payload, row_number() OVER (ORDER BY now.n) AS seq
  FROM line_turns now LEFT JOIN line_turns before ON before.id = now.id AND before.turn = now.turn - 1
  WHERE before.payload IS DISTINCT FROM now.payload),
line_rows AS (
  SELECT 'erp' AS source, 'sales.line' AS collection, id, max(seq) AS seq,
    arg_max(payload, seq) AS payload, arg_max(l_partkey, seq) AS part
  FROM line_changes GROUP BY id)"""

_DOCUMENTS = """
document_rows AS (
  SELECT source, 'text.' || lang AS collection, CAST(doc_id AS VARCHAR) AS id,
    row_number() OVER (ORDER BY doc_id) AS seq, payload, sha256(payload) AS content_hash,
    CAST(strlen(payload) AS INTEGER) AS payload_bytes, doc_id
  FROM (SELECT *, '{"chars":' || n_chars || ',"text":' || to_json(text)::VARCHAR || '}' AS payload
        FROM documents)
  WHERE strlen(payload) <= 65536)"""

_TEXT_LINES = """
line_texts AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
line_documents AS (
  SELECT doc_id, source, len(lines) AS n_lines,
    '{"lines":[' || array_to_string(list_transform(lines,
      lambda line, pos: '{"n":' || (pos - 1) || ',"text":' || to_json(line)::VARCHAR || '}'), ',') || ']}' AS payload
  FROM line_texts)"""

_ROW = "source, collection, id, seq, payload, content_hash, payload_bytes"
_HASHED = (
    "source, collection, id, seq, payload, sha256(payload) AS content_hash, "
    "CAST(strlen(payload) AS INTEGER) AS payload_bytes"
)
_CHECKSUM = (
    "sha256('[' || string_agg('[\"' || id || '\",\"' || content_hash || '\"]', ',' ORDER BY id) || ']')"
)

_EVENT_LINES = f"""
WITH {_EVENTS}
SELECT batch_id, batch_seq, ord, 'app' AS source, 'user.activity' AS collection, op, id,
  CASE WHEN op = 'upsert' THEN '{{"type":"' || event_type || '","tier":' || tier || ',"user":{{"id":' || id || '}}}}' END AS payload,
  CAST(NULL AS VARCHAR) AS envelope_error
FROM ops"""

_EVENT_STATE = f"WITH {_EVENTS} SELECT {_ROW}, deleted FROM event_rows"

ORACLE: dict[str, str] = {
    "envelope_read": _EVENT_LINES,
    "envelope_stream": _EVENT_LINES,
    "record_snapshot": f"""
WITH {_PARTS}
SELECT {_ROW}, p_brand AS idx_string_brand, CAST(p_size AS DOUBLE) AS idx_number_size FROM part_rows""",
    "identifier_gate": r"""
WITH all_values AS (
  SELECT url AS v FROM pages UNION ALL SELECT p_name FROM part UNION ALL SELECT text FROM documents)
SELECT 'id' AS grammar, sha256(v) AS value_hash, CASE
    WHEN v = '' THEN 'empty' WHEN strlen(v) > 512 THEN 'too_long'
    WHEN regexp_matches(v, '[\p{Cc}/?#]') THEN 'char'
    WHEN regexp_matches(v, '^\s|\s$') THEN 'boundary' END AS ident_error
FROM all_values
UNION ALL
SELECT 'name', sha256(v), CASE
    WHEN v = '' THEN 'empty' WHEN strlen(v) > 128 THEN 'too_long'
    WHEN regexp_matches(v, '[^a-z0-9._-]') THEN 'char'
    WHEN regexp_matches(v, '^[^a-z0-9]|[^a-z0-9]$') THEN 'boundary' END
FROM all_values""",
    "collection_gate": """
SELECT source, 'text.' || lang AS collection, CAST(doc_id AS VARCHAR) AS id,
  CASE WHEN lang NOT IN ('en', 'de') THEN 'unknown_collection' END AS code
FROM documents""",
    "envelope_gate": """
SELECT 'user.activity-' || (event_id // 100) AS batch_id, CAST(event_id % 100 AS INTEGER) AS ord,
  CASE WHEN event_type IN ('error', 'signup') THEN 'delete' ELSE 'upsert' END AS op,
  CASE WHEN event_type <> 'purchase' THEN CAST(user_id AS VARCHAR) END AS record_id,
  CASE event_type WHEN 'signup' THEN 'payload_on_delete' WHEN 'view' THEN 'missing_payload'
    WHEN 'purchase' THEN 'missing_id' END AS code
FROM events""",
    "record_id_extraction": """
SELECT 'user.activity-' || (event_id // 100) AS batch_id, CAST(event_id % 100 AS INTEGER) AS ord,
  CASE event_type WHEN 'click' THEN CAST(user_id AS VARCHAR) WHEN 'view' THEN 'u-' || user_id END AS doc_id
FROM events""",
    "payload_size_gate": """
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(size AS INTEGER) AS payload_bytes,
  CASE WHEN size > 8192 THEN 'payload_too_large' END AS code
FROM (SELECT doc_id, strlen('{"chars":' || n_chars || ',"text":' || to_json(text)::VARCHAR || '}') AS size
      FROM documents)""",
    "source_attribution": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN s_acctbal >= 0 THEN 'supplier-' || s_suppkey END AS source
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey""",
    "atomic_batch_gate": """
WITH sized AS (
  SELECT source, doc_id, strlen('{"chars":' || n_chars || ',"text":' || to_json(text)::VARCHAR || '}') AS size
  FROM documents),
batches AS (
  SELECT source, count(*) AS n, min(doc_id) FILTER (WHERE size > 10000) AS first_bad
  FROM sized GROUP BY source)
SELECT source AS batch_id, CASE WHEN n <= 52 THEN CAST(first_bad AS INTEGER) END AS ord,
  CAST(CASE WHEN n > 52 THEN 400 ELSE 413 END AS INTEGER) AS status,
  CASE WHEN n > 52 THEN 'batch_too_large' ELSE 'payload_too_large' END AS code
FROM batches WHERE n > 52 OR first_bad IS NOT NULL""",
    "digest_gate": """
WITH hashed AS (SELECT doc_id, lang, upper(sha256(text)) AS h FROM documents)
SELECT doc_id,
  CASE lang WHEN 'de' THEN substr(h, 2) WHEN 'fr' THEN 'Z' || substr(h, 2) ELSE lower(h) END AS content_hash,
  CASE lang WHEN 'de' THEN 'length' WHEN 'fr' THEN 'not_hex' END AS digest_error
FROM hashed""",
    "release_projection": f"""
WITH {_PARTS} SELECT id AS doc_id, payload, content_hash, payload_bytes FROM part_rows""",
    "dropped_report": """
WITH reports AS (
  SELECT p_partkey, 'traits.bin' AS path, 'unknown_key' AS reason, NULL AS expected, NULL AS found FROM part
  UNION ALL SELECT p_partkey, 'grade', 'type_mismatch', 'string', 'number' FROM part WHERE p_size % 2 <> 0
  UNION ALL SELECT p_partkey, 'id', 'unknown_key', NULL, NULL FROM part
  UNION ALL SELECT p_partkey, 'internal_code', 'unknown_key', NULL, NULL FROM part)
SELECT 'erp' AS source, 'part.sheet' AS collection, CAST(p_partkey AS VARCHAR) AS doc_id,
  CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY path) - 1 AS INTEGER) AS position,
  path, reason, CAST(expected AS VARCHAR) AS expected, CAST(found AS VARCHAR) AS found
FROM reports""",
    "nested_release": f"""
WITH {_TEXT_LINES}
SELECT CAST(doc_id AS VARCHAR) AS doc_id, payload, sha256(payload) AS content_hash,
  CAST(n_lines + 1 AS INTEGER) AS n_dropped
FROM line_documents""",
    "nested_dropped_report": """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, 0 AS position, 'id' AS path, 'unknown_key' AS reason,
  CAST(NULL AS VARCHAR) AS expected, CAST(NULL AS VARCHAR) AS found
FROM documents
UNION ALL
SELECT CAST(doc_id AS VARCHAR), CAST(pos + 1 AS INTEGER), 'lines[' || pos || '].size', 'unknown_key', NULL, NULL
FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)""",
    "field_coverage": """
SELECT 'part.sheet' AS collection, count(*) AS documents, CAST(0 AS BIGINT) AS complete, count(*) AS incomplete FROM part
UNION ALL SELECT 'sales.order', count(*), 0, count(*) FROM orders""",
    "content_fingerprint": """
SELECT CAST(doc_id AS VARCHAR) AS id, payload, sha256(payload) AS content_hash,
  CAST(strlen(payload) AS INTEGER) AS payload_bytes
FROM (SELECT doc_id, '{"chars":' || n_chars || ',"id":' || doc_id || ',"lang":"' || lang || '","text":'
        || to_json(text)::VARCHAR || '}' AS payload FROM documents)""",
    "exact_numbers": """
WITH numbers AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
  FROM embeddings),
texts AS (
  SELECT *, x::VARCHAR AS t, CASE WHEN x < 0 THEN '-' ELSE '' END AS sign,
    replace(replace(split_part(x::VARCHAR, 'e-', 1), '.', ''), '-', '') AS digits,
    TRY_CAST(split_part(x::VARCHAR, 'e-', 2) AS INTEGER) AS power
  FROM numbers),
canonical AS (
  SELECT vec_id, label, pos, CASE
      WHEN x = 0 THEN '0'
      WHEN power IS NULL THEN regexp_replace(t, '[.]0$', '')
      WHEN power <= 6 THEN sign || '0.' || repeat('0', power - 1) || digits
      WHEN strlen(digits) = 1 THEN sign || digits || 'e-' || power
      ELSE sign || substr(digits, 1, 1) || '.' || substr(digits, 2) || 'e-' || power END AS number
  FROM texts),
payloads AS (
  SELECT vec_id, '{"label":' || any_value(label) || ',"values":[' || string_agg(number, ',' ORDER BY pos) || ']}' AS payload
  FROM canonical GROUP BY vec_id)
SELECT CAST(vec_id AS VARCHAR) AS doc_id, payload, sha256(payload) AS content_hash FROM payloads""",
    "outcome_detection": f"WITH {_EVENTS} SELECT batch_id, ord, id, op, outcome FROM outcomes",
    "stateful_outcomes": f"WITH {_EVENTS} SELECT batch_id, ord, id, op, outcome FROM outcomes",
    "sequence_assignment": f"""
WITH {_EVENTS}
SELECT o.batch_id, o.ord, o.outcome, n.seq + 1000 AS seq
FROM outcomes o LEFT JOIN numbered n USING (event_id)""",
    "idempotent_upsert": f"WITH {_ORDERS} SELECT {_HASHED} FROM order_rows",
    "tombstone_delete": f"WITH {_EVENTS} SELECT {_ROW} FROM event_rows WHERE deleted",
    "apply_batch": _EVENT_STATE,
    "repeated_lines": f"""
WITH {_LINES} SELECT {_HASHED}, CAST(part AS DOUBLE) AS idx_number_part FROM line_rows""",
    "streaming_apply": _EVENT_STATE,
    "integrity_check": r"""
WITH facts AS (
  SELECT 'sales.line' AS c, l_orderkey || '-' || l_linenumber AS id, l_partkey - 1 AS seq, l_linestatus = 'F' AS dead
  FROM lineitem
  UNION ALL SELECT 'page', url, page_id + 10000000, false FROM pages)
SELECT 'content_hash_format' AS rule, count(*) FILTER (WHERE c = 'page') AS violations FROM facts
UNION ALL SELECT 'tombstone_payload', count(*) FILTER (WHERE dead) FROM facts
UNION ALL SELECT 'seq_negative', count(*) FILTER (WHERE seq < 0) FROM facts
UNION ALL SELECT 'id_grammar', count(*) FILTER (WHERE regexp_matches(id, '[\p{Cc}/?#]') OR strlen(id) > 512) FROM facts
UNION ALL SELECT 'source_grammar', count(*) FILTER (WHERE c = 'page') FROM facts
UNION ALL SELECT 'collection_grammar', CAST(0 AS BIGINT)
UNION ALL SELECT 'key_unique', count(*) FROM (SELECT c, id FROM facts GROUP BY c, id HAVING count(*) > 1)
UNION ALL SELECT 'seq_unique', count(*) FROM (SELECT seq FROM facts GROUP BY seq HAVING count(*) > 1)""",
    "stored_lookup": f"""
WITH {_EVENTS}
SELECT {_ROW}, deleted FROM event_rows WHERE id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""",
    "drift_of_some": f"""
WITH {_DOCUMENTS}
SELECT source, collection, id, 'changed' AS drift FROM document_rows
WHERE collection IN ('text.de', 'text.fr') AND doc_id % 10 = 0""",
    "keyed_lookup": f"""
WITH {_EVENTS}
SELECT {_ROW} FROM event_rows WHERE NOT deleted AND id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""",
    "declared_filter": f"""
WITH {_PARTS} SELECT {_ROW} FROM part_rows WHERE p_brand = 'Brand#2' AND p_size = 11""",
    "filtered_listing": f"""
WITH {_EVENTS},
page AS (SELECT * FROM event_rows WHERE NOT deleted AND event_type = 'view' AND seq > 50 ORDER BY seq LIMIT 25)
SELECT {_ROW}, CASE WHEN (SELECT count(*) FROM page) = 25 THEN (SELECT max(seq) FROM page) END AS next_cursor
FROM page""",
    "byte_budget_pages": f"""
WITH {_DOCUMENTS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, collection ORDER BY seq) AS pos,
    sum(payload_bytes) OVER (PARTITION BY source, collection ORDER BY seq) AS spent
  FROM document_rows),
page AS (SELECT * FROM ranked WHERE pos <= 20 AND (pos = 1 OR spent <= 40000)),
ends AS (
  SELECT source, collection, max(seq) AS last_seq, count(*) AS kept FROM page GROUP BY ALL),
totals AS (SELECT source, collection, least(count(*), 20) AS offered FROM document_rows GROUP BY ALL)
SELECT source, collection, id, seq, payload_bytes,
  CASE WHEN offered = 20 OR kept < offered THEN last_seq END AS next_cursor
FROM page JOIN ends USING (source, collection) JOIN totals USING (source, collection)""",
    "page_walk": f"""
WITH RECURSIVE {_DOCUMENTS},
ranked AS MATERIALIZED (
  SELECT source, collection, seq, CAST(payload_bytes AS BIGINT) AS size,
    row_number() OVER (PARTITION BY source, collection ORDER BY seq) AS pos
  FROM document_rows),
steps AS (
  SELECT source, collection, seq, size, pos, CAST(1 AS BIGINT) AS page, CAST(1 AS BIGINT) AS held, size AS spent
  FROM ranked WHERE pos = 1
  UNION ALL
  SELECT r.source, r.collection, r.seq, r.size, r.pos,
    CASE WHEN s.held = 10 OR s.spent + r.size > 30000 THEN s.page + 1 ELSE s.page END,
    CASE WHEN s.held = 10 OR s.spent + r.size > 30000 THEN 1 ELSE s.held + 1 END,
    CASE WHEN s.held = 10 OR s.spent + r.size > 30000 THEN r.size ELSE s.spent + r.size END
  FROM steps s JOIN ranked r ON r.source = s.source AND r.collection = s.collection AND r.pos = s.pos + 1)
SELECT source, collection, page, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes,
  min(seq) AS first_seq, max(seq) AS last_seq,
  CASE WHEN count(*) = 10 OR page < max(page) OVER (PARTITION BY source, collection) THEN max(seq) END AS next_cursor
FROM steps GROUP BY source, collection, page""",
    "change_feed": f"""
WITH {_EVENTS},
page AS (SELECT * FROM event_rows WHERE seq > 100 ORDER BY seq LIMIT 1000)
SELECT {_ROW}, deleted, CASE WHEN (SELECT count(*) FROM page) = 1000 THEN (SELECT max(seq) FROM page) END AS next_cursor
FROM page""",
    "change_feed_stream": _EVENT_STATE,
    "replica_fold": f"WITH {_ORDERS} SELECT {_HASHED} FROM order_rows",
    "max_position": f"""
WITH {_EVENTS}, {_DOCUMENTS}
SELECT source, collection, max(seq) AS max_seq FROM event_rows GROUP BY ALL
UNION ALL SELECT source, collection, max(seq) FROM document_rows GROUP BY ALL""",
    "collection_checksum": f"""
WITH {_DOCUMENTS} SELECT source, collection, {_CHECKSUM} AS checksum FROM document_rows GROUP BY ALL""",
    "chained_checksum": f"""
WITH {_LINES}, hashed AS (SELECT *, sha256(payload) AS content_hash FROM line_rows)
SELECT source, collection, {_CHECKSUM} AS checksum FROM hashed GROUP BY ALL""",
    "manifest": f"""
WITH {_EVENTS}, {_PARTS},
sums AS (
  SELECT source, collection, count(*) AS count, {_CHECKSUM} AS checksum FROM event_rows WHERE NOT deleted GROUP BY ALL)
SELECT sums.*, (SELECT max(seq) FROM event_rows) AS max_seq FROM sums
UNION ALL
SELECT source, collection, count(*), {_CHECKSUM}, max(seq) FROM part_rows GROUP BY ALL""",
    "digest_listing": f"""
WITH {_DOCUMENTS},
page AS (
  SELECT source, collection, id, content_hash, row_number() OVER (PARTITION BY source, collection ORDER BY id) AS pos
  FROM document_rows QUALIFY pos <= 12)
SELECT source, collection, id, content_hash,
  CASE WHEN count(*) OVER (PARTITION BY source, collection) = 12
    THEN max(id) OVER (PARTITION BY source, collection) END AS next_cursor
FROM page""",
    "drift_report": f"""
WITH {_ORDERS}
SELECT 'erp' AS source, 'sales.order' AS collection, CAST(o_orderkey AS VARCHAR) AS id, 'extra' AS drift
FROM order_states WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT 'erp', 'sales.order', o_orderkey || 'x', 'missing' FROM order_states WHERE o_orderpriority = '5-LOW'
UNION ALL SELECT 'erp', 'sales.order', CAST(o_orderkey AS VARCHAR), 'changed' FROM order_states
  WHERE o_orderpriority = '1-URGENT' AND was <> is_now""",
    "freshness_check": f"""
WITH {_DOCUMENTS},
tops AS (SELECT source, collection, max(seq) AS top FROM document_rows GROUP BY ALL)
SELECT source, collection, '"l.' || (top - 1) || '.0.50"' AS held, '"l.' || top || '.0.50"' AS validator
FROM tops WHERE collection NOT IN ('text.en', 'text.de')""",
    "served_changes": f"""
WITH {_EVENTS},
served AS (
  SELECT source, collection, id, seq, deleted, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ingested_at,
    content_hash, payload FROM event_rows)
SELECT *, '{{"id":"' || id || '","seq":' || seq || ',"deleted":' || CASE WHEN deleted THEN 'true' ELSE 'false' END
  || ',"ingested_at":"' || ingested_at || '","content_hash":"' || content_hash || '","payload":' || payload || '}}' AS body
FROM served""",
    "served_pages": f"""
WITH {_DOCUMENTS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY source, collection ORDER BY seq) AS pos FROM document_rows),
tops AS (SELECT source, collection, max(seq) AS top FROM document_rows GROUP BY ALL),
page AS (
  SELECT source, collection, count(*) AS n, max(seq) AS last_seq,
    string_agg('{{"id":"' || id || '","seq":' || seq || ',"ingested_at":"2024-01-01T00:00:00.000000Z","content_hash":"'
      || content_hash || '","payload":' || payload || '}}', ',' ORDER BY seq) AS listed
  FROM ranked WHERE pos <= 5 GROUP BY ALL)
SELECT source, collection, '{{"records":[' || listed || '],"next_cursor":'
  || CASE WHEN n = 5 THEN CAST(last_seq AS VARCHAR) ELSE 'null' END || ',"max_seq":' || top || '}}' AS body
FROM page JOIN tops USING (source, collection)""",
    "dropped_totals": f"""
WITH {_TEXT_LINES},
stops AS (
  SELECT source, min(doc_id) FILTER (WHERE strlen(payload) > 20000) AS stop FROM line_documents GROUP BY source),
counted AS (
  SELECT n_lines FROM line_documents JOIN stops USING (source) WHERE stop IS NULL OR doc_id <= stop)
SELECT 'text.lines' AS collection, 'id' AS field, 'unknown_key' AS reason, count(*) AS total FROM counted
UNION ALL SELECT 'text.lines', 'lines[].size', 'unknown_key', CAST(sum(n_lines) AS BIGINT) FROM counted
UNION ALL SELECT 'part.sheet', 'traits.bin', 'unknown_key', count(*) FROM part
UNION ALL SELECT 'part.sheet', 'id', 'unknown_key', count(*) FROM part
UNION ALL SELECT 'part.sheet', 'internal_code', 'unknown_key', count(*) FROM part
UNION ALL SELECT 'part.sheet', 'grade', 'type_mismatch', count(*) FROM part WHERE p_size % 2 <> 0""",
    "outcome_totals": f"""
WITH {_EVENTS}
SELECT 'user.activity' AS collection, outcome, count(*) AS total FROM outcomes GROUP BY outcome""",
    "committed_totals": f"""
WITH {_EVENTS}
SELECT 'user.activity' AS collection, outcome, count(*) AS total FROM outcomes GROUP BY outcome""",
    "stream_onto_table": _EVENT_STATE,
    "faulty_lines": """
WITH ops AS (
  SELECT 'user.activity-' || (event_id // 100) AS batch, (event_id // 100) % 5 AS kind, event_id % 100 AS place FROM events),
marks AS (
  SELECT batch, kind, count(*) AS n, bool_or(kind = 1 AND place = 7) AS unplaced,
    bool_or(kind = 2 AND place = 7) AND bool_or(kind = 2 AND place = 8) AS twice, count(*) FILTER (kind = 3 AND place = 9) AS unnamed
  FROM ops GROUP BY batch, kind)
SELECT batch AS batch_id, CAST(CASE WHEN twice THEN 7 END AS INTEGER) AS ord, 'invalid_body' AS code, CAST(0 AS BIGINT) AS done
FROM marks WHERE unplaced OR twice
UNION ALL SELECT batch, NULL, NULL, n - unnamed FROM marks WHERE NOT unplaced AND NOT twice AND n > unnamed
UNION ALL SELECT NULL, 9, 'invalid_body', 0 FROM marks HAVING sum(unnamed) > 0""",
    "batch_files": """
WITH files AS (
  SELECT 'part.sheet' AS collection, p_partkey // 500 AS n, count(*) AS stored, bool_or(p_partkey % 500 = 3) AS third
  FROM part GROUP BY n
  UNION ALL SELECT 'sales.order', o_orderkey // 500, count(*), bool_or(o_orderkey % 500 = 3) FROM orders GROUP BY 2),
judged AS (
  SELECT collection || '/' || n AS file, stored, CASE WHEN n % 7 IN (1, 3) OR (n % 7 = 2 AND third) THEN 'invalid_body'
      WHEN n % 7 = 4 THEN 'payload_too_large' END AS code FROM files)
SELECT file, code, CASE WHEN code IS NULL THEN stored ELSE 0 END AS stored FROM judged""",
    "ingest_answers": f"""
WITH {_EVENTS}
SELECT o.batch_id, o.ord, CAST(200 AS INTEGER) AS status,
  '{{"id":"' || o.id || '","op":"' || o.op || '","outcome":"' || o.outcome || '"'
    || CASE WHEN n.seq IS NULL THEN '' ELSE ',"seq":' || n.seq END || ',"dropped":['
    || CASE WHEN o.op = 'upsert' THEN '{{"path":"user","reason":"unknown_key"}}' ELSE '' END || ']}}' AS body
FROM outcomes o LEFT JOIN numbered n USING (event_id)""",
    "change_feed_page": f"""
WITH {_EVENTS},
page AS (SELECT * FROM event_rows WHERE seq > 10 ORDER BY seq LIMIT 10)
SELECT {_ROW}, deleted, CASE WHEN (SELECT count(*) FROM page) = 10 THEN (SELECT max(seq) FROM page) END AS next_cursor
FROM page""",
    "digest_listing_after": f"""
WITH {_DOCUMENTS},
ranked AS (
  SELECT source, collection, id, content_hash, row_number() OVER (PARTITION BY source, collection ORDER BY id) AS pos
  FROM document_rows),
page AS (SELECT * FROM ranked WHERE pos BETWEEN 4 AND 6
  UNION ALL SELECT * FROM ranked WHERE (source, collection) IN
    (SELECT (source, collection) FROM ranked GROUP BY source, collection HAVING count(*) < 3))
SELECT source, collection, '{{"records":[' || string_agg('{{"id":"' || id || '","content_hash":"' || content_hash || '"}}', ',' ORDER BY id)
  || '],"next_cursor":' || CASE WHEN count(*) = 3 THEN '"' || max(id) || '"' ELSE 'null' END || '}}' AS body
FROM page GROUP BY source, collection""",
    "manifest_bodies": f"""
WITH {_EVENTS}, {_PARTS},
sums AS (
  SELECT source, collection, count(*) AS n, {_CHECKSUM} AS checksum, (SELECT max(seq) FROM event_rows) AS top
  FROM event_rows WHERE NOT deleted GROUP BY source, collection
  UNION ALL SELECT source, collection, count(*), {_CHECKSUM}, max(seq) FROM part_rows GROUP BY source, collection)
SELECT source, collection, '{{"count":' || n || ',"checksum":"' || checksum || '","max_seq":' || top || '}}' AS body FROM sums""",
    "complete_documents": """
SELECT 'user.activity' AS collection, count(*) AS documents, count(*) AS complete, CAST(0 AS BIGINT) AS incomplete
FROM events WHERE event_type IN ('click', 'signup', 'purchase')
UNION ALL SELECT 'user.activity', count(*), 0, count(*) FROM events WHERE event_type <> 'error'""",
    "bucket_digest": f"""
WITH {_LINES}, hashed AS (
  SELECT *, sha256(payload) AS content_hash, CAST('0x' || substr(sha256(id), 1, 8) AS BIGINT) % 64 AS bucket FROM line_rows)
SELECT source, collection, bucket, {_CHECKSUM} AS digest FROM hashed GROUP BY source, collection, bucket""",
    "replica_catch_up": f"""
WITH {_ORDERS}
SELECT {_HASHED} FROM order_rows JOIN orders ON id = CAST(o_orderkey AS VARCHAR) WHERE o_orderpriority <> '5-LOW'""",
    "sorted_page": f"""
WITH {_PARTS},
page AS (
  SELECT * FROM part_rows QUALIFY row_number() OVER (ORDER BY p_brand, seq) BETWEEN 31 AND 60)
SELECT {_ROW}, (SELECT max(p_brand) FROM page) AS next_value,
  (SELECT arg_max(seq, (p_brand, seq)) FROM page) AS next_cursor
FROM page""",
    "split_batches": f"""
WITH {_EVENTS.replace("ORDER BY event_id", "ORDER BY (batch_seq % 7 <> 5)::INTEGER, event_id").replace("FROM events)", "FROM events WHERE (event_id // 100) % 7 <> 3)")}
SELECT {_ROW}, deleted, CAST(NULL AS VARCHAR) AS batch_id, CAST(NULL AS VARCHAR) AS code FROM event_rows
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'user.activity-' || (event_id // 100), 'incomplete_batch'
FROM events WHERE (event_id // 100) % 7 = 3 GROUP BY event_id // 100
  HAVING count(*) FILTER ((event_id % 100) % 3 = 2) > 0""",
    "read_as_of": f"""
WITH {_EVENTS}
SELECT {_ROW}, deleted, version FROM event_rows, (VALUES (3), (4)) AS v(version)
UNION ALL
SELECT 'expired', NULL, NULL, NULL, NULL, NULL, NULL, NULL, version FROM (VALUES (1), (2)) AS v(version)""",
    "purge_after_lag": f"""
WITH {_EVENTS}, read_by_all AS (
  SELECT max(seq) AS seq FROM numbered WHERE batch_seq * 4 // ((SELECT max(batch_seq) FROM ops) + 1) < 3)
SELECT {_ROW}, deleted FROM event_rows WHERE NOT deleted OR seq > (SELECT seq FROM read_by_all)""",
    "reprojection_of_many": f"""
WITH {_PARTS}, {_ORDERS}, {_EVENTS}, kept AS (
  SELECT 'erp' AS source, 'sales.order' AS collection, CAST(o.o_orderkey AS VARCHAR) AS id,
    '{{"cents":' || CAST(round(o_totalprice * 100) AS BIGINT) || ',"status":"' || o.o_orderstatus || '"}}' AS payload,
    TRUE AS moved, FALSE AS deleted, NULL AS code
  FROM order_states s JOIN orders o USING (o_orderkey)
  UNION ALL
  SELECT 'erp', 'part.sheet', CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 50 = 0 THEN '{{}}' ELSE
      '{{"brand":' || to_json(p_brand)::VARCHAR || ',"cents":' || CAST(round(p_retailprice * 100) AS BIGINT) || ',"size":' || p_size || '}}' END,
    TRUE, p_partkey % 50 = 0, CASE WHEN p_partkey % 50 = 0 THEN 'invalid_payload' END
  FROM part
  UNION ALL
  SELECT source, collection, id, payload, FALSE, deleted, NULL FROM event_rows)
SELECT source, collection, id, payload, sha256(payload) AS content_hash,
  CAST(strlen(payload) AS INTEGER) AS payload_bytes, moved, deleted, code FROM kept""",
    "reprojection": f"""
WITH {_ORDERS}, kept AS (
  SELECT 'erp' AS source, 'sales.order' AS collection, CAST(o.o_orderkey AS VARCHAR) AS id, n + first_seq AS seq,
    '{{"cents":' || CAST(round(o_totalprice * 100) AS BIGINT) || ',"status":"' || o.o_orderstatus || '"}}' AS payload
  FROM order_states s JOIN orders o USING (o_orderkey))
SELECT {_HASHED} FROM kept""",
    "backfill": f"""
WITH {_PARTS}, graded AS (
  SELECT id, replace(payload, ',"name":', ',"grade":' || p_size || ',"name":') AS payload,
    (SELECT count(*) FROM part) + row_number() OVER (ORDER BY seq) AS seq
  FROM part_rows WHERE p_size % 2 <> 0)
SELECT {_ROW} FROM part_rows WHERE p_size % 2 = 0
UNION ALL
SELECT 'erp', 'part.sheet', id, seq, payload, sha256(payload), CAST(strlen(payload) AS INTEGER) FROM graded""",
    "feed_from_position": f"""
WITH {_EVENTS}, parted AS (
  SELECT *, batch_seq * 4 // ((SELECT max(batch_seq) FROM ops) + 1) AS part FROM numbered)
SELECT 'app' AS source, 'user.activity' AS collection, id, seq, coalesce(payload, '{{}}') AS payload,
  sha256(coalesce(payload, '{{}}')) AS content_hash, CAST(strlen(coalesce(payload, '{{}}')) AS INTEGER) AS payload_bytes,
  op = 'delete' AS deleted
FROM parted WHERE part > 0 QUALIFY seq = max(seq) OVER (PARTITION BY id, part)""",
    "position_bitmaps": """
WITH held AS (SELECT l_partkey * 3 + 1 AS seq, count(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT seq, n AS rows, 'repeated' AS fault FROM held WHERE n > 1
UNION ALL
SELECT i, 0, 'missing' FROM range(1, (SELECT max(seq) + 1 FROM held)) AS r(i) WHERE i NOT IN (SELECT seq FROM held)""",
}
ORACLE["tree_drift"] = ORACLE["drift_report"]
ORACLE["bucketed_checksum"] = f"""
WITH digests AS ({ORACLE["bucket_digest"]})
SELECT source, collection, sha256(string_agg(bucket || ':' || digest, ',' ORDER BY bucket)) AS digest
FROM digests GROUP BY source, collection"""
