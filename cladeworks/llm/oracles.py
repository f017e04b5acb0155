"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

URL_SQL = r"""
WITH parsed AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parsed
), rules(rule, rhost, rpath, action) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'block'), ('example.net/de/8', 'example.net', '/de/8', 'block'),
  ('org/es/', 'org', '/es/', 'block')
), fit AS (
  SELECT page_id, host, path, rule, action,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS nr
  FROM split LEFT JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fit WHERE nr = 1
"""

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(" + LOWERED.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, array_to_string(w[s:s + 9], ' ') AS run, least(10, len(w)) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM i WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win),
runs AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
), hit AS (SELECT doc_id, s, runs.n, item FROM runs JOIN win USING (run)),
places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS class_id,
  CAST((SELECT count(*) FROM links WHERE a = doc_id) AS BIGINT) AS n_links
FROM documents
"""

CHAT_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER w AS i, ceil(strlen(text) / 4.0) + 4 AS n, sum(ceil(strlen(text) / 4.0) + 4) OVER w AS s,
    length(replace(role, chr(92), chr(92) || chr(92))) + len(regexp_extract_all(role, '</?s>|\[/?INST\]'))
    + length(replace(text, chr(92), chr(92) || chr(92))) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) + 20 AS chars
  FROM raw WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
), sys AS (SELECT conv_id, CASE WHEN role = 'system' THEN n ELSE 0 END AS n_system, CASE WHEN role = 'system' THEN chars ELSE 0 END AS chars FROM t WHERE i = 1),
near AS (
  SELECT t.conv_id, t.i, t.s, s - n AS p0, coalesce(lag(s - n, 1) OVER w, 0) AS p1, coalesce(lag(s - n, 2) OVER w, 0) AS p2, n_system
  FROM t JOIN sys USING (conv_id) WINDOW w AS (PARTITION BY t.conv_id ORDER BY t.i)
), opening AS (
  SELECT conv_id, i, s, CASE WHEN s - p2 + CASE WHEN i > 3 THEN n_system ELSE 0 END <= 512 THEN greatest(1, i - 2)
    WHEN s - p1 + CASE WHEN i > 2 THEN n_system ELSE 0 END <= 512 THEN greatest(1, i - 1) ELSE i END AS back, p0, p1, p2, n_system FROM near
), opened AS (
  SELECT conv_id, i, s, back, CASE i - back WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS base, 512 - CASE WHEN back > 1 THEN n_system ELSE 0 END AS room FROM opening
), fold(conv_id, i, base, room, start, back) AS (
  SELECT conv_id, i, base, room, i, back FROM opened WHERE i = 1
  UNION ALL
  SELECT f.conv_id, o.i, CASE WHEN o.s - f.base > f.room THEN o.base ELSE f.base END, CASE WHEN o.s - f.base > f.room THEN o.room ELSE f.room END,
    CASE WHEN o.s - f.base > f.room THEN o.i ELSE f.start END, CASE WHEN o.s - f.base > f.room THEN o.back ELSE f.back END
  FROM fold f JOIN opened o ON o.conv_id = f.conv_id AND o.i = f.i + 1
), wins AS (SELECT conv_id, start, any_value(back) AS back, max(i) AS last FROM fold GROUP BY 1, 2),
sizes AS (
  SELECT w.conv_id, sum(t.chars) + any_value(CASE WHEN back > 1 THEN sys.chars ELSE 0 END) AS chars
  FROM wins w JOIN t ON t.conv_id = w.conv_id AND t.i BETWEEN back AND last JOIN sys ON sys.conv_id = w.conv_id
  GROUP BY w.conv_id, start
), formatted AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM sizes GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
FROM t JOIN formatted USING (conv_id) GROUP BY conv_id
"""

def _matches_sql(rank: int, kind: str, pattern: str, group: int = 0, least: int = 0) -> str:
    """Spans of one pattern: starts follow from the lengths of matches and of what lies between them."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, t, CAST(start AS BIGINT) AS start, {rank} AS rank, '{kind}' AS kind, CAST(start + length(s) AS BIGINT) AS stop, s FROM (
      SELECT doc_id, t, hit[i] AS s, part[i] AS g, list_sum([length(x) FOR x IN gap[1:i]]) + coalesce(list_sum([length(x) FOR x IN hit[1:i - 1]]), 0) AS start
      FROM (SELECT doc_id, t, hit, part, gap, unnest(range(1, len(hit) + 1)) AS i FROM (
        SELECT doc_id, t, regexp_extract_all(t, '{p}') AS hit, regexp_extract_all(t, '{p}', {group}) AS part, string_split_regex(t, '{p}') AS gap FROM d WHERE regexp_matches(t, '{p}'))))
      WHERE length(g) >= {least}"""


# What the scan is meant to do, written out apart from the operator.
_SECRETS = (
    (0, "assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    (1, "access", r"AKIA[A-Z0-9]{14,}", 0, 0),
    (2, "hex", r"[0-9a-f]{16,}", 0, 0),
)
_WINDOWS = ((3, "mixed", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.7), (4, "hex", r"[0-9A-Fa-f]{16,}", 16, 2.9))
_HARMLESS = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9TZ/_+-]*$", r"^[A-Za-z]+([_/=+-][A-Za-z]+)*$",
    r"^[0-9]+$", r"^[_=/+-]+$",
)


def _entropy_sql(rank: int, name: str, pattern: str, window: int, least: float) -> str:
    allowed = " OR ".join(f"regexp_matches(s, '{a}')" for a in _HARMLESS)
    return f"""SELECT doc_id, CAST(start + min(k) AS BIGINT) AS start, {rank} AS rank, 'entropy_{name}' AS kind, CAST(start + max(k) + {window} AS BIGINT) AS stop FROM (
      SELECT doc_id, start, k, -sum(n / {window}.0 * log2(n / {window}.0)) AS bits FROM (
        SELECT doc_id, start, k, c, CAST(count(*) AS DOUBLE) AS n FROM (
          SELECT doc_id, start, k, unnest(string_split(substr(s, k + 1, {window}), '')) AS c FROM (
            SELECT doc_id, start, s, unnest(range(0, length(s) - {window} + 1)) AS k FROM ({_matches_sql(rank, name, pattern)}) WHERE NOT ({allowed})))
        GROUP BY ALL) GROUP BY ALL) WHERE bits >= {least} - 1e-12 GROUP BY doc_id, start"""


_BASE = " UNION ALL ".join(f"SELECT doc_id, start, rank, kind, stop FROM ({_matches_sql(*x)})" for x in _SECRETS)
_SCAN = " UNION ALL ".join(_entropy_sql(*x) for x in _WINDOWS)
_LISTED = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"
SECRET_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), base AS ({_BASE}), every AS (SELECT * FROM base UNION ALL {_SCAN}),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh, {_LISTED} AS spans FROM base GROUP BY 1),
e AS (SELECT doc_id, {_LISTED} AS spans FROM every GROUP BY 1)
SELECT d.doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(e.spans, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN e USING (doc_id)
"""

# SHA-1 in base 32: five hexadecimal digits at a time are four characters
WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS k,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) % 32, 1)), '') AS digest
  FROM p
), r AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY page_id) AS nth, min(page_id) OVER (PARTITION BY k) AS to_id FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN to_id END AS refers_to
FROM r
"""

MINING_SQL = """
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, q) = 1
), v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, q FROM k
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor, other, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5
)
SELECT p.anchor AS anchor_id, p.other AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
  s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
"""


def _codes_sql() -> str:
    rounds = [
        f"""a{n} AS MATERIALIZED (
  SELECT rid, part, min(CAST(list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v) AS BIGINT) * 1000 + entry) AS best
  FROM parts p JOIN b{n} b USING (part) GROUP BY rid, part
), m{n} AS (
  SELECT part, best % 1000 AS entry, i, floor(sum(v[i]) / count(*)) AS x
  FROM (SELECT part, best, v, unnest(range(1, len(v) + 1)) AS i FROM a{n} JOIN parts USING (rid, part)) GROUP BY part, best % 1000, i
), b{n + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(u.v, b.v) AS v FROM b{n} b LEFT JOIN (SELECT part, entry, list(x ORDER BY i) AS v FROM m{n} GROUP BY part, entry) u USING (part, entry)
)"""
        for n in range(5)
    ]
    last = rounds.pop().split("), m4 AS")[0] + ")"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, q, label NULLS LAST) AS rid, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), parts AS MATERIALIZED (
  SELECT rid, vec_id, part, q[part * (len(q) // 4) + 1:(part + 1) * (len(q) // 4)] AS v FROM kept, range(0, 4) r(part)
), b0 AS MATERIALIZED (
  SELECT part, rid - 1 AS entry, v FROM parts WHERE rid <= 256
), {", ".join(rounds)}, {last}, coded AS (
  SELECT rid, string_agg(printf('%02x', best % 1000), '' ORDER BY part) AS code, CAST(sum(best // 1000) AS BIGINT) AS error FROM a4 GROUP BY rid
), digest AS (
  SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS h FROM b4
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN coded USING (rid), digest
"""


SQL = {"op12_hard_negatives": MINING_SQL, "op13_vector_codes": _codes_sql(), "op11_warc": WARC_SQL, "op8_secret_scans": SECRET_SQL, "op6_chat_format": CHAT_SQL, "op2_near_join": NEAR_SQL, "op4_decontaminate": DECONTAMINATE_SQL, "op7_url_filters": URL_SQL}
