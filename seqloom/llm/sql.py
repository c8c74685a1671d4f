"""DuckDB SQL twins of the queries that SQL can express."""

from __future__ import annotations

TWINS: dict[str, str] = {}

def _best_shard(shards: int) -> str:
    """The number of the highest of the scores 1 / -ln(u), as all weights are equal."""
    scores = ", ".join(f"1.0::DOUBLE / -ln((('0x' || substr(md5(k || ':{s}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)" for s in range(shards))
    return f"list_position([{scores}], list_max([{scores}]))::INT - 1"


#: CRC-32 byte by byte: the table from its rule, then one fold over the text's bytes.
_CRC = """
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, chr(0) || 'null') AS k, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT doc_id, k, octet_length(b) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(b)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM d, crc
)"""

TWINS["op1_rendezvous_sharding"] = _CRC + f""", n AS (
  SELECT doc_id, size::BIGINT AS size, text_crc32, {_best_shard(24)} AS shard, {_best_shard(25)} AS grown_shard,
    ('0x' || substr(md5(concat_ws(',', doc_id, size, text_crc32)), 1, 8))::BIGINT % 64 AS slice FROM s
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY slice, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM n
"""

TWINS["op4_nra_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

TWINS["op3_url_rules"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS w FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(w, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(w, length(regexp_extract(w, '^[^/]*')) + 1) AS path FROM u
), rules(rule, rhost, rpath, rverdict, specific) AS (VALUES
  ('org/', 'org', '/', 'allow', true), ('example.org/es/', 'example.org', '/es/', 'block', true), ('example.org/en/1', 'example.org', '/en/1', 'block', true),
  ('com/fr/', 'com', '/fr/', 'allow', true), ('com/de/', 'com', '/de/', 'block', true)
), pats(pat, rx) AS (VALUES
  ('/*/login/', '^/.*/login/'), ('/*/signin/', '^/.*/signin/'), ('/*/cart/', '^/.*/cart/'), ('/*/checkout/', '^/.*/checkout/'),
  ('/*/wp-admin/', '^/.*/wp-admin/'), ('/cgi-bin/', '^/cgi-bin/'), ('/*/feed/rss/', '^/.*/feed/rss/'), ('/*/ads/banner/', '^/.*/ads/banner/')
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rverdict, length(rule)) AS rv FROM p JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
), pat AS (
  SELECT page_id, arg_max(pat, length(pat)::VARCHAR || pat) AS pat FROM p JOIN pats ON regexp_matches(path, rx, 's') GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.rv, CASE WHEN pat.pat IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN best.rule IS NULL THEN pat.pat END AS pattern
FROM p LEFT JOIN best USING (page_id) LEFT JOIN pat USING (page_id)
"""


def _span_sql() -> str:
    from . import secrets

    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    patterns = [(0, "assign", secrets.ASSIGN, 2), (1, "access", secrets.ACCESS, 0), (2, "hex", secrets.HEX, 0), (3, "mixed", secrets.MIXED, 0)]
    return " UNION ALL ".join(
        f"SELECT rid, {order} AS o, '{kind}' AS kind, string_split_regex(t, {quoted(p)}) AS ps, regexp_extract_all(t, {quoted(p)}, 0) AS ms, regexp_extract_all(t, {quoted(p)}, {g}) AS vs FROM d"
        for order, kind, p, g in patterns
    )


TWINS["op5_secret_ownership"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo FROM documents),
raw AS ({_span_sql()}),
pos AS (
  SELECT rid, o, kind, ms[i] AS m, vs[i] AS v,
    coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM raw)
), hit AS (
  SELECT rid, o, kind, s::BIGINT AS s, (s + length(m))::BIGINT AS e, v FROM pos
  WHERE CASE kind WHEN 'assign' THEN length(v) >= 6 WHEN 'mixed' THEN regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]') ELSE true END
), own AS (
  SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repositories FROM hit JOIN d USING (rid) GROUP BY v
), kept AS (SELECT hit.*, owners, repositories FROM hit JOIN own USING (v) WHERE kind <> 'mixed' OR owners = 1),
agg AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, o) FILTER (kind <> 'mixed') AS base, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, o) AS spans,
    count(*) FILTER (owners = 1) AS n_live, count(*) FILTER (owners = 2) AS n_shared, count(*) FILTER (owners >= 3) AS n_copied, max(repositories) AS most_repositories
  FROM kept GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared, coalesce(n_copied, 0) AS n_copied, coalesce(most_repositories, 0) AS most_repositories
FROM d LEFT JOIN agg USING (rid)
"""

TWINS["op7_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x,
    length(replace(replace(replace(coalesce(text, ''), '\', '\\'), '###', '\h\h\h'), '</turn>', '\l/turn>')) AS xl,
    length(replace(replace(replace(replace(coalesce(role, ''), '\', '\\'), '###', '\h\h\h'), '</turn>', '\l/turn>'), ':', '\c')) AS rl, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n
  FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(r, chr(10), x, chr(10)), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(x, '' ORDER BY n) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(rl + xl + 14)::BIGINT AS formatted_chars, false AS rewrites
FROM t GROUP BY conv_id
"""
