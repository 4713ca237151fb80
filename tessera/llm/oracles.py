"""DuckDB SQL for the registered queries that SQL can express."""

OP1_SUBSTRING_DEDUP = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
         len(string_split(text, chr(10))) AS n
  FROM documents
), lines AS (
  SELECT *, translate(trim(regexp_replace(line, '[ \t\r]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS clean
  FROM cut
), ranked AS (
  SELECT *, length(clean) >= 20 AND row_number() OVER (PARTITION BY clean ORDER BY doc_id, pos) > 1 AS line_gone FROM lines
), pieces AS (
  SELECT doc_id, pos, line_gone, unnest(regexp_extract_all(line, '.*?[.!?][ \t\r]+|.+')) AS piece,
         generate_subscripts(regexp_extract_all(line, '.*?[.!?][ \t\r]+|.+'), 1) AS k
  FROM ranked
), sentences AS (
  SELECT *, translate(trim(regexp_replace(piece, '[ \t\r]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS clean
  FROM pieces
), units AS (
  SELECT doc_id, pos, k, piece,
         line_gone OR (length(clean) >= 20 AND row_number() OVER (PARTITION BY clean ORDER BY doc_id, pos, k) > 1) AS gone
  FROM sentences
  UNION ALL SELECT doc_id, pos, 1000000000, chr(10), line_gone FROM ranked WHERE pos < n
), placed AS (
  SELECT *, sum(length(piece)) OVER w AS upto, gone AND NOT coalesce(lag(gone) OVER w, false) AS opens
  FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY pos, k ROWS UNBOUNDED PRECEDING)
), numbered AS (
  SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos, k ROWS UNBOUNDED PRECEDING) AS run FROM placed
), runs AS (
  SELECT doc_id, run, CAST(min(upto - length(piece)) AS BIGINT) AS low, CAST(max(upto) AS BIGINT) AS high FROM numbered WHERE gone GROUP BY doc_id, run
  HAVING sum(len(regexp_extract_all(piece, '[^\x20\x09-\x0D]+'))) >= 15
), spans AS (
  SELECT doc_id, count(*) AS n_removed, CAST(sum(high - low) AS BIGINT) AS n_removed_chars,
         string_agg(CAST(low AS VARCHAR) || ':' || CAST(high AS VARCHAR), ',' ORDER BY low) AS spans
  FROM runs GROUP BY doc_id
), kept AS (
  SELECT n.doc_id, string_agg(piece, '' ORDER BY pos, k) FILTER (NOT gone OR r.run IS NULL) AS text
  FROM numbered n LEFT JOIN runs r ON n.doc_id = r.doc_id AND n.run = r.run GROUP BY n.doc_id
)
SELECT d.doc_id, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.n_removed_chars, 0) AS n_removed_chars,
       coalesce(s.spans, '') AS spans, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

OP3_SOURCE_MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST(1 + (rank - 1) % 3 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM per
), shared AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / (sum(weight) OVER ()
      - coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS share
  FROM weighted
), goal AS (
  SELECT source, rank, source_size,
         least(cap, max(CASE WHEN share <= cap / weight THEN share END) OVER () * weight) AS target
  FROM shared
), queued AS (
  SELECT s.doc_id, s.size, s.key, g.rank, g.source_size, g.target,
         sum(s.size) OVER (PARTITION BY g.rank ORDER BY s.key, s.doc_id ROWS UNBOUNDED PRECEDING) AS reached
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), copies AS (
  SELECT *, CAST(epoch * source_size + reached AS DOUBLE) / target AS finish
  FROM queued, (VALUES (0), (1), (2)) AS e(epoch) WHERE size > 0 AND target > 0
), ordered AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, rank, key, doc_id, epoch ROWS UNBOUNDED PRECEDING) AS run
  FROM copies
), took AS (
  SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM ordered
  WHERE run <= (SELECT sum(size) FROM sized) GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) AS taken
FROM queued q LEFT JOIN took t ON q.doc_id = t.doc_id
"""

OP7_CHAT_FORMATTING = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</', '<\/'), '##', '#\#') AS escaped,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM role AS opens
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(escaped) + 7 + CASE WHEN opens THEN 5 + length(role) + 7 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP9_TOPK_SEARCH = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP8_JACCARD_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) + any_value(b.n) AS total
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (total - shared)
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON s.doc_id = r.a
"""

_CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
_ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"(?i)(example|sample|placeholder|dummy|changeme|redacted|x{6,})",
    r"(?i)(abcdefgh|01234567|12345678)",
    r"^([A-Za-z]{2,}[-_/+])+[A-Za-z0-9]*$",
)
_FOUND = """
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(t, '{pattern}') AS hits,
         regexp_extract_all(t, '{pattern}', {group}) AS parts, string_split_regex(t, '{pattern}') AS gaps, {least} AS least
  FROM texts WHERE regexp_matches(t, '{pattern}')
"""
_KINDS = (
    ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("entropy", _CANDIDATE, 0, 20),
)

OP2_SECRET_SCANS = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), found AS ({"UNION ALL".join(_FOUND.format(kind=k, rank=i, pattern=p, group=g, least=n) for i, (k, p, g, n) in enumerate(_KINDS))}
), numbered AS (
  SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found
), placed AS (
  SELECT doc_id, kind, rank, hits[i] AS hit, length(parts[i]) >= least AS long,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS low
  FROM numbered
), spans AS (
  SELECT doc_id, kind, rank, hit, CAST(low AS BIGINT) AS low, CAST(low + length(hit) AS BIGINT) AS high FROM placed WHERE long
), base AS (
  SELECT * FROM spans WHERE kind <> 'entropy'
), judged AS (
  SELECT *, list_max(list_transform(range(1, length(hit) - 18), lambda i: list_aggregate(string_split(hit[i : i + 19], ''), 'entropy'))) AS bits,
         regexp_matches(hit, '[0-9]') AS digits, regexp_matches(hit, '[A-Z]') AS upper, regexp_matches(hit, '[a-z]') AS lower
  FROM spans WHERE kind = 'entropy' AND {" AND ".join(f"NOT regexp_matches(hit, '{p}')" for p in _ALLOWED)}
), secret AS (
  SELECT doc_id, kind, rank, hit, low, high FROM judged j
  WHERE bits >= CASE WHEN digits AND (upper OR lower) AND regexp_full_match(hit, '[0-9a-f]+|[0-9A-F]+') THEN 2.9
                     WHEN digits AND (upper OR lower) THEN 3.6 WHEN upper AND lower THEN 3.9 END
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = j.doc_id AND b.low <= j.low AND j.high <= b.high)
), every AS (
  SELECT * FROM base UNION ALL SELECT * FROM secret
), named AS (
  SELECT *, kind || ':' || low || ':' || high AS name FROM every
)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(name, ',' ORDER BY low, rank) FILTER (kind <> 'entropy'), '')) AS base_sha256,
       coalesce(string_agg(name, ',' ORDER BY low, rank), '') AS spans
FROM texts t LEFT JOIN named n ON t.doc_id = n.doc_id GROUP BY t.doc_id
"""

OP4_SUFFIX_DEDUP = """
WITH hexed AS (
  SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents
), chunks AS (  -- a part of a long string is found faster in a short one
  SELECT doc_id, length(h) // 2 - 99 AS n, h, unnest(range(0, (length(h) // 2 - 99 + 499) // 500)) AS c FROM hexed WHERE length(h) >= 200
), windows AS (
  SELECT doc_id, 500 * c + i AS p, hash(substr(own, 2 * i + 1, 200)) AS w
  FROM (SELECT doc_id, c, substr(h, 1000 * c + 1, 1198) AS own, unnest(range(0, least(500, n - 500 * c))) AS i FROM chunks)
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS nth FROM windows
), later AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens FROM ranked WHERE nth > 1
), numbered AS (
  SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM later
), runs AS (
  SELECT doc_id, min(p) AS low, max(p) + 100 AS high FROM numbered GROUP BY doc_id, run
), placed AS (
  SELECT *, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM runs
), kept AS (
  SELECT r.doc_id, sum(r.high - r.low) AS n_removed, count(*) AS n_spans,
         string_agg(substr(x.h, 2 * r.before + 1, 2 * (r.low - r.before)), '' ORDER BY r.low) || substr(any_value(x.h), 2 * max(r.high) + 1) AS h
  FROM placed r JOIN hexed x ON r.doc_id = x.doc_id GROUP BY r.doc_id
)
SELECT x.doc_id, length(x.h) // 2 AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.h, x.h))) AS kept_sha256
FROM hexed x LEFT JOIN kept k ON x.doc_id = k.doc_id
"""
