"""DuckDB SQL with the results of those queries that SQL can express."""

OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('11:' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM sources),
weighed AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(rnk % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked),
levels AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
found AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, rnk LIMIT 1),
targets AS (SELECT source, source_size, coalesce(least(cap, (SELECT level FROM found) * weight), cap) AS target FROM levels),
times AS (
  SELECT d.doc_id, d.size, d.ord, t.source_size, t.target, row_number() OVER () AS rid,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
offers AS (
  SELECT rid, size, ord, epoch, (epoch * source_size + cum)::DOUBLE / target AS finish
  FROM times, (VALUES (0), (1)) e(epoch) WHERE size > 0 AND target > 0),
cut AS (SELECT *, sum(size) OVER (ORDER BY finish, ord, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM offers),
took AS (SELECT rid, sum(size) AS taken FROM cut WHERE upto <= (SELECT 1.5::DOUBLE * sum(size) FROM sized) GROUP BY rid)
SELECT t.doc_id, t.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM times t LEFT JOIN took k USING (rid)
"""

_GAPS = r"""
  SELECT {key}, {no} AS kind_no, '{kind}' AS kind, i, body,
         list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start
  FROM (SELECT {key}, i, found, found[i] AS body, string_split_regex(text, '{pattern}') AS gaps
        FROM (SELECT {key}, text, found, unnest(range(1, len(found) + 1)) AS i
              FROM (SELECT {key}, text, regexp_extract_all(text, '{pattern}') AS found FROM {rows})))
"""


def _op8() -> str:
    """Base spans, then entropy spans of whole candidates, then of pieces of candidates."""
    from graphloom.llm import secrets as s

    sql = lambda p: p.replace("'", "''")
    spans = {k: _GAPS.format(key="rid", rows="docs", no=n, kind=k, pattern=sql(p)) for n, (k, p) in enumerate((("assign", s.ASSIGN), ("access", s.ACCESS), ("hex", s.HEX), ("entropy", s.CANDIDATE)))}
    w = s.WINDOW
    runs = _GAPS.format(key="rid, part", rows="parts", no=4, kind="piece", pattern=f"[^=]{{{w},}}")
    allowed = " OR ".join(f"regexp_matches(body, '{sql(p)}')" for p in s.ALLOWED)
    bits = (
        f"CASE WHEN regexp_matches(body, '^[0-9a-f]+$') OR regexp_matches(body, '^[0-9A-F]+$') THEN {s.HOT_BITS['hex']} "
        f"WHEN regexp_matches(body, '^[0-9A-Za-z]+$') THEN {s.HOT_BITS['alnum']} ELSE {s.HOT_BITS['base64']} END"
    )
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
base AS (
  SELECT rid, kind_no, kind, start, start + length(body) AS stop FROM ({spans['assign']}) WHERE length(regexp_extract(body, '{sql(s.ASSIGN)}', 2)) >= 6
  UNION ALL SELECT rid, kind_no, kind, start, start + length(body) FROM ({spans['access']})
  UNION ALL SELECT rid, kind_no, kind, start, start + length(body) FROM ({spans['hex']})),
candidates AS MATERIALIZED (SELECT rid, start, start + length(body) AS stop, body FROM ({spans['entropy']})),
tried AS (
  SELECT c.rid, 3 AS kind_no, 'entropy' AS kind, start, body FROM candidates c
  WHERE NOT ({allowed}) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.start < c.stop AND c.start < b.stop)),
looked AS (
  SELECT c.* FROM candidates c JOIN docs d USING (rid)
  WHERE regexp_matches(d.text, '{sql(s.WORD)}') OR regexp_matches(d.text, '{sql(s.NAMED_SIGN)}') OR rid IN (SELECT rid FROM base)),
met AS (SELECT c.rid, c.start AS c_start, c.stop AS c_stop, b.start, b.stop, b.kind_no FROM looked c JOIN base b ON b.rid = c.rid AND b.start < c.stop AND c.start < b.stop),
free AS (
  SELECT rid, greatest(c_start, coalesce(max(stop) OVER (PARTITION BY rid, c_start ORDER BY start, kind_no, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c_start)) AS start, start AS stop FROM met
  UNION ALL SELECT c.rid, greatest(c.start, coalesce(m.stop, c.start)), c.stop
  FROM looked c LEFT JOIN (SELECT rid, c_start, max(stop) AS stop FROM met GROUP BY ALL) m ON m.rid = c.rid AND m.c_start = c.start),
parts AS (SELECT rid, f.start AS part, substr(text, f.start + 1, f.stop - f.start) AS text FROM free f JOIN docs USING (rid) WHERE f.stop - f.start >= {w}),
bare AS (
  SELECT rid, part + start AS start, body, regexp_matches(body, '{sql(s.WORD)}') AS marked, regexp_replace(body, '{sql(s.BEFORE)}', '') AS rest FROM ({runs})),
pieces AS (
  SELECT rid, 4 AS kind_no, 'piece' AS kind, start, body FROM (
    SELECT rid, CASE WHEN marked THEN start + length(body) - length(rest) ELSE start END AS start, CASE WHEN marked THEN regexp_replace(rest, '{sql(s.AFTER)}', '') ELSE body END AS body FROM bare)
  WHERE length(body) >= {w} AND NOT ({allowed})),
every AS (SELECT *, row_number() OVER () AS no FROM (SELECT * FROM tried UNION ALL SELECT * FROM pieces)),
windows AS (SELECT no, body, unnest(range(0, length(body) - {w - 1})) AS pos FROM every),
chars AS (SELECT no, body, pos, unnest(string_split(substr(body, pos + 1, {w}), '')) AS ch FROM windows),
counted AS (SELECT no, body, pos, ch, count(*) AS c FROM chars GROUP BY ALL),
hot AS (
  SELECT no, min(pos) AS first, max(pos) AS last FROM (
    SELECT no, pos FROM counted GROUP BY no, body, pos HAVING log2({w}) - sum(c * log2(c)) / {w} >= any_value({bits}))
  GROUP BY ALL),
warm AS (SELECT rid, kind_no, kind, start + first AS start, start + last + {w} AS stop FROM every JOIN hot USING (no)),
spans AS (
  SELECT rid, kind_no, kind, start, stop FROM base
  UNION ALL SELECT * FROM warm WHERE kind_no = 3
  UNION ALL SELECT * FROM warm p WHERE kind_no = 4 AND NOT EXISTS (SELECT 1 FROM warm e WHERE e.kind_no = 3 AND e.rid = p.rid AND e.start <= p.start AND p.stop <= e.stop)),
told AS (
  SELECT rid, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
         count(*) FILTER (kind_no = 3) AS n_entropy, count(*) FILTER (kind_no = 4) AS n_piece,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER (kind_no < 3) AS base_spans,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) AS spans
  FROM spans GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       coalesce(n_entropy, 0)::BIGINT AS n_entropy, coalesce(n_piece, 0)::BIGINT AS n_piece, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN told USING (rid)
"""


OP2 = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM phrases))),
hits AS (SELECT rid, i, p.n, item_id FROM places JOIN phrases p USING (n, phrase)),
words AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM hits) GROUP BY rid),
texts AS (SELECT DISTINCT n, phrase, string_split(phrase, ' ') AS pw FROM phrases),
opened AS (SELECT rid, w, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
loose AS MATERIALIZED (
  SELECT rid, n, phrase, pw, part FROM (SELECT rid, n, phrase, pw, w[i:i + n + 2] AS part FROM opened JOIN texts ON word = pw[1]) WHERE list_has_all(part, pw)),
near AS (
  SELECT DISTINCT rid, n, phrase FROM loose
  WHERE regexp_matches(array_to_string(part, ' '), '^' || array_to_string(pw, '( [^ ]+)* ') || '( |$)')),
nearly AS (SELECT rid, count(*) AS n_near FROM near ANTI JOIN (SELECT rid, i.n, i.phrase FROM places i) USING (rid, n, phrase) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid) LEFT JOIN nearly USING (rid)
"""

OP3 = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, rid, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, rid, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50 AND doc_id IS NOT NULL)),
gone AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE doc_id > first),
cells AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS pos FROM gone),
words AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM docs),
kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM words ANTI JOIN cells USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""

OP4 = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM documents WHERE doc_id IS NOT NULL),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf) AS dl FROM tfs GROUP BY doc_id),
facts AS (SELECT (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS n, (SELECT sum(dl) FROM lengths) AS words),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * q.tf * (d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / (words / n))))), 6) AS score
  FROM tfs q JOIN tfs d USING (term) JOIN dfs USING (term) JOIN lengths l ON l.doc_id = d.doc_id, facts
  WHERE q.doc_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP6 = r"""
WITH full_pages AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest, max(page_id) AS first FROM full_pages WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM full_pages p LEFT JOIN firsts f ON p.payload_digest = f.payload_digest AND payload_bytes >= 1000
"""

OP11 = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE doc_id IS NOT NULL),
tfs AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM docs) GROUP BY ALL),
facts AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS words FROM docs WHERE len(w) > 0),
dfs AS (SELECT term, count(*)::BIGINT AS df FROM tfs GROUP BY term),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
weighed AS (SELECT item_id, term, times * floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM asked JOIN dfs USING (term), facts),
lengths AS (SELECT rid, doc_id, 25 + (75 * len(w)::BIGINT * n) // words AS m FROM docs, facts WHERE len(w) > 0),
scored AS (
  SELECT item_id, doc_id, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM weighed JOIN tfs USING (term) JOIN lengths USING (rid) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP12 = r"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                         lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)), 4294967295) AS h
  FROM documents),
sizes AS (SELECT rid, len(w)::BIGINT AS n, h, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM docs),
loops AS (SELECT rid, n, a, CASE WHEN h % 10 = 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM sizes WHERE n > 0),
raw AS MATERIALIZED (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS i FROM docs),
places AS (SELECT rid, i, CASE WHEN p IS NULL OR i < a THEN i ELSE a + (i - a) % p END AS j FROM raw JOIN loops USING (rid)),
words AS MATERIALIZED (SELECT q.rid, q.i, r.word FROM places q JOIN raw r ON r.rid = q.rid AND r.i = q.j),
periods AS (SELECT rid, n, unnest(range(1, n // 4 + 1)) AS p FROM loops),
points AS (SELECT rid, p, unnest(range(0, n - 3 * p, p)) AS x FROM periods),
one AS MATERIALIZED (SELECT t.*, word FROM points t JOIN words w ON w.rid = t.rid AND w.i = x),
two AS MATERIALIZED (SELECT t.* FROM one t JOIN words w ON w.rid = t.rid AND w.i = x + p AND w.word = t.word),
three AS MATERIALIZED (SELECT t.* FROM two t JOIN words w ON w.rid = t.rid AND w.i = x + 2 * p AND w.word = t.word),
tried AS MATERIALIZED (SELECT DISTINCT t.rid, p FROM three t JOIN words w ON w.rid = t.rid AND w.i = x + 3 * p AND w.word = t.word),
every AS MATERIALIZED (SELECT t.rid, p, i, word FROM tried t JOIN words w USING (rid)),
same AS (
  SELECT t.rid, t.p, t.i, t.i - row_number() OVER (PARTITION BY t.rid, t.p ORDER BY t.i) AS island
  FROM every t JOIN words w ON w.rid = t.rid AND w.i = t.i + t.p AND w.word = t.word),
stretches AS (SELECT rid, p, min(i) AS start, count(*) + p AS length FROM same GROUP BY rid, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
runs AS (SELECT rid, start, length, min(p) AS period FROM stretches GROUP BY rid, start, length),
told AS (
  SELECT rid, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM runs GROUP BY rid),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length DESC, start, period) AS k FROM runs) WHERE k = 1),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
       (1000 * length // period)::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN told USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept k USING (rid)
"""

ORACLES = {
    "op2_decontamination": OP2,
    "op3_substring_dedup": OP3,
    "op4_bm25_topk": OP4,
    "op6_warc_archive": OP6,
    "op8_secret_scan": _op8(),
    "op10_source_mixing": OP10,
    "op11_ranked_search": OP11,
    "op12_periodic_runs": OP12,
}
