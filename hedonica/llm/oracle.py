"""DuckDB SQL for the queries that SQL can express."""

OP5 = r"""
WITH lowered AS (
  SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM benchmark
), items AS (
  SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + 12], ' ') AS win
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0
), sizes AS (
  SELECT DISTINCT size FROM windows
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), spots AS (
  SELECT rid, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM docs, sizes, unnest(range(1, len(w) - size + 2)) AS r(i)
), found AS (
  SELECT rid, i, size, item_id FROM spots JOIN windows USING (size, win)
), hits AS (
  SELECT rid, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT rid, i, size FROM found), unnest(range(i, i + size)) AS r(p) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""

OP8 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), spots AS (
  SELECT rid, i, array_to_string(w[i : i + 4], ' ') AS win FROM split, unnest(range(1, len(w) - 3)) AS r(i)
), twice AS (
  SELECT rid, i FROM spots QUALIFY count(*) OVER (PARTITION BY rid, win) > 1
), again AS (
  SELECT rid, count(DISTINCT p) AS n FROM twice, unnest(range(i, i + 5)) AS r(p) GROUP BY rid
), m AS (
  SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    length(regexp_replace(t, '\P{Lu}+', '', 'g'))::BIGINT AS n_upper,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(lines)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN again USING (rid)
), signs AS (
  SELECT rid, lang, source, n_words, unnest([0, 1, 2, 3]) AS sign, unnest([
    n_symbols * 1000000 // nullif(n_words, 0), n_upper * 1000000 // nullif(word_chars, 0),
    n_dup_lines * 1000000 // nullif(n_lines, 0), word_chars * 1000000 // nullif(n_words, 0)]) AS v
  FROM m
), binned AS (
  SELECT level, CASE WHEN level < 2 THEN lang END AS lang, CASE WHEN level < 1 THEN source END AS source,
    sign, v >> greatest(length(bin(v)) - 8, 0) << greatest(length(bin(v)) - 8, 0) AS b
  FROM signs, unnest([0, 1, 2]) AS l(level) WHERE n_words >= 10
), quartiles AS (
  SELECT level, lang, source, sign, count(*) AS docs,
    quantile_disc(b, 0.5) AS q2, quantile_disc(b, 0.75) AS q3
  FROM binned GROUP BY ALL
), fences AS (
  SELECT *, q3 + [10, 20, 10, 15][sign + 1] * greatest(q3 - q2, [20000, 600, 60000, 20000][sign + 1]) AS fence FROM quartiles
), beyond AS (
  SELECT rid, bool_or(v > CASE WHEN a.docs >= 200 THEN a.fence WHEN b.docs >= 200 THEN b.fence ELSE c.fence END) AS out
  FROM signs s
  LEFT JOIN fences a ON a.level = 0 AND a.sign = s.sign AND a.lang IS NOT DISTINCT FROM s.lang AND a.source IS NOT DISTINCT FROM s.source
  LEFT JOIN fences b ON b.level = 1 AND b.sign = s.sign AND b.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN fences c ON c.level = 2 AND c.sign = s.sign
  GROUP BY rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(out, false) AS kept
FROM m JOIN beyond USING (rid)
"""

OP6 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html,
    regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^(?i)[a-z][a-z0-9+.-]*://([^/?@]*@)?', '') AS u
  FROM pages
), k AS (
  SELECT page_id, html,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x:
      x <> '' AND NOT regexp_matches(x, '^(?i)(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))), '&') AS q
  FROM p
), c AS (
  SELECT page_id, html, page_id % 4 = 1 AS dated, page_id % 16 = 2 AS bare,
    nullif(place || CASE WHEN q <> '' THEN '?' || q ELSE '' END, '') AS canonical_url
  FROM k
), visits AS (
  SELECT *, -1 AS visit, 'revisit' AS type, 'revisit' AS kind, 1 AS version FROM c WHERE page_id % 8 = 3
  UNION ALL SELECT *, 0, 'response', 'full', 1 FROM c
  UNION ALL SELECT *, 1, 'revisit', 'revisit', 1 FROM c
  UNION ALL SELECT *, 2, 'response', 'full', 2 FROM c WHERE page_id % 4 = 0
  UNION ALL SELECT *, 2, 'response', 'other', 1 FROM c WHERE page_id % 16 = 5
  UNION ALL SELECT *, 3, 'revisit', 'revisit', CASE WHEN page_id % 8 = 0 THEN 2 ELSE 1 END FROM c WHERE page_id % 4 = 0
), bodies AS (
  SELECT *, html || CASE WHEN version = 2 THEN '<!-- 2 -->' ELSE '' END AS body,
    'urn:' || type || ':' || page_id || ':' || visit AS record_id, page_id + 5000 * visit AS minute
  FROM visits
), e AS (
  SELECT record_id, canonical_url, minute, kind, strlen(body) AS size,
    CASE WHEN NOT dated AND NOT bare THEN '"' || md5(body) || '"' END AS tag,
    CASE WHEN dated THEN strftime(DATE '2023-11-14' + (page_id % 1000 + version)::INT, '%a, %d %b %Y') || ' 00:00:00 GMT' END AS modified
  FROM bodies
), found AS (
  SELECT r.record_id, f.record_id AS ref, f.size AS ref_size,
    coalesce(r.tag = f.tag, r.modified = f.modified) AS agree
  FROM e r JOIN e f ON f.canonical_url = r.canonical_url AND f.minute < r.minute
  WHERE r.kind = 'revisit' AND f.kind = 'full'
  QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.minute DESC, f.record_id DESC) = 1
)
SELECT e.record_id, canonical_url,
  CASE WHEN kind <> 'revisit' THEN kind WHEN ref IS NULL THEN 'no_earlier' WHEN agree THEN 'resolved'
    WHEN NOT agree THEN 'changed' ELSE 'unverified' END AS outcome,
  ref AS refers_to,
  concat_ws('; ',
    CASE WHEN kind = 'full' OR agree THEN 'content-type: text/html' END,
    CASE WHEN agree THEN 'content-length: ' || ref_size END,
    CASE WHEN kind <> 'other' THEN 'etag: ' || CASE WHEN kind = 'revisit' THEN 'W/' ELSE '' END || tag END,
    CASE WHEN kind <> 'other' THEN 'last-modified: ' || modified END,
    CASE kind WHEN 'full' THEN 'cache-control: max-age=60' WHEN 'revisit' THEN 'cache-control: max-age=120' ELSE 'retry-after: 60' END,
    CASE WHEN kind = 'full' THEN 'content-length: ' || size WHEN kind = 'revisit' AND agree IS NOT TRUE THEN 'content-length: 0' END
  ) AS headers
FROM e LEFT JOIN found USING (record_id)
"""

# CRC-32 by bytes: the table's entry for a byte is that byte after eight shifts.
CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)
    ORDER BY b) AS t FROM range(256) AS r(b)
)"""

OP11 = f"""
WITH RECURSIVE {CRC_TABLE}, read AS (
  SELECT d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
), each AS (
  SELECT d, run, count(*) AS n, hex(encode(d || ':' || run)) AS x FROM read WHERE length(run) >= 6 GROUP BY d, run
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_transform(range(0, length(x) // 2), lambda i:
      (strpos('0123456789ABCDEF', x[2 * i + 1]) * 16 + strpos('0123456789ABCDEF', x[2 * i + 2]) - 17)::BIGINT),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT)) AS h
  FROM each, crc_table
), known AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
      ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), plain AS (  -- levenshtein compares bytes, so every letter becomes one
  SELECT word, n, length(word) AS size,
    translate(word, '{"".join(map(chr, range(0xC0, 0x100)))}', '{"".join(chr(c) for c in range(33, 127) if not 97 <= c <= 122 and c != 39)[:64]}') AS b
  FROM known
), near AS (
  SELECT a.word, a.n, x.word AS other, x.n AS other_n
  FROM plain a JOIN plain x ON x.size BETWEEN a.size - 1 AND a.size + 1 AND a.word <> x.word
  WHERE levenshtein(a.b, x.b) = 1
), top AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n
  FROM near GROUP BY word
), judged AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM known LEFT JOIN top USING (word)
), chain AS (
  SELECT word, word AS root FROM judged WHERE form IS NULL
  UNION ALL
  SELECT j.word, c.root FROM judged j JOIN chain c ON j.form = c.word
)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN chain USING (word)
"""


def _op13(rounds: int = 3) -> str:
    """Every round by comparing all vectors with all centroids, a row for each dimension."""
    out = """
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, sha256('1:' || vec_id) AS h,
    list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), flat AS (
  SELECT rid, unnest(v) AS x, unnest(range(64)) AS dim FROM kept
), c0 AS (
  SELECT c, unnest(v) AS m, unnest(range(64)) AS dim
  FROM (SELECT v, row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c FROM kept) WHERE c < 16
)"""
    for i in range(rounds + 1):
        out += f""", d{i} AS (
  SELECT rid, c, sum((x - m) * (x - m))::BIGINT AS distance FROM flat JOIN c{i} USING (dim) GROUP BY rid, c
), a{i} AS (
  SELECT rid, min(distance) AS distance, arg_min(c, (distance, c)) AS c FROM d{i} GROUP BY rid
)"""
        if i < rounds:
            out += f""", s{i} AS (
  SELECT c, dim, sum(x)::BIGINT AS s, count(*) AS n FROM flat JOIN a{i} USING (rid) GROUP BY c, dim
), c{i + 1} AS (
  SELECT c, dim, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM c{i} LEFT JOIN s{i} USING (c, dim)
)"""
    return out + f""", named AS (
  SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY c
)
SELECT vec_id, c::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN named USING (c) JOIN kept USING (rid)
"""


SQL = {
    "op5_decontaminate": OP5, "op6_warc": OP6, "op8_quality": OP8, "op11_spelling": OP11,
    "op13_centroids": _op13(),
}
