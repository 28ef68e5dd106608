"""SQL twins of the queries that SQL can express."""

#: CRC-32 of UTF-8 bytes, from the polynomial 0xEDB88320, as a fold over the bytes.
_CRC = """
crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS n)
  )
)"""

ORACLES = {
    "op7_sharding": f"""
WITH {_CRC.strip()},
coded AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
),
summed AS (
  SELECT doc_id, source, size, key,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, size - 1), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
      lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) AS text_crc32
  FROM coded, crc_table
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, text_crc32, size) AS r, count(*) OVER (PARTITION BY source) AS n FROM summed
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, coalesce(source, ''), source IS NULL, r) - 1 AS p, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (p * 8 // total)::INTEGER AS shard,
  (p - ((p * 8 // total) * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source
FROM placed
""",
    "op5_near_dedup": """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D ]+'), lambda x: x <> '') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes u ON u.doc_id = p.a JOIN sizes v ON v.doc_id = p.b WHERE 100 * p.n >= 85 * (u.n + v.n - p.n)
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
""",
}
