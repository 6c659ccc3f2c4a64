"""SQL twin of the importance resampling query."""

OP11_SQL = r"""
WITH texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark
), split AS (
  SELECT side, id, row_number() OVER () AS rn,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM texts
), features AS (
  SELECT side, rn, unnest(ws) AS w FROM split
), crc_table AS (
  SELECT list(c ORDER BY i) AS t
  FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
        FROM range(256) r(i))
), vocabulary AS (
  SELECT w, list_transform(range(octet_length(encode(w))), lambda k: CAST('0x' || substr(hex(encode(w)), 2 * k + 1, 2) AS BIGINT)) AS bytes
  FROM (SELECT DISTINCT w FROM features)
), buckets AS (
  SELECT w, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc_table
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM features JOIN buckets USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1) * CAST(n_s + 10000 AS DOUBLE)) / ((s + 1) * CAST(n_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM counts, (SELECT sum(s) AS n_s, sum(t) AS n_t FROM counts)
), weights AS (
  SELECT rn, sum(gain) AS weight FROM features JOIN buckets USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY rn
), scored AS (
  SELECT id AS doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || id), 1, 8) AS BIGINT) + 0.5)
           / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM split LEFT JOIN weights USING (rn) WHERE side = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranked"""
