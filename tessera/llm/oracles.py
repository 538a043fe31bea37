"""DuckDB SQL for the corpus operators that SQL can express."""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle
  FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
capped AS (
  SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, 3 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) AS total FROM ranked),
levels AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER (ORDER BY cap / CAST(weight AS DOUBLE), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
         CAST(sum(weight) OVER (ORDER BY cap / CAST(weight AS DOUBLE), rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS shared FROM capped),
level AS (
  SELECT rest, shared FROM levels WHERE rest * weight <= cap * shared ORDER BY cap / CAST(weight AS DOUBLE), rank LIMIT 1),
targets AS (
  SELECT c.source, c.source_size, c.rank, least(CAST(c.cap AS DOUBLE), CAST(c.weight * l.rest AS DOUBLE) / CAST(l.shared AS DOUBLE)) AS target
  FROM capped c, level l),
queued AS (
  SELECT s.doc_id, s.size, s.source, s.shuffle, t.source_size, t.rank, t.target,
         CAST(sum(s.size) OVER (PARTITION BY t.rank ORDER BY s.shuffle, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS BIGINT) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT q.*, c.copy, c.copy * q.source_size + q.start AS begins
  FROM queued q, (SELECT unnest([0, 1, 2]) AS copy) c WHERE q.size > 0 AND c.copy * q.source_size + q.start < q.target),
parts AS (
  SELECT *, least(size, CAST(ceil(target) AS BIGINT) - begins) AS part FROM copies),
line AS (
  SELECT *, CAST(sum(part) OVER (ORDER BY CAST(begins + part AS DOUBLE) / target, rank, shuffle, doc_id, copy ROWS UNBOUNDED PRECEDING) - part AS BIGINT) AS place FROM parts),
cut AS (
  SELECT doc_id, CAST(sum(least(part, total - place)) AS BIGINT) AS taken, CAST(count(*) AS INTEGER) AS copies
  FROM line, (SELECT DISTINCT total FROM capped) WHERE place < total GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(c.taken, 0) AS taken, q.source, coalesce(c.copies, 0) AS copies
FROM queued q LEFT JOIN cut c USING (doc_id)"""


# The checksum and the jump sequence are folds over lists; arithmetic modulo 2**64 is done in HUGEINT.
SHARDING = r"""
WITH RECURSIVE bits(byte, r, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT byte, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(r ORDER BY byte) AS t FROM bits WHERE k = 8),
raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, len(h) // 2 + 8 AS size, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(0, len(h) // 2), lambda i: CAST((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) AS crc
  FROM raw, crc),
jump AS (
  SELECT doc_id, size, crc, list_reduce([{'k': CAST(CASE WHEN doc_id < 0 THEN doc_id + 18446744073709551616::HUGEINT ELSE doc_id END AS HUGEINT), 'was': -1::BIGINT, 'b': -1::BIGINT, 'j': 0::BIGINT}] || list_transform(range(25), lambda i: {'k': 0::HUGEINT, 'was': 0::BIGINT, 'b': 0::BIGINT, 'j': 0::BIGINT}),
    lambda s, x: CASE WHEN s.j > 24 THEN s ELSE {'k': (s.k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT, 'was': s.b, 'b': s.j,
      'j': CAST(floor((s.j + 1) * (2147483648::DOUBLE / CAST(((s.k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT) // 8589934592 + 1 AS DOUBLE))) AS BIGINT)} END) AS s
  FROM sums),
placed AS (SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, CAST(CASE WHEN s.b < 24 THEN s.b ELSE s.was END AS INTEGER) AS shard, CAST(s.b AS INTEGER) AS grown_shard FROM jump)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM placed"""

# Brute force: all pairs of sets with a common shingle, and reachability over their links.
NEAR_DEDUP = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN w ELSE [] END AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
nodes AS (SELECT min(doc_id) AS node, n, list_sort(s) AS s FROM sized WHERE n > 0 GROUP BY n, list_sort(s)),
members AS (SELECT z.doc_id, z.n, o.node FROM sized z LEFT JOIN nodes o ON o.n = z.n AND o.s = list_sort(z.s)),
shingles AS (SELECT node, n, unnest(s) AS g FROM nodes),
common AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, count(*) AS i FROM shingles a JOIN shingles b ON a.g = b.g AND a.node < b.node AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM common WHERE 100 * i >= 80 * (na + nb - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
least_node AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles, coalesce(l.component, m.doc_id) AS component_id, m.doc_id = coalesce(l.component, m.doc_id) AS kept
FROM members m LEFT JOIN least_node l ON l.node = m.node"""

# The checksum is a fold over each distinct feature's bytes.
IMPORTANCE_RESAMPLING = r"""
WITH RECURSIVE bits(byte, r, k) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL SELECT byte, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(r ORDER BY byte) AS t FROM bits WHERE k = 8),
texts AS (SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (
  SELECT side, row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT side, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
distinct_features AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)),
hashed AS (
  SELECT f, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(0, len(h) // 2), lambda i: CAST((instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 10000 AS bucket FROM distinct_features, crc),
counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM features JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM features),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(c.t + 1 AS DOUBLE) * (o.s + 10000) / (CAST(c.s + 1 AS DOUBLE) * (o.t + 10000)))) AS BIGINT) AS gain FROM counts c, totals o),
sums AS (SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS g FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
scored AS (
  SELECT w.doc_id, len(w.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(CASE WHEN g >= 0 THEN g // n ELSE -((n - 1 - g) // n) END, 0) AS weight,
         CAST(concat('0x', sha256('7:' || coalesce(CAST(w.doc_id AS VARCHAR), ''))[1:8]) AS BIGINT) AS h
  FROM words w LEFT JOIN sums USING (row) WHERE side = 0),
noisy AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) FILTER (n_words >= 20) OVER () AS eligible FROM noisy)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN n_words >= 20 AND place <= 25 * eligible // 100 THEN place END AS rank FROM ranked"""

FILTER_AUDIT = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT t.part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
         {'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
          'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
          'E': coalesce(min(t.doc_id) OVER (PARTITION BY text) < t.doc_id, false)} AS f
  FROM texts t LEFT JOIN marks m USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.l <> a.l AND c.l NOT IN (a.l, b.l) AND d.l NOT IN (a.l, b.l, c.l) AND e.l NOT IN (a.l, b.l, c.l, d.l)),
failing AS (
  SELECT part, good, toxic, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END,
         CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS fails FROM flags),
patterns AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failing GROUP BY ALL),
replayed AS (
  SELECT p.*, o, k AS step, o[k] AS letter,
         len(list_filter(range(1, k), lambda i: contains(fails, o[i]))) > 0 AS earlier, contains(fails, o[k]) AS failing
  FROM patterns p, orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
counted AS (
  SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, letter,
         CAST(coalesce(sum(n) FILTER (NOT earlier AND NOT failing), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT earlier AND failing), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (earlier AND failing), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = letter), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (NOT earlier AND failing), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT earlier AND failing), 0) AS BIGINT) AS toxic_lost
  FROM replayed GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM counted"""


def oracle_sql() -> dict[str, str]:
    """By query; the tokenizer, the learned models and the media format have none."""
    return {"op2_sharding": SHARDING, "op3_exact_dedup": EXACT_DEDUP, "op8_near_dedup": NEAR_DEDUP, "op10_mixing": MIXING, "op11_importance_resampling": IMPORTANCE_RESAMPLING, "op13_filter_audit": FILTER_AUDIT}
