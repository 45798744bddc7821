"""SQL that gives the rows of a query on DuckDB, where SQL can."""

CHAT_SNAPSHOTS = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS said_by, coalesce(text, '') AS said FROM conversations
),
hashed AS (
  SELECT *, md5(length(said_by) || '|' || said_by || '|' || said) AS h FROM turns
),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(h, '' ORDER BY turn, said_by, h) AS hashes,
    string_agg('<|' || said_by || '|>' || chr(10) || said || '<|end|>' || chr(10), '' ORDER BY turn, said_by, said) AS rendered
  FROM hashed GROUP BY conv_id
),
one AS (
  SELECT hashes, min(conv_id) AS conv_id, min(n_turns) AS n_turns, count(*) AS n_copies, min(rendered) AS rendered
  FROM whole GROUP BY hashes
),
prefixes AS (
  SELECT DISTINCT left(hashes, 32 * k) AS hashes FROM (SELECT hashes, unnest(range(1, n_turns)) AS k FROM whole)
)
SELECT conv_id, n_turns, n_copies, rendered FROM one WHERE hashes NOT IN (SELECT hashes FROM prefixes)
"""

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS words FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(words)) AS size, words[k + 1:k + least(13, len(words))] AS win
  FROM (SELECT item_id, words, unnest(range(len(words) - least(13, len(words)) + 1)) AS k FROM item WHERE len(words) > 0)
),
places AS (
  SELECT doc_id, k, size, words[k + 1:k + size] AS win
  FROM (
    SELECT doc_id, words, size, unnest(range(greatest(len(words) - size + 1, 0))) AS k
    FROM doc CROSS JOIN (SELECT DISTINCT size FROM windows)
  )
),
found AS (SELECT doc_id, k, p.size, item_id FROM places p JOIN windows w ON p.size = w.size AND p.win = w.win),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM found) GROUP BY doc_id
),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_CRC32 = """
WITH slots AS (
  SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, zero: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS slot
  FROM (SELECT unnest(range(256)) AS k)
),
sums AS (
  SELECT doc_id, text, xor(list_reduce(
      list_prepend(4294967295, [CAST('0x' || substr(hex(text), CAST(2 * i + 1 AS INT), 2) AS BIGINT) for i in range(octet_length(encode(text)))]),
      lambda c, byte: xor(slot[(xor(c, byte) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
  FROM (SELECT DISTINCT doc_id, text FROM documents) CROSS JOIN slots
)
"""

INTERLEAVED_SHARDS = _CRC32 + """,
ranked AS (
  SELECT d.doc_id, d.source, octet_length(encode(d.text)) + 1 AS size, s.text_crc32, md5('42|' || d.doc_id) AS draw,
    count(*) OVER (PARTITION BY d.source) AS n,
    row_number() OVER (PARTITION BY d.source ORDER BY md5('42|' || d.doc_id), d.doc_id) AS nth
  FROM documents d JOIN sums s ON s.doc_id = d.doc_id AND s.text = d.text
),
placed AS (
  SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY (nth - 1 + 0.5::DOUBLE) / n, source, draw, doc_id) - 1 AS place FROM ranked
),
dealt AS (SELECT *, place * 8 // total AS shard FROM placed)
SELECT doc_id, source, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt
"""

NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(words[k + 1:k + 5], 'string_agg', ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(greatest(len(words) - 4, 1))) AS k FROM doc WHERE len(words) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id != b.doc_id
  GROUP BY ALL
),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)
),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM doc JOIN least ON least.a = doc.doc_id LEFT JOIN sizes ON sizes.doc_id = doc.doc_id
"""

# Every vector against every other: what the index must find.
EMBEDDING_NEAR_DEDUP = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
    ON a.vec_id != b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""

EXACT_TOP_K = """
WITH vectors AS (
  SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
),
scores AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors r ON q.vec_id % 50 = 0 AND q.vec_id != r.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# Near words share the word without one code point: at the same place if one is replaced, as the shorter word if one is inserted.
SPELLING_VARIANTS = """
WITH RECURSIVE slots AS (
  SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, zero: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS slot
  FROM (SELECT unnest(range(256)) AS k)
),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run
  FROM documents
),
named AS (SELECT DISTINCT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS name FROM runs WHERE length(run) >= 7),
sums AS (
  SELECT name, run, xor(list_reduce(
      list_prepend(4294967295, [CAST('0x' || substr(hex(name), CAST(2 * i + 1 AS INT), 2) AS BIGINT) for i in range(octet_length(encode(name)))]),
      lambda c, byte: xor(slot[(xor(c, byte) & 255) + 1], c >> 8)), 4294967295) AS h
  FROM named CROSS JOIN slots
),
cut AS (
  SELECT name, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM sums
),
words AS (
  SELECT word, count(*) AS n FROM runs JOIN cut ON name = coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
),
shorter AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word != b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
),
best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near
),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND place = 1
),
ways AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL
  SELECT w.word, f.form, steps + 1 FROM ways w JOIN forms f ON f.word = w.root WHERE f.form IS NOT NULL
),
ends AS (SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY word)
SELECT word, n, n_near, form, form_n, root FROM forms JOIN ends USING (word)
"""

SOURCE_DIVERGENCE = r"""
WITH doc AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
terms AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM doc
),
kept AS (SELECT lang, term, count(*) AS total FROM terms GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(n), 0) AS size FROM (SELECT DISTINCT lang, source FROM doc) g LEFT JOIN counts USING (lang, source) GROUP BY ALL
),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
    1 + CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2) // (g.size + 2 * v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (total + 2) // (l.size + 2 * v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
