"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

INTERVAL_EXPANSION = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 98)) AS i FROM d),
strings AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 200)) AS s FROM starts),
again AS (
  SELECT doc_id, i FROM strings
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
),
-- A byte is covered if the last such start is at most 99 bytes before it.
places AS (SELECT doc_id, unnest(range(1, len(h) // 2 + 1)) AS i FROM d),
marked AS (
  SELECT p.doc_id, p.i, max(a.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS last
  FROM places p LEFT JOIN again a ON a.doc_id = p.doc_id AND a.i = p.i
),
cut AS (SELECT doc_id, i, coalesce(i - last < 100, false) AS gone FROM marked),
edges AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS opens FROM cut),
sums AS (
  SELECT e.doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
    string_agg(substr(h, 2 * i - 1, 2), '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM edges e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id
)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""

COUNT_TREE_JOIN = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents
),
tokens AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS t
  FROM d
),
sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2
),
pairs AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * both_ >= 85 * (a.n + b.n - both_)
),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reached(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reached.doc_id, links.y FROM reached JOIN links ON links.x = reached.r
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN sizes ON sizes.doc_id = d.doc_id
JOIN (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

PHRASE_AUTOMATA = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
windows AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 19), ' ') AS s FROM starts),
again AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1
),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
marked AS (
  SELECT p.doc_id, p.i, p.word, max(a.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS last
  FROM words p LEFT JOIN again a ON a.doc_id = p.doc_id AND a.i = p.i
),
sums AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept
  FROM marked WHERE NOT coalesce(i - last < 20, false) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""

_FIELDS = "||".join(
    f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    for c in ("doc_id", "source", "lang", "n_chars", "text")
)

# Checksum of an ASCII text: each character is mixed in and followed by eight shifts (-1).
_CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x)
  WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295)"""

POINTER_JUMPING = f"""
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS id, doc_id, lang, sha256({_FIELDS}) AS leaf,
    CASE WHEN {_CRC32} % 7 = 0 THEN sha256({_FIELDS.replace("n_chars", "(n_chars::HUGEINT + 1)")}) END AS changed
  FROM documents
),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, id) - 1 AS pos
  FROM rows_
),
nodes(tree, level, pos, h) AS (
  SELECT tree, 0, pos, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS many FROM nodes) WHERE many > 1 GROUP BY tree, level, pos // 2
),
many AS (SELECT tree, level, count(*) AS many FROM nodes GROUP BY tree, level),
subroots AS (SELECT tree, h FROM nodes JOIN many USING (tree, level) WHERE many = 1),
upper_(level, pos, h) AS (
  SELECT 0, tree, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS many FROM upper_) WHERE many > 1 GROUP BY level, pos // 2
),
upper_many AS (SELECT level, count(*) AS many FROM upper_ GROUP BY level),
root AS (SELECT h FROM upper_ JOIN upper_many USING (level) WHERE many = 1),
-- On the way up, a sibling stands left, right or is missing.
steps AS (
  SELECT p.id, m.level AS nth, CASE WHEN (p.pos >> m.level) & 1 = 1 THEN 'L' || s.h ELSE coalesce('R' || s.h, '-') END AS step
  FROM placed p JOIN many m ON m.tree = p.tree AND m.many > 1
  LEFT JOIN nodes s ON s.tree = p.tree AND s.level = m.level AND s.pos = xor(p.pos >> m.level, 1)
  UNION ALL
  SELECT p.id, 1000 + m.level, CASE WHEN (p.tree >> m.level) & 1 = 1 THEN 'L' || s.h ELSE coalesce('R' || s.h, '-') END
  FROM placed p JOIN upper_many m ON m.many > 1
  LEFT JOIN upper_ s ON s.level = m.level AND s.pos = xor(p.tree >> m.level, 1)
),
ways AS (SELECT id, list(step ORDER BY nth) AS way FROM steps GROUP BY id),
folded AS (
  SELECT p.*, coalesce(way, []) AS way,
    list_reduce(list_prepend(coalesce(changed, leaf), coalesce(way, [])), lambda below, x: sha256(
      CASE x[1] WHEN 'L' THEN x[2:] || below WHEN 'R' THEN below || x[2:] ELSE below END)) AS folded_root
  FROM placed p LEFT JOIN ways ON ways.id = p.id
)
SELECT doc_id, leaf, subroots.h AS subroot, root.h AS root,
  sha256(array_to_string([x[2:] for x in way if x <> '-'], '')) AS proof_sha256, folded_root, folded_root = root.h AS verified
FROM folded JOIN subroots ON subroots.tree = folded.tree, root
"""

THRESHOLD_NEGATIVES = """
WITH usable AS (
  SELECT row_number() OVER () AS id, vec_id,
    (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.id AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.id, b.vec_id,
    list_dot_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.id <> b.id WHERE a.vec_id % 50 = 0
),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
  (row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.vec_id, n.id))::INT AS rank, n.vec_id AS negative_id,
  p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
  AND 100 * n.score BETWEEN 50 * p.score AND 95 * p.score
QUALIFY rank <= 3
"""

ORACLES = {
    "op6_interval_expansion": INTERVAL_EXPANSION,
    "op7_count_tree_join": COUNT_TREE_JOIN,
    "op9_phrase_automata": PHRASE_AUTOMATA,
    "op12_pointer_jumping": POINTER_JUMPING,
    "op13_threshold_negatives": THRESHOLD_NEGATIVES,
}
