"""DuckDB SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n,
         array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)
),
ns AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)
),
hit AS (SELECT doc_id, p.n, s, item_id FROM places p JOIN win ON p.k = win.k AND p.n = win.n),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_BLANKS = r"[\x20\x09-\x0D]+"

OP10 = f"""
WITH l AS (
  SELECT doc_id, i - 1 AS idx, ls[i] AS line, list_filter(regexp_split_to_array(ls[i], '{_BLANKS}'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
),
long AS (SELECT doc_id, idx, w, array_to_string(w, ' ') AS k FROM l WHERE len(w) >= 5),
firsts AS (SELECT k, min((doc_id, idx)) AS place, any_value(w) AS w FROM long GROUP BY k),
place AS (SELECT k, place, w, unnest(range(0, len(w) + 1)) AS i FROM firsts),
variants AS (
  SELECT k, place, i, k AS v FROM place
  UNION ALL
  SELECT k, place, i, array_to_string(list_concat(w[1:i], w[i+2:]), ' ') AS v FROM place WHERE i < len(w)
),
near AS (
  SELECT DISTINCT k FROM (SELECT k, place, min(place) OVER (PARTITION BY v, i) AS least FROM variants) WHERE place <> least
),
gone AS (
  SELECT doc_id, idx, (doc_id, idx) <> place AS copied
  FROM long JOIN firsts USING (k) LEFT JOIN near ON near.k = long.k
  WHERE (doc_id, idx) <> place OR near.k IS NOT NULL
),
counts AS (
  SELECT doc_id, count(*) FILTER (copied) AS n_copies, count(*) FILTER (NOT copied) AS n_near FROM gone GROUP BY doc_id
),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY idx) AS text, max(len(w)) AS most
  FROM l ANTI JOIN gone USING (doc_id, idx) GROUP BY doc_id
),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_copies, 0) AS n_copies, coalesce(n_near, 0) AS n_near,
       counts.doc_id IS NOT NULL AND coalesce(most, 0) < 5 AS emptied, sha256(coalesce(kept.text, '')) AS text_sha256
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_BLANK = r"[\x20\x09-\x0D]"
_INK = r"[^\x20\x09-\x0D]"

OP3 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_INK}+') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
  SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win)
  WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_INK}') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(t) - len(regexp_extract_all(t, '{_BLANK}')) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         len(regexp_extract_all(t, '[A-Z]')) AS up, len(regexp_extract_all(t, '[a-z]')) AS low,
         len(regexp_extract_all(t, '[0-9]')) AS digits, len(regexp_extract_all(t, '[!?]')) AS marks
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST(
    (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (10 * n_dup_lines > 3 * n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
    + 32 * (2 * up > up + low + 10)::INT + 64 * (2 * digits > word_chars)::INT + 128 * (5 * marks > n_words + 20)::INT
    AS BIGINT) AS failure_bits FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       failure_bits = 0 AS kept, failure_bits, 'full-1' AS policy FROM b
"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM met JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 10 * k >= 8 * (a.n + b.n - k)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT y, c FROM r JOIN both_ways ON x = id)
SELECT d.doc_id, class_id, coalesce(n_links, 0) AS n_links FROM d
JOIN (SELECT id, min(c) AS class_id FROM r GROUP BY 1) ON id = d.doc_id
LEFT JOIN (SELECT x, count(*) AS n_links FROM both_ways GROUP BY 1) l ON l.x = d.doc_id
"""



def _sort_means_sql(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """Every vector against every centroid in each round, the rounds written out."""
    away = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    parts = [
        f"""x AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {size})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
  FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM x WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))""",
    ]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(xv) AS v, min((d, c)) AS m
  FROM (SELECT x.r, x.vec_id, x.v AS xv, c.c, {away} AS d FROM x, c{n} c) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""s{n} AS (
  SELECT c, i, sum(e) AS s, count(*) AS n
  FROM (SELECT m[2] AS c, unnest(v) AS e, unnest(range(1, {size + 1})) AS i FROM a{n}) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (
  SELECT c0.c, coalesce(t.v, c0.v) AS v FROM c{n} c0 LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{n} GROUP BY c) t ON t.c = c0.c)""")
    return f"""WITH {", ".join(parts)},
one AS (SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, CAST(m[1] AS BIGINT) AS distance FROM a{rounds})
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM one JOIN c{rounds} c ON c.c = cluster
"""


OP11 = _sort_means_sql()

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
q AS (SELECT item_id, t, count(*) AS reps FROM (
  SELECT item_id, unnest({_WORDS}) AS t FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d)
       WHERE t IN (SELECT t FROM q) GROUP BY ALL),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(total.n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
           FROM tf, total GROUP BY t),
score AS (
  SELECT item_id, r, doc_id, CAST(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * tf.n * total.n) // total.l)))) AS BIGINT) AS score
  FROM q JOIN tf USING (t) JOIN weight USING (t), total GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0)
WHERE rank <= 10
"""

ORACLES = {
    "op2_decontamination": OP2,
    "op3_quality_rules": OP3,
    "op7_ngram_jaccard": OP7,
    "op10_line_dedup": OP10,
    "op11_sort_means": OP11,
    "op12_block_max": OP12,
}
