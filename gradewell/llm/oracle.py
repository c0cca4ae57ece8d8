"""DuckDB SQL for the operators whose results SQL can express over whole tables. The others are
held against brute force in the tests."""

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""

CHAT_FORMAT = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length('<|turn|><|text|><|end|>')
    + length(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'))
    + length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""

DECONTAMINATION = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(10, len(words)) AS n FROM b WHERE len(words) > 0),
item AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM sized)),
lengths AS (SELECT DISTINCT n FROM item),
win AS (
  SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, lengths)),
hit AS (SELECT doc_id, i, item.n, item_id FROM win JOIN item ON win.win = item.win AND win.n = item.n),
cover AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id LEFT JOIN named ON w.doc_id = named.doc_id
"""

PHRASES = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM piece),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, k, p, count(*) AS f
  FROM (SELECT lang, k, ws[i:i + k - 1] AS p FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)))
  GROUP BY lang, k, p HAVING count(*) >= 100),
longer AS (
  SELECT lang, part, max(f) AS f FROM (
    SELECT lang, f, unnest([p[1:k - 1], p[2:k]]) AS part FROM f WHERE k > 2) GROUP BY lang, part),
cand AS (SELECT f.lang, f.k, f.p, f.f AS a FROM f LEFT JOIN longer ON f.lang = longer.lang AND f.p = longer.part
  WHERE f.k > 1 AND (longer.f IS NULL OR 100 * longer.f < 100 * f.f)),
cut AS (SELECT lang, p, a, j, p[1:j] AS head, p[j + 1:k] AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
scored AS (
  SELECT cut.lang, cut.p, a, j, h.f AS l, t.f AS r, n, 1000 * CAST(a AS HUGEINT) * n // (CAST(h.f AS HUGEINT) * t.f) AS score
  FROM cut JOIN f h ON h.lang = cut.lang AND h.p = cut.head JOIN f t ON t.lang = cut.lang AND t.p = cut.rest JOIN total ON total.lang = cut.lang),
worst AS (SELECT *, array_to_string(p, ' ') AS phrase FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM worst)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""


def pivot_clusters(rounds: int = 10, k: int = 8) -> str:
    """Plain integer k-means, its rounds written out one after the other."""
    assigned = """a{r} AS MATERIALIZED (
  SELECT rn, min({{'d': d, 'c': c}}) AS best
  FROM (SELECT e.rn, c.c, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN c{r} c ON e.i = c.i GROUP BY e.rn, c.c) GROUP BY rn)"""
    moved = """c{n} AS MATERIALIZED (
  SELECT c.c, c.i, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT a.best.c AS c, e.i, (sum(e.x) - (sum(e.x) % count(*) + count(*)) % count(*)) // count(*) AS x
    FROM e JOIN a{r} a ON e.rn = a.rn GROUP BY 1, 2) m ON c.c = m.c AND c.i = m.i)"""
    steps = ",\n".join(f"{assigned.format(r=r)},\n{moved.format(r=r, n=r + 1)}" for r in range(rounds))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = 64 AND len(embedding) = 64),
e AS MATERIALIZED (SELECT rn, unnest(range(1, 65)) AS i, unnest(v) AS x FROM v),
c0 AS MATERIALIZED (
  SELECT c, unnest(range(1, 65)) AS i, CAST(unnest(v) AS HUGEINT) AS x
  FROM (SELECT v, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM v) WHERE c < {k}),
{steps},
{assigned.format(r=rounds)},
final AS (SELECT vec_id, a.best.c AS c, a.best.d AS d FROM a{rounds} a JOIN v ON a.rn = v.rn),
named AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS digest FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(final.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY final.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, digest AS centroid_sha256
FROM final JOIN named ON final.c = named.c
"""


ORACLE = {
    "op1_exact_dedup": EXACT_DEDUP,
    "op4_chat_format": CHAT_FORMAT,
    "op7_decontamination": DECONTAMINATION,
    "op11_phrase_collocations": PHRASES,
    "op13_pivot_clusters": pivot_clusters(),
}
