"""DuckDB SQL computing the same rows as the queries, where SQL can express the operator."""

from __future__ import annotations

OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
cls AS (SELECT min(doc_id) AS rep, sh FROM (SELECT doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
x AS (SELECT rep, len(sh) AS n, unnest(sh) AS t FROM cls),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c, min(a.n) AS na, min(b.n) AS nb
      FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT rep AS id, rep AS seen FROM cls UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.seen),
c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id,
       s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM s LEFT JOIN cls ON list_sort(s.sh) = cls.sh LEFT JOIN c ON c.id = cls.rep
"""

OP9 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
p AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS i FROM n)),
f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s),
g AS (SELECT p.doc_id, p.i FROM p JOIN f USING (s) WHERE f.first < p.doc_id),
m AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM g),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
z AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, k),
kept AS (SELECT z.doc_id, sum(b - a) AS removed, count(*) AS spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM z GROUP BY z.doc_id)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN spans IS NULL THEN h ELSE substr(h, 1, 2 * starts[1]) || array_to_string(list_transform(range(1, spans + 1),
    lambda j: substr(h, 2 * ends[j] + 1, 2 * (CASE WHEN j = spans THEN n.n ELSE starts[j + 1] END - ends[j]))), '') END)) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
        sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
l AS (SELECT *, CAST(total - used AS DOUBLE) / w_left AS level FROM o),
u AS (SELECT arg_min(level, cap / w) AS unit FROM l WHERE level <= cap / w),
t AS (SELECT source, source_size, least(cap, w * coalesce((SELECT unit FROM u), 'inf'::DOUBLE)) AS target FROM l),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.tie) AS place,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        CAST(CAST('0x' || substr(md5(coalesce('s' || d.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(start + place * rate) - floor(start + (place - 1) * rate)) AS BIGINT) AS taken FROM c
"""

OP10 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1), lambda i: q.x[i] * c.x[i])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + l.v) AS BIGINT) AS p,
        CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS BIGINT) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM x WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
      FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""

OP12 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?(INST|SYS|ROLE)\]|\[END\]')) AS n,
        length(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?(INST|SYS|ROLE)\]|\[END\]')) AS m FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE m + 22 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def _op13(k: int = 40, rounds: int = 5) -> str:
    """Rounds are unrolled: each assigns by the exact distance, then takes the floor of the means."""
    near = """a{i} AS MATERIALIZED (SELECT id, x, r, m.c AS cluster, m.d AS distance FROM (SELECT v.r, any_value(v.id) AS id, any_value(v.x) AS x,
      min(struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))), c := c.j)) AS m
      FROM v CROSS JOIN c{i} c GROUP BY v.r))"""
    mean = """s{i} AS (SELECT cluster, u.i AS i, sum(x[u.i]) AS s, count(*) AS n FROM a{i} CROSS JOIN (SELECT unnest(range(1, 65)) AS i) u GROUP BY 1, 2),
    n{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{i} GROUP BY cluster),
    c{j} AS MATERIALIZED (SELECT c.j, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN n{i} n ON n.cluster = c.j)"""
    steps = []
    for i in range(rounds):
        steps += [near.format(i=i), mean.format(i=i, j=i + 1)]
    steps.append(near.format(i=rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id AS id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || id), x) - 1 AS j, x FROM v WHERE id IS NOT NULL ORDER BY sha256('2:' || id), x LIMIT {k}),
{", ".join(steps)}
SELECT a.id AS vec_id, CAST(a.cluster AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.j = a.cluster
"""


ORACLES: dict[str, str] = {
    "op3_minhash_near_dedup": OP3,
    "op8_source_mixing": OP8,
    "op9_suffix_dedup": OP9,
    "op10_exact_topk": OP10,
    "op11_source_divergence": OP11,
    "op12_chat_formatting": OP12,
    "op13_centroid_clustering": _op13(),
}
