"""DuckDB oracles: the expected rows of each registered query, computed
from the *relational* columns the fixtures were written from (no text
parsing), so the two sides share no logic.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- fx_java
# n = parts; tg = distinct (p -> q) references; f = file of each part
JAVA_CTE = """
WITH np AS (SELECT count(*) AS n FROM part),
tg AS (SELECT DISTINCT l_partkey AS p, (l_suppkey * 7 + l_orderkey) % (SELECT n FROM np) AS q
       FROM lineitem),
f AS (SELECT p_partkey AS p, p_size AS z, p_partkey % 25 AS b,
             concat('src/brand', p_partkey % 25, '/Part', p_partkey, '.java') AS file FROM part),
deg_out AS (SELECT p, count(*) AS c FROM tg GROUP BY p),
deg_in AS (SELECT q AS p, count(*) AS c FROM tg GROUP BY q),
nodes AS (SELECT f.p, f.file, f.b,
                 CAST(coalesce(o.c, 0) AS BIGINT) AS dependency_count,
                 CAST(coalesce(i.c, 0) AS BIGINT) AS dependent_count
          FROM f LEFT JOIN deg_out o ON o.p = f.p LEFT JOIN deg_in i ON i.p = f.p)
"""


def _java(sql: str) -> str:
    return JAVA_CTE + sql


ORACLES["sym_units"] = _java("""
SELECT 'parts' AS repo, file, 'java' AS language, concat('com.brand', b) AS namespace FROM f
""")

ORACLES["sym_imports"] = _java("""
SELECT 'parts' AS repo, f.file, 'java' AS language,
       CAST(row_number() OVER (PARTITION BY tg.p ORDER BY tg.q) - 1 AS BIGINT) AS ord,
       concat('com.brand', tg.q % 25, '.Part', tg.q) AS "import"
FROM tg JOIN f ON f.p = tg.p
UNION ALL
SELECT 'parts', f.file, 'java', CAST(coalesce(o.c, 0) AS BIGINT), 'java.util.List'
FROM f LEFT JOIN deg_out o ON o.p = f.p WHERE f.p % 3 = 0
""")

ORACLES["sym_types"] = _java("""
SELECT 'parts' AS repo, file, 'java' AS language, 'class' AS kind, concat('Part', p) AS name,
       CAST(0 AS BIGINT) AS ord FROM f
UNION ALL SELECT 'parts', file, 'java', 'interface', concat('IPart', p), 0 FROM f WHERE p % 11 = 0
UNION ALL SELECT 'parts', file, 'java', 'enum', concat('Kind', p), 0 FROM f WHERE p % 5 = 0
""")

ORACLES["sym_heritage"] = _java("""
SELECT 'parts' AS repo, file, 'java' AS language, 'class' AS kind, concat('Part', p) AS type,
       'extends' AS relation, CAST(0 AS BIGINT) AS ord, concat('Base', b) AS parent FROM f
UNION ALL SELECT 'parts', file, 'java', 'class', concat('Part', p), 'implements', 1, 'Sized' FROM f
UNION ALL SELECT 'parts', file, 'java', 'class', concat('Part', p), 'implements', 2, concat('Item', z) FROM f
""")

ORACLES["dep_type_index"] = _java("""
SELECT 'parts' AS repo, concat('com.brand', b, '.Part', p) AS key, file FROM f
UNION ALL SELECT 'parts', concat('Part', p), file FROM f
UNION ALL SELECT 'parts', concat('com.brand', b, '.IPart', p), file FROM f WHERE p % 11 = 0
UNION ALL SELECT 'parts', concat('IPart', p), file FROM f WHERE p % 11 = 0
""")

ORACLES["dep_package_index"] = _java("""
SELECT 'parts' AS repo, concat('com.brand', b) AS package, file FROM f
""")

ORACLES["dep_resolve"] = _java("""
, special AS (SELECT * FROM f WHERE p % 100 = 0),
first_in_pkg AS (SELECT b, min(file) AS file FROM f GROUP BY b)
SELECT 'parts' AS repo, f.file, concat('com.brand', tg.q % 25, '.Part', tg.q) AS "import",
       1 AS rule, t.file AS target
FROM tg JOIN f ON f.p = tg.p JOIN f t ON t.p = tg.q
UNION ALL
SELECT 'parts', s.file, concat('legacy.Part', (s.p + 1) % (SELECT n FROM np)), 2, t.file
FROM special s JOIN f t ON t.p = (s.p + 1) % (SELECT n FROM np)
UNION ALL
SELECT 'parts', s.file, concat('com.brand', (s.b + 1) % 25, '.*'), 3, t.file
FROM special s JOIN f t ON t.b = (s.b + 1) % 25
UNION ALL
SELECT 'parts', s.file, concat('d', s.b, '.Part'), 4, fp.file
FROM special s JOIN first_in_pkg fp ON fp.b = s.b
""")

ORACLES["dep_edges"] = _java("""
SELECT DISTINCT 'parts' AS repo, s.file AS source, t.file AS target, 'internal' AS type
FROM tg JOIN f s ON s.p = tg.p JOIN f t ON t.p = tg.q
""")

ORACLES["dep_external"] = _java("""
SELECT 'parts' AS repo, file, 'java.util.List' AS "import" FROM f WHERE p % 3 = 0
""")

ORACLES["dep_nodes"] = _java("""
SELECT 'parts' AS repo, file, 'java' AS language, concat('com.brand', b) AS package,
       CASE WHEN p % 11 = 0 THEN concat('Part', p, ',IPart', p) ELSE concat('Part', p) END AS class_names,
       dependency_count, dependent_count
FROM nodes
""")

ORACLES["dep_metrics"] = _java("""
SELECT 'parts' AS repo,
       CAST((SELECT count(*) FROM f) AS BIGINT) AS file_count,
       CAST((SELECT 2 * count(*) + 2 * count(*) FILTER (WHERE p % 11 = 0) FROM f) AS BIGINT) AS class_count,
       CAST((SELECT count(*) + count(*) FILTER (WHERE p % 11 = 0) FROM f) AS BIGINT) AS distinct_type_count,
       CAST((SELECT count(*) FROM tg) AS BIGINT) AS dependency_count,
       CAST((SELECT count(*) FROM f WHERE p % 3 = 0) AS BIGINT) AS external_dependency_count,
       CAST((SELECT count(*) FROM nodes WHERE dependency_count = 0 AND dependent_count = 0) AS BIGINT) AS orphan_count,
       CAST((SELECT count(*) FROM nodes WHERE dependency_count + dependent_count >= 5) AS BIGINT) AS coupled_count
""")

ORACLES["dep_orphans"] = _java("""
SELECT 'parts' AS repo, file FROM nodes WHERE dependency_count = 0 AND dependent_count = 0
""")

ORACLES["dep_coupled"] = _java("""
SELECT 'parts' AS repo, file, dependency_count, dependent_count,
       dependency_count + dependent_count AS total_coupling
FROM nodes WHERE dependency_count + dependent_count >= 5
""")

# distinct file -> file edges of fx_java
EDGE_CTE = """
, e AS (SELECT DISTINCT s.file AS a, t.file AS b FROM tg JOIN f s ON s.p = tg.p JOIN f t ON t.p = tg.q)
"""

ORACLES["dep_in_cycle"] = _java(EDGE_CTE + """
, reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT DISTINCT 'parts' AS repo, a AS file FROM reach WHERE a = b
""").replace("WITH np AS", "WITH RECURSIVE np AS", 1)

ORACLES["dep_cycles"] = _java(EDGE_CTE + """
, allc AS (
  SELECT [a] AS c FROM e WHERE a = b
  UNION ALL
  SELECT [e1.a, e1.b] FROM e e1 JOIN e e2 ON e2.a = e1.b AND e2.b = e1.a WHERE e1.a < e1.b
  UNION ALL
  SELECT [e1.a, e1.b, e2.b] FROM e e1 JOIN e e2 ON e2.a = e1.b JOIN e e3 ON e3.a = e2.b AND e3.b = e1.a
  WHERE e1.a < e1.b AND e2.b > e1.a AND e2.b <> e1.b)
SELECT 'parts' AS repo, CAST(len(c) AS BIGINT) AS cycle_len, array_to_string(c, ' -> ') AS cycle,
       CAST(i - 1 AS BIGINT) AS pos, c[i] AS file
FROM (SELECT c, unnest(generate_series(1, len(c))) AS i FROM allc)
""")

ORACLES["dep_sample"] = _java(EDGE_CTE + """
, src AS (SELECT a FROM (SELECT DISTINCT a FROM e) ORDER BY a LIMIT 20),
x AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM e WHERE a IN (SELECT a FROM src))
SELECT 'parts' AS repo, a AS source, b AS target FROM x WHERE r <= 5
""")

DISPLAY_CTE = """
, d AS (SELECT a, b,
               regexp_replace(a, '[^A-Za-z0-9_]', '_', 'g') AS src_id,
               regexp_replace(b, '[^A-Za-z0-9_]', '_', 'g') AS dst_id,
               regexp_extract(a, '[^/]*$') AS src_label, regexp_extract(b, '[^/]*$') AS dst_label
        FROM e)
"""

ORACLES["dep_display_edges"] = _java(EDGE_CTE + DISPLAY_CTE + """
SELECT 'parts' AS repo, src_id, src_label, dst_id, dst_label FROM d
""")

ORACLES["dep_export_lines"] = _java(EDGE_CTE + DISPLAY_CTE + """
SELECT 'parts' AS repo, 'mermaid' AS format, 0 AS section, '000000' AS sort_key, 'graph LR' AS line
UNION ALL
SELECT 'parts', 'mermaid', 1, concat(src_id, chr(1), dst_id),
       concat('  ', src_id, '["', src_label, '"] --> ', dst_id, '["', dst_label, '"]') FROM d
UNION ALL SELECT 'parts', 'dot', 0, '000000', 'digraph Dependencies {'
UNION ALL SELECT 'parts', 'dot', 0, '000001', '  rankdir=LR;'
UNION ALL SELECT 'parts', 'dot', 0, '000002', '  node [shape=box, style=rounded];'
UNION ALL SELECT 'parts', 'dot', 0, '000003', ''
UNION ALL
SELECT 'parts', 'dot', 1, file,
       concat('  "', replace(replace(file, '/', '_'), '.', '_'), '" [label="',
              regexp_extract(file, '[^/]*$'), '\\n(com.brand', b, ')"];') FROM f
UNION ALL SELECT 'parts', 'dot', 2, '000000', ''
UNION ALL
SELECT 'parts', 'dot', 3, concat(a, chr(1), b),
       concat('  "', replace(replace(a, '/', '_'), '.', '_'), '" -> "',
              replace(replace(b, '/', '_'), '.', '_'), '";') FROM e
UNION ALL SELECT 'parts', 'dot', 4, '000000', '}'
""")

# ---------------------------------------------------------------- fx_docs
DOCS_CTE = """
WITH dx AS (
  SELECT doc_id AS d, source AS repo, text, lang,
         ['.java','.cs','.vb','.fs','.php','.js','.ts','.html','.json','.YAML','.txt','.min.js'][doc_id % 12 + 1] AS ext12,
         CASE WHEN doc_id % 17 = 0 THEN 'node_modules/' WHEN doc_id % 19 = 0 THEN 'cabin/'
              WHEN doc_id % 23 = 0 THEN 'rebuild/' ELSE '' END AS dir
  FROM documents),
fx AS (
  SELECT d, repo, text, concat(dir, lang, '/doc_', d, ext12) AS relative_path,
         concat('doc_', d, ext12) AS name,
         CASE WHEN ext12 = '.min.js' THEN '.js' ELSE lower(ext12) END AS ext,
         ['java','csharp','vbnet','fsharp','php','javascript','typescript','markup','config','config',
          'unknown','javascript'][d % 12 + 1] AS language,
         CAST(strlen(text) AS BIGINT) AS size_bytes,
         (d % 17 = 0 OR d % 19 = 0 OR d % 23 = 0 OR d % 12 = 11) AS excluded
  FROM dx)
"""


def _docs(sql: str) -> str:
    return DOCS_CTE + sql


ORACLES["src_filter_paths"] = _docs("SELECT repo, relative_path FROM fx WHERE NOT excluded")
ORACLES["src_filter_size"] = _docs("SELECT repo, relative_path, size_bytes FROM fx WHERE size_bytes <= 10485")
ORACLES["src_detect_language"] = _docs("SELECT repo, relative_path, ext, language FROM fx")
ORACLES["src_domains"] = _docs("""
SELECT 'java-only' AS domain, repo, relative_path FROM fx WHERE d % 12 = 0 AND NOT excluded
UNION ALL
SELECT 'web', repo, relative_path FROM fx WHERE d % 12 IN (5, 6, 7, 11) AND d % 17 <> 0
""")
ORACLES["src_drop_unsupported"] = _docs("SELECT repo, relative_path, language FROM fx WHERE language <> 'unknown'")
ORACLES["src_read_tree"] = _docs("""
SELECT 'corpus' AS repo, concat(repo, '/main/', relative_path) AS relative_path, language, size_bytes,
       md5(text) AS content_md5
FROM fx WHERE NOT excluded AND language <> 'unknown'
""")
ORACLES["src_read_one"] = _docs("""
SELECT name, language, size_bytes, md5(text) AS content_md5 FROM fx WHERE NOT excluded
""")
ORACLES["src_repo_snapshots"] = _docs("""
SELECT repo, 'main' AS branch, relative_path, language, size_bytes, md5(text) AS content_md5
FROM fx WHERE NOT excluded AND language <> 'unknown'
""")

# ---------------------------------------------------------------- members (fx_java)
ORACLES["sym_members"] = _java("""
, mi AS (SELECT p, file, unnest(generate_series(0, CAST(p % 4 AS INTEGER) - 1)) AS i FROM f WHERE p % 4 > 0)
SELECT 'parts' AS repo, file, 'java' AS language, 'class' AS type_kind, concat('Part', p) AS type,
       'method' AS member_kind, CAST(i AS BIGINT) AS ord, concat('m', i) AS name,
       concat('public int m', i, '()') AS signature, CAST(NULL AS VARCHAR) AS data_type FROM mi
UNION ALL
SELECT 'parts', file, 'java', 'class', concat('Part', p), 'field', 0, 'size', NULL, 'private int' FROM f
""")

ORACLES["sym_modifiers"] = _java("""
, mi AS (SELECT p, file, unnest(generate_series(0, CAST(p % 4 AS INTEGER) - 1)) AS i FROM f WHERE p % 4 > 0)
SELECT 'parts' AS repo, file, concat('Part', p) AS type, 'type' AS member_kind, concat('Part', p) AS name,
       'public' AS modifier FROM f
UNION ALL SELECT 'parts', file, concat('Part', p), 'method', concat('m', i), 'public' FROM mi
UNION ALL SELECT 'parts', file, concat('Part', p), 'field', 'size', 'private' FROM f
""")

ORACLES["sym_constants"] = _java("""
SELECT 'parts' AS repo, file, concat('Kind', p) AS type, 'enum_constant' AS kind, CAST(0 AS BIGINT) AS ord,
       concat('A', z) AS name FROM f WHERE p % 5 = 0
UNION ALL SELECT 'parts', file, concat('Kind', p), 'enum_constant', 1, 'B' FROM f WHERE p % 5 = 0
UNION ALL SELECT 'parts', file, concat('Kind', p), 'enum_constant', 2, 'C' FROM f WHERE p % 5 = 0
""")

# ---------------------------------------------------------------- fx_node
NODE_CTE = """
WITH nf AS (SELECT s_suppkey AS s, concat('web/src/app/s', s_suppkey, '.component.ts') AS file FROM supplier)
"""
ORACLES["sym_functions"] = NODE_CTE + """
SELECT 'web' AS repo, file, 'typescript' AS language, CAST(0 AS BIGINT) AS ord, concat('load', s) AS name FROM nf
UNION ALL SELECT 'web', file, 'typescript', 1, concat('pick', s) FROM nf
"""
ORACLES["sym_decorators"] = NODE_CTE + """
SELECT 'web' AS repo, file, concat('Supplier', s, 'Component') AS type, 'Component' AS decorator FROM nf
"""

# ---------------------------------------------------------------- fx_mq
MQ_CTE = """
WITH na AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation),
cu AS (SELECT c_custkey AS k, c_nationkey AS n, na.r, concat('node/customer', c_custkey, '.ts') AS file
       FROM customer JOIN na ON na.n = c_nationkey),
su AS (SELECT s_suppkey AS s, s_nationkey AS n, concat('cs/Supplier', s_suppkey, '.cs') AS file FROM supplier),
rg AS (SELECT r_regionkey AS r, concat('infra/region', r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN '.json' ELSE '.yaml' END) AS file
       FROM region)
"""


def _mq(sql: str) -> str:
    return MQ_CTE + sql


ORACLES["mq_candidates"] = _mq("""
SELECT 'mq' AS repo, file, 'config' AS language, 'infra_config' AS source_type FROM rg
UNION ALL SELECT 'mq', file, 'typescript', 'amqplib' FROM cu
UNION ALL SELECT 'mq', file, 'csharp', 'masstransit' FROM su
""")
ORACLES["mq_receive_endpoints"] = _mq("""
SELECT 'mq' AS repo, file, concat('q-nation', n) AS queue, 'consumer' AS role, concat('Supplier', s, 'Consumer') AS party FROM su
""")
ORACLES["mq_messages"] = _mq("""
SELECT 'mq' AS repo, file, 'publish' AS op, concat('Nation', n, 'Audited') AS message FROM su
""")
ORACLES["mq_send_endpoints"] = _mq("""
SELECT 'mq' AS repo, file, concat('queue:q-nation', n) AS endpoint FROM su
""")
ORACLES["mq_consumers"] = _mq("""
SELECT 'mq' AS repo, file, CAST(0 AS BIGINT) AS ord, concat('Supplier', s, 'Consumer') AS consumer,
       concat('Nation', n, 'Changed') AS message FROM su
""")
ORACLES["mq_amqp"] = _mq("""
SELECT 'mq' AS repo, file, 'publish' AS kind, CAST(0 AS BIGINT) AS ord, CAST(NULL AS VARCHAR) AS name,
       CAST(NULL AS VARCHAR) AS type, CAST(NULL AS VARCHAR) AS queue, concat('region', r) AS exchange,
       concat('nation', n) AS routing_key FROM cu
UNION ALL SELECT 'mq', file, 'send_to_queue', 0, NULL, NULL, concat('q-nation', n), NULL, NULL FROM cu WHERE k % 10 = 0
UNION ALL SELECT 'mq', file, 'queue', 0, NULL, NULL, concat('q-nation', n), NULL, NULL FROM cu WHERE k % 25 = 0
UNION ALL SELECT 'mq', file, 'consume', 0, NULL, NULL, concat('q-nation', n), NULL, NULL FROM cu WHERE k % 25 = 0
""")
ORACLES["mq_infra"] = _mq("""
, rq AS (SELECT rg.r, rg.file, na.n, CAST(row_number() OVER (PARTITION BY rg.r ORDER BY na.n) - 1 AS BIGINT) AS ord
         FROM rg JOIN na ON na.r = rg.r)
SELECT 'mq' AS repo, file, 'exchange' AS kind, CAST(0 AS BIGINT) AS ord, concat('region', r) AS name, 'topic' AS type,
       CAST(NULL AS BOOLEAN) AS durable, CAST(NULL AS VARCHAR) AS queue, CAST(NULL AS VARCHAR) AS exchange,
       CAST(NULL AS VARCHAR) AS routing_key FROM rg
UNION ALL SELECT 'mq', file, 'exchange', 1, concat('topic', r), 'topic', NULL, NULL, NULL, NULL FROM rg
UNION ALL SELECT 'mq', file, 'queue', ord, concat('q-nation', n), NULL, true, NULL, NULL, NULL FROM rq
UNION ALL SELECT 'mq', file, 'binding', ord, NULL, NULL, NULL, concat('q-nation', n), concat('region', r),
                 concat('nation', n) FROM rq
""")
ORACLES["mq_flows"] = _mq("""
SELECT 'mq' AS repo, concat('q-nation', n) AS queue, concat('Supplier', s, 'Consumer') AS consumers, '' AS sagas, file FROM su
""")
ORACLES["mq_parties"] = _mq("""
SELECT 'mq' AS repo, concat('Nation', n, 'Audited') AS message, 'service' AS role, file AS party FROM su
UNION ALL SELECT 'mq', concat('Nation', n, 'Changed'), 'consumer', concat('Supplier', s, 'Consumer') FROM su
""")
ORACLES["mq_graph_nodes"] = _mq("""
SELECT DISTINCT * FROM (
SELECT 'mq' AS repo, concat('EX_region', r) AS id, 'exchange' AS kind, concat('Exchange region', r, ' (topic)') AS label FROM rg
UNION ALL SELECT 'mq', concat('EX_topic', r), 'exchange', concat('Exchange topic', r, ' (topic)') FROM rg
UNION ALL SELECT 'mq', concat('Q_q_nation', n), 'queue', concat('Queue q-nation', n) FROM na
UNION ALL SELECT 'mq', concat('S_node_customer', k, '_ts'), 'service', concat('Service ', file) FROM cu
UNION ALL SELECT 'mq', concat('S_cs_Supplier', s, '_cs'), 'service', concat('Service ', file) FROM su
UNION ALL SELECT 'mq', concat('S_Supplier', s, 'Consumer'), 'service', concat('Service Supplier', s, 'Consumer') FROM su
UNION ALL SELECT 'mq', concat('MSG_MSG_Nation', n, 'Audited'), 'message', concat('Message Nation', n, 'Audited') FROM su
UNION ALL SELECT 'mq', concat('MSG_MSG_Nation', n, 'Changed'), 'message', concat('Message Nation', n, 'Changed') FROM su
UNION ALL SELECT 'mq', concat('C_Supplier', s, 'Consumer'), 'consumer', concat('Consumer Supplier', s, 'Consumer') FROM su)
""")
ORACLES["mq_graph_edges"] = _mq("""
SELECT repo, src, dst, kind, count(*) AS n FROM (
SELECT 'mq' AS repo, concat('EX_region', r) AS src, concat('Q_q_nation', n) AS dst, 'binding' AS kind FROM na
UNION ALL SELECT 'mq', concat('S_node_customer', k, '_ts'), concat('EX_region', r), 'publish' FROM cu
UNION ALL SELECT 'mq', concat('S_node_customer', k, '_ts'), concat('Q_q_nation', n), 'send' FROM cu WHERE k % 10 = 0
UNION ALL SELECT 'mq', concat('S_cs_Supplier', s, '_cs'), concat('Q_q_nation', n), 'send' FROM su
UNION ALL SELECT 'mq', concat('Q_q_nation', n), concat('S_node_customer', k, '_ts'), 'consume' FROM cu WHERE k % 25 = 0
UNION ALL SELECT 'mq', concat('Q_q_nation', n), concat('S_Supplier', s, 'Consumer'), 'consume' FROM su
UNION ALL SELECT 'mq', concat('S_cs_Supplier', s, '_cs'), concat('MSG_MSG_Nation', n, 'Audited'), 'message_publish' FROM su
UNION ALL SELECT 'mq', concat('MSG_MSG_Nation', n, 'Changed'), concat('C_Supplier', s, 'Consumer'), 'message_consume' FROM su
) GROUP BY ALL
""")

# ---------------------------------------------------------------- fx_pages / fx_config
PAGES_CTE = """
WITH pg AS (SELECT concat('pages/page_', page_id, '.html') AS file,
                   concat(html, CASE WHEN page_id % 5 = 0 THEN '<x-card>' ELSE '' END) AS content FROM pages)
"""
ORACLES["sym_comments"] = PAGES_CTE + """
, cm AS (SELECT file, regexp_extract_all(content, '(?s)<!--(.*?)-->', 1) AS arr FROM pg)
SELECT 'pages' AS repo, file, 'markup' AS language, CAST(ord AS BIGINT) AS ord, text, trim(text) AS clean
FROM (SELECT file, unnest(arr) AS text, unnest(generate_series(0, len(arr) - 1)) AS ord FROM cm)
"""
ORACLES["sym_markup_tags"] = PAGES_CTE + """
, tg AS (SELECT file, regexp_extract_all(content, '<\\s*([a-zA-Z][A-Za-z0-9_-]*)', 1) AS arr FROM pg)
SELECT 'pages' AS repo, file, CAST(ord AS BIGINT) AS ord, tag, tag LIKE '%-%' AS is_custom
FROM (SELECT file, unnest(arr) AS tag, unnest(generate_series(0, len(arr) - 1)) AS ord FROM tg)
"""
ORACLES["sym_config_keys"] = """
SELECT 'conf' AS repo, concat('conf/', event_id, '.json') AS file,
       CASE event_id % 10 WHEN 0 THEN 'yaml' WHEN 1 THEN 'unknown' WHEN 2 THEN 'yaml' ELSE 'json' END AS config_type,
       CAST(CASE WHEN event_id % 10 IN (1, 2, 3) THEN 0 ELSE 1 END AS BIGINT) AS key_count,
       CASE WHEN event_id % 10 IN (1, 2, 3) THEN '' ELSE 'k' END AS keys
FROM events
"""

# ---------------------------------------------------------------- correlation (fx_mq + fx_node)
ORACLES["cor_signals"] = """
SELECT 'mq' AS repo, concat('cs/Supplier', s_suppkey, '.cs') AS file, 'dotnet' AS stack, 'masstransit' AS keyword
FROM supplier
UNION ALL SELECT 'mq', concat('node/customer', c_custkey, '.ts'), 'node', 'amqplib' FROM customer
"""
ORACLES["cor_angular"] = """
SELECT 'web' AS repo, concat('web/src/app/s', s_suppkey, '.component.ts') AS file FROM supplier
"""
ORACLES["cor_summary"] = """
SELECT 'mq' AS repo, CAST((SELECT count(*) FROM supplier) AS BIGINT) AS dotnet_files,
       CAST((SELECT count(*) FROM customer) AS BIGINT) AS node_files, CAST(0 AS BIGINT) AS angular_files,
       true AS detected, 'DOTNET->MQ,NODE->MQ' AS edges
UNION ALL
SELECT 'web', 0, 0, CAST((SELECT count(*) FROM supplier) AS BIGINT), false, 'ANGULAR->MQ'
"""

# ---------------------------------------------------------------- fx_csharp
SHOP_CTE = """
WITH na AS (SELECT n_nationkey AS n, n_regionkey AS r FROM nation),
cu AS (SELECT c_custkey AS k, na.r, c_custkey // 150 AS g,
              concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) AS seg,
              concat('Api/Controllers/Customer', c_custkey, 'Controller.cs') AS file,
              concat('Customer', c_custkey, 'Controller') AS ctl
       FROM customer JOIN na ON na.n = c_nationkey),
od AS (SELECT o_orderkey AS o, cu.k, cu.ctl, concat(cu.seg, cu.g, 'Placed') AS msg, concat('Order', o_orderkey) AS method,
              CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'POST' ELSE 'PUT' END AS verb,
              substr(o_orderpriority, 1, 1) AS pr, concat('api/customer', cu.k, '/order/', o_orderkey) AS route
       FROM orders JOIN cu ON cu.k = o_custkey),
su AS (SELECT s_suppkey AS s, na.r FROM supplier JOIN na ON na.n = s_nationkey),
svc AS (SELECT s, r, s // 10 AS g, concat('Supplier', s, 'Service') AS name, concat('Api/Services/Supplier', s, 'Service.cs') AS file
        FROM su),
cons AS (SELECT s, concat('Supplier', s, 'Consumer') AS name,
                concat(['Automobile','Building','Furniture','Household','Machinery'][s % 5 + 1], s // 10, 'Placed') AS msg,
                s % 2 = 0 AS reads_db, concat('Worker/Supplier', s, 'Consumer.cs') AS file
         FROM su),
st AS (SELECT od.*, CASE pr WHEN '1' THEN concat('Publish/Send ', msg, ' to queue')
                             WHEN '2' THEN 'Insert/Update DB' WHEN '3' THEN 'Generate OrderId'
                             WHEN '4' THEN concat('Publish/Send ', msg, ' to queue') END AS step
       FROM od),
cstep AS (SELECT od.ctl, od.method, cons.file, 0 AS sub, concat('Consumer ', cons.name, ' reads queue') AS step
          FROM od JOIN cons ON cons.msg = od.msg WHERE od.pr IN ('1', '4')
          UNION ALL
          SELECT od.ctl, od.method, cons.file, 1, concat('Consumer ', cons.name, ' reads DB')
          FROM od JOIN cons ON cons.msg = od.msg WHERE od.pr IN ('1', '4') AND cons.reads_db),
flows AS (SELECT ctl, method, CAST(0 AS BIGINT) AS step_ord, step FROM st WHERE step IS NOT NULL
          UNION ALL
          SELECT ctl, method, CAST(row_number() OVER (PARTITION BY ctl, method ORDER BY file, sub) AS BIGINT), step
          FROM cstep),
deps AS (SELECT cu.ctl, svc.name AS dep FROM cu JOIN svc ON svc.r = cu.r AND svc.g = cu.g),
depl AS (SELECT ctl, string_agg(dep, ', ' ORDER BY dep) AS deps, list(dep ORDER BY dep) AS dl FROM deps GROUP BY ctl),
fl AS (SELECT ctl, method, string_agg(step, ' | ' ORDER BY step_ord) AS steps FROM flows GROUP BY ctl, method)
"""


def _shop(sql: str) -> str:
    return SHOP_CTE + sql


ORACLES["cat_classes"] = _shop("""
SELECT 'shop' AS repo, file, ctl AS class FROM cu
UNION ALL SELECT 'shop', file, name FROM svc
UNION ALL SELECT 'shop', file, name FROM cons
""")
ORACLES["cat_controllers"] = _shop("""
SELECT 'shop' AS repo, file, ctl AS controller, concat('api/customer', k) AS route FROM cu
""")
ORACLES["cat_services"] = _shop("SELECT 'shop' AS repo, 'service' AS kind, name FROM svc")
ORACLES["cat_endpoints"] = _shop("SELECT 'shop' AS repo, ctl AS controller, method, verb, route FROM od")
ORACLES["cat_steps"] = _shop("""
SELECT 'shop' AS repo, ctl AS controller, method, CAST(0 AS BIGINT) AS step_ord, step FROM st WHERE step IS NOT NULL
""")
ORACLES["cat_consumers"] = _shop("SELECT 'shop' AS repo, msg AS message, name AS consumer, reads_db FROM cons")
ORACLES["cat_flows"] = _shop("SELECT 'shop' AS repo, ctl AS controller, method, step_ord, step FROM flows")
ORACLES["cat_ctrl_deps"] = _shop("SELECT 'shop' AS repo, ctl AS controller, dep AS dep_class FROM deps")
ORACLES["cat_api_spec"] = _shop("""
SELECT 'shop' AS repo, od.ctl AS controller, od.method, od.verb AS verbs, od.route,
       CASE WHEN depl.deps IS NULL THEN od.ctl ELSE concat(od.ctl, ', ', depl.deps) END AS components,
       coalesce(fl.steps, '') AS steps
FROM od LEFT JOIN depl ON depl.ctl = od.ctl LEFT JOIN fl ON fl.ctl = od.ctl AND fl.method = od.method
""")
ORACLES["cat_sequences"] = _shop("""
, base AS (SELECT od.ctl, od.method, od.verb, od.route, coalesce(depl.dl, []) AS dl, fl.steps
           FROM od LEFT JOIN depl ON depl.ctl = od.ctl LEFT JOIN fl ON fl.ctl = od.ctl AND fl.method = od.method),
rows AS (
  SELECT ctl, method, 0 AS seq, 'Client' AS src, ctl AS dst, concat(verb, ' ', route) AS label FROM base
  UNION ALL
  SELECT ctl, method, 2 * i - 1, ctl, dl[i], 'Call'
  FROM (SELECT ctl, method, dl, unnest(generate_series(1, len(dl))) AS i FROM base)
  UNION ALL
  SELECT ctl, method, 2 * i, dl[i], ctl, 'Result'
  FROM (SELECT ctl, method, dl, unnest(generate_series(1, len(dl))) AS i FROM base)
  UNION ALL
  SELECT ctl, method, 2 * len(dl) + 1, 'Note', ctl, steps FROM base WHERE coalesce(steps, '') <> ''
  UNION ALL
  SELECT ctl, method, 2 * len(dl) + CASE WHEN coalesce(steps, '') <> '' THEN 2 ELSE 1 END, ctl, 'Client', 'Response'
  FROM base)
SELECT 'shop' AS repo, ctl AS controller, method, CAST(seq AS BIGINT) AS seq, src, dst, label FROM rows
""")

# ---------------------------------------------------------------- fx_calls
CALLS_CTE = """
WITH ev AS (SELECT user_id AS u, event_type AS t,
                   lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
tr AS (SELECT DISTINCT u, t, n FROM ev WHERE n IS NOT NULL),
ty AS (SELECT DISTINCT u, t FROM events_t),
fst AS (SELECT u, min(t) AS t0 FROM ty GROUP BY u)
"""
CALLS_CTE = CALLS_CTE.replace("FROM events_t", "FROM (SELECT user_id AS u, event_type AS t FROM events)")


def _calls(sql: str) -> str:
    return CALLS_CTE + sql


def _initcap(x: str) -> str:
    return f"concat(upper(substr({x}, 1, 1)), substr({x}, 2))"


ORACLES["call_edges"] = _calls("""
SELECT 'calls' AS repo, concat('calls/User', u, '.cs') AS file, concat('User', u) AS class, t AS caller, n AS callee,
       CAST(1 AS BIGINT) AS n FROM tr
""")
ORACLES["call_interactions"] = _calls(f"""
SELECT 'calls' AS repo, concat('calls/Flow', tr.u, '.java') AS file,
       CAST(row_number() OVER (PARTITION BY tr.u ORDER BY tr.t, tr.n) - 1 AS BIGINT) AS ord,
       {_initcap('fst.t0')} AS from_class, {_initcap('tr.n')} AS to_class, tr.n AS method
FROM tr JOIN fst ON fst.u = tr.u WHERE tr.n <> fst.t0
""")
ORACLES["call_class_chain"] = _calls(f"""
, o AS (SELECT u, t, row_number() OVER (PARTITION BY u ORDER BY t) - 1 AS i FROM ty)
SELECT 'calls' AS repo, concat('calls/Flow', a.u, '.java') AS file, CAST(a.i AS BIGINT) AS pos,
       {_initcap('a.t')} AS from_class, {_initcap('b.t')} AS to_class, b.t AS method
FROM o a JOIN o b ON b.u = a.u AND b.i = a.i + 1 
""")

# ---------------------------------------------------------------- text preparation
ORACLES["txt_chunks"] = """
WITH d AS (SELECT doc_id, text, length(text) AS n,
                  CASE WHEN length(text) <= 1000 THEN 1 ELSE 1 + CAST(ceil((length(text) - 1000) / 900.0) AS BIGINT) END AS total
           FROM documents),
c AS (SELECT doc_id, text, total, unnest(generate_series(1, total)) AS i FROM d)
SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, CAST(total AS BIGINT) AS chunk_total,
       CAST((i - 1) * 900 AS BIGINT) AS start,
       CASE WHEN total = 1 THEN text ELSE substr(text, CAST((i - 1) * 900 + 1 AS BIGINT), 1000) END AS chunk
FROM c
"""
ORACLES["txt_projects"] = _docs("""
SELECT repo, CASE WHEN relative_path LIKE '%/%' THEN split_part(relative_path, '/', 1) ELSE 'root' END AS project,
       count(*) AS files, sum(size_bytes) AS bytes
FROM fx GROUP BY ALL
""")
ORACLES["txt_summary"] = """
WITH sp AS (SELECT doc_id, text, string_split(text, chr(10)) AS arr FROM documents),
ln AS (SELECT doc_id, unnest(arr) AS line, unnest(generate_series(1, len(arr))) AS i FROM sp),
l2 AS (SELECT doc_id, i, line, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM ln),
l3 AS (SELECT *, ((s LIKE '#%' AND line LIKE '%Technical Documentation%') OR line LIKE '%Generated using%'
                  OR s = '---') AS skip FROM l2),
f AS (SELECT doc_id, min(i) AS f FROM l3 WHERE NOT skip AND s <> '' GROUP BY doc_id),
cut AS (SELECT l3.doc_id, min(i) AS cut FROM l3 JOIN f USING (doc_id)
        WHERE NOT skip AND i >= f.f AND (s = '' OR s LIKE '##%') GROUP BY l3.doc_id),
cand AS (SELECT l3.doc_id, i, s, row_number() OVER (PARTITION BY l3.doc_id ORDER BY i) AS k,
                s LIKE '%.' AS e
         FROM l3 JOIN f USING (doc_id) LEFT JOIN cut USING (doc_id)
         WHERE NOT skip AND s <> '' AND i >= f.f AND i < coalesce(cut.cut, 1e18)),
c2 AS (SELECT *, (e OR coalesce(lag(e, 1) OVER w, false) OR coalesce(lag(e, 2) OVER w, false)) AS e3
       FROM cand WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
stop AS (SELECT doc_id, min(k) AS ks FROM c2 WHERE k >= 4 AND e3 GROUP BY doc_id),
summ AS (SELECT c2.doc_id, trim(string_agg(s, ' ' ORDER BY k)) AS summary FROM c2 LEFT JOIN stop USING (doc_id)
         WHERE k <= coalesce(stop.ks, 1e18) GROUP BY c2.doc_id)
SELECT sp.doc_id,
       CASE WHEN coalesce(sp.text, '') = '' THEN 'No summary available.'
            WHEN length(coalesce(summ.summary, '')) < 50 THEN
              concat('This documentation covers ', (length(sp.text) - length(replace(sp.text, '### ', ''))) // 4,
                     ' source file(s) ', 'The documentation includes detailed explanations of classes, methods, and code structure.')
            ELSE summ.summary END AS summary
FROM sp LEFT JOIN summ USING (doc_id)
"""
ORACLES["txt_metrics"] = """
WITH m AS (SELECT source AS repo, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars,
                  CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS lines
           FROM documents GROUP BY source)
SELECT repo, documents, chars, lines,
       CASE WHEN chars < 1024 THEN printf('%.1f B', chars::DOUBLE)
            WHEN chars < 1024 * 1024 THEN printf('%.1f KB', chars / 1024.0)
            WHEN chars < 1024 * 1024 * 1024 THEN printf('%.1f MB', chars / 1048576.0)
            ELSE printf('%.1f GB', chars / 1073741824.0) END AS size
FROM m
"""

# ---------------------------------------------------------------- reports
ORACLES["rep_languages"] = _docs("""
SELECT repo, language, count(*) AS files FROM fx GROUP BY ROLLUP (repo, language)
""")
ORACLES["rep_structure"] = _java("""
SELECT 'parts' AS repo, f.file, 'java' AS language,
       CAST(1 AS BIGINT) AS class_count, CAST(CASE WHEN f.p % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS interface_count,
       CAST(CASE WHEN f.p % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS enum_count,
       CAST(0 AS BIGINT) AS struct_count, CAST(0 AS BIGINT) AS type_count, CAST(0 AS BIGINT) AS record_count,
       CAST(0 AS BIGINT) AS module_count, CAST(0 AS BIGINT) AS trait_count,
       CAST(coalesce(o.c, 0) + CASE WHEN f.p % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS import_count,
       CAST(0 AS BIGINT) AS function_count, CAST(0 AS BIGINT) AS comment_count,
       CAST(0 AS BIGINT) AS config_key_count, CAST(0 AS BIGINT) AS custom_element_count
FROM f LEFT JOIN deg_out o ON o.p = f.p
""")
ORACLES["rep_errors"] = """
SELECT CAST(NULL AS VARCHAR) AS repo, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS stage,
       CAST(NULL AS VARCHAR) AS error WHERE false
"""

# ---------------------------------------------------------------- streaming (same rows as batch)
ORACLES["str_files"] = ORACLES["src_read_tree"]
ORACLES["str_symbols"] = ORACLES["mq_consumers"]
ORACLES["str_totals"] = _docs("""
SELECT language, count(*) AS files FROM fx WHERE NOT excluded AND language <> 'unknown' GROUP BY language
""")
ORACLES["str_latest"] = """
SELECT user_id, max(event_id) AS event_id, arg_max(ts, event_id) AS ts, arg_max(event_type, event_id) AS event_type
FROM events GROUP BY user_id
"""
ORACLES["str_finalize"] = ORACLES["mq_graph_edges"]
ORACLES["str_summary"] = """
SELECT CAST((SELECT count(*) FROM region) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS BIGINT) AS files,
       'config, csharp, typescript' AS languages
"""

# ---------------------------------------------------------------- extension points
ORACLES["udf_language"] = _docs("""
SELECT repo, relative_path AS file, 'prose' AS language, nullif(regexp_extract(text, '^(\\S+)', 1), '') AS namespace
FROM fx WHERE d % 12 = 10
""")
ORACLES["udf_generate"] = _docs("""
SELECT repo, relative_path AS file, md5(concat('Document the file ', relative_path, ':', chr(10), text)) AS response
FROM fx
""")
ORACLES["udf_source"] = """
SELECT source AS repo, 'unknown' AS language, count(*) AS files FROM documents GROUP BY source
"""

ORACLES["txt_prompts"] = _java("""
, il AS (SELECT tg.p, string_agg(concat('- com.brand', tg.q % 25, '.Part', tg.q), chr(10) ORDER BY tg.q) AS lst
         FROM tg GROUP BY tg.p),
imps AS (SELECT f.p, CASE WHEN il.lst IS NULL AND f.p % 3 <> 0 THEN NULL
                          WHEN il.lst IS NULL THEN '- java.util.List'
                          WHEN f.p % 3 = 0 THEN concat(il.lst, chr(10), '- java.util.List') ELSE il.lst END AS lst
         FROM f LEFT JOIN il ON il.p = f.p)
SELECT 'parts' AS repo, f.file, CAST(1 AS BIGINT) AS chunk,
       concat('You are a technical documentation expert. Generate comprehensive, well-structured technical documentation for java source code.', chr(10), chr(10),
              'Your documentation should include:', chr(10), '1. Overview and purpose', chr(10), '2. Architecture and structure', chr(10),
              '3. Key components (classes, functions, interfaces)', chr(10), '4. Usage examples', chr(10), '5. API documentation', chr(10),
              '6. Dependencies and imports', chr(10), chr(10),
              'Format the output in clear, professional markdown with proper headings, code blocks, and explanations.') AS system_prompt,
       concat('Generate technical documentation for the following java code:', chr(10), chr(10),
              'Package: com.brand', f.b, chr(10), chr(10),
              CASE WHEN imps.lst IS NULL THEN '' ELSE concat('Imports:', chr(10), imps.lst, chr(10), chr(10)) END,
              'Classes:', chr(10), chr(10), '- Part', f.p, ' extends Base', f.b, ' implements Sized, Item', f.z, chr(10),
              '  Methods: ', f.p % 4, chr(10), '  Fields: 1', chr(10), chr(10),
              CASE WHEN f.p % 11 = 0 THEN concat('Interfaces:', chr(10), '- IPart', f.p, chr(10), chr(10)) ELSE '' END,
              CASE WHEN f.p % 5 = 0 THEN concat('Enums:', chr(10), '- Kind', f.p, chr(10), chr(10)) ELSE '' END,
              chr(10), 'Please generate comprehensive technical documentation for this code.') AS user_prompt
FROM f JOIN imps ON imps.p = f.p
""")

ORACLES["txt_context"] = _docs("""
, g AS (SELECT repo, relative_path, text,
               CASE WHEN relative_path LIKE '%/%' THEN split_part(relative_path, '/', 1) ELSE 'root' END AS project FROM fx)
SELECT DISTINCT repo, 0 AS section, '' AS sort_key, concat('## Project Structure', chr(10)) AS line FROM g
UNION ALL SELECT DISTINCT repo, 1, concat(project, chr(0)), concat(chr(10), '### ', project, chr(10)) FROM g
UNION ALL SELECT repo, 1, concat(project, chr(0), relative_path), concat('- ', relative_path) FROM g
UNION ALL SELECT DISTINCT repo, 2, '', concat(chr(10), chr(10), '## File Contents', chr(10)) FROM g
UNION ALL SELECT repo, 3, relative_path,
       concat(chr(10), '### ', relative_path, chr(10), '```', chr(10),
              text,
              chr(10), '```', chr(10)) FROM g
""")

ORACLES["txt_attach"] = """
WITH p AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'),
r AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant'),
j AS (SELECT p.conv_id, p.turn, coalesce(r.text, '*Error generating content: no response*') AS doc,
             row_number() OVER (PARTITION BY p.conv_id ORDER BY p.turn) AS i,
             count(*) OVER (PARTITION BY p.conv_id) AS n
      FROM p LEFT JOIN r ON r.conv_id = p.conv_id AND r.turn = p.turn)
SELECT conv_id, CAST(max(n) AS BIGINT) AS chunk_total,
       string_agg(CASE WHEN n = 1 THEN doc ELSE concat('#### Chunk ', i, '/', n, chr(10), chr(10), doc) END, concat(chr(10), chr(10)) ORDER BY i)
         AS documentation
FROM j GROUP BY conv_id
"""


def _section_prompts_sql() -> str:
    from ..operators.textprep import sections_rows
    from .registry import ARCHITECTURE_STRUCTURE

    def q(x):
        return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"
    rows = [r for r in sections_rows(ARCHITECTURE_STRUCTURE) if r[5]]
    values = ", ".join(f"({q(a)}, {q(b)}, {q(c)}, {d}, {q(e)}, {q(p)})" for a, b, c, d, e, p in rows)
    return f"""
WITH ctxrows AS ({ORACLES["txt_context"]}),
budget AS (SELECT repo, CAST(sum(length(line)) + count(*) - 1 AS BIGINT) AS context_chars FROM ctxrows GROUP BY repo),
sec(structure, section_id, parent_id, ord, title, prompt) AS (VALUES {values})
SELECT b.repo, structure, section_id, CAST(parent_id AS VARCHAR) AS parent_id, CAST(ord AS BIGINT) AS ord, title,
       concat('# Section: ', title, chr(10), chr(10), '## Instructions', chr(10), prompt, chr(10), chr(10),
              '## Codebase Context', chr(10)) AS user_prompt_head, b.context_chars
FROM budget b, sec
"""


ORACLES["txt_section_prompts"] = _section_prompts_sql()


def _section_requests_sql() -> str:
    from ..operators.packing import BUDGET
    return f"""
WITH heads AS ({ORACLES["txt_section_prompts"]}),
ctx AS (SELECT repo, string_agg(line, chr(10) ORDER BY section, sort_key) AS t FROM ({ORACLES["txt_context"]}) GROUP BY repo),
parts AS (SELECT repo, t, CAST(ceil(length(t) / {BUDGET}.0) AS BIGINT) AS n_parts, unnest(range(CAST(ceil(length(t) / {BUDGET}.0) AS BIGINT))) AS part FROM ctx)
SELECT h.repo, structure, section_id, parent_id, ord, title, part, n_parts,
       concat(user_prompt_head, substr(t, part * {BUDGET} + 1, {BUDGET})) AS user_prompt
FROM heads h JOIN parts p ON p.repo = h.repo
"""


ORACLES["txt_section_requests"] = _section_requests_sql()

ORACLES["cat_app_sequence"] = _shop("""
, e5 AS (SELECT od.*, cu.file, row_number() OVER (PARTITION BY cu.k ORDER BY od.o) - 1 AS mo FROM od JOIN cu ON cu.k = od.k),
sdep AS (SELECT ctl, min(dep) AS sd FROM deps WHERE dep LIKE '%Service' OR dep LIKE '%Handler' GROUP BY ctl),
svc1 AS (SELECT min(name) AS service FROM svc),
hasq AS (SELECT count(*) > 0 AS q FROM cstep WHERE sub = 0),
ec AS (SELECT e5.file, e5.mo, e5.ctl, e5.msg, cons.name AS cons,
              row_number() OVER (PARTITION BY e5.file, e5.mo ORDER BY cons.file) AS j
       FROM e5 JOIN cons ON cons.msg = e5.msg WHERE e5.pr IN ('1', '4')),
rows AS (
  SELECT file, mo, 0 AS pos, 'Client' AS src, ctl AS dst, concat(verb, ' ', replace(route, '/', ' ')) AS label FROM e5
  UNION ALL SELECT file, mo, 1, ctl, sd, 'Handle' FROM e5 JOIN sdep USING (ctl)
  UNION ALL SELECT file, mo, 2, sd, ctl, 'Result' FROM e5 JOIN sdep USING (ctl)
  UNION ALL SELECT file, mo, 1, ctl, (SELECT service FROM svc1), 'Handle' FROM e5
            WHERE ctl NOT IN (SELECT ctl FROM sdep) AND (SELECT service FROM svc1) IS NOT NULL
  UNION ALL SELECT file, mo, 2, (SELECT service FROM svc1), ctl, 'Result' FROM e5
            WHERE ctl NOT IN (SELECT ctl FROM sdep) AND (SELECT service FROM svc1) IS NOT NULL
  UNION ALL SELECT file, mo, 3, ctl, 'RabbitMQ', concat('Publish Send ', msg) FROM e5
            WHERE pr IN ('1', '4') AND (SELECT q FROM hasq)
  UNION ALL SELECT file, mo, 3 + j, 'RabbitMQ', cons, concat('Consume ', msg) FROM ec WHERE (SELECT q FROM hasq)
  UNION ALL SELECT file, mo, 1000, ctl, 'Client', 'Response' FROM e5)
SELECT 'shop' AS repo, file, CAST(0 AS BIGINT) AS class_ord, CAST(mo AS BIGINT) AS method_ord,
       CAST(row_number() OVER (PARTITION BY file, mo ORDER BY pos) - 1 AS BIGINT) AS pos, src, dst, label FROM rows
""")

# ---------------------------------------------------------------- T2: fx_java text rebuilt in SQL, chunked, parsed
_MERGE_SQL = _java("""
, il AS (SELECT p, string_agg(concat('import com.brand', q % 25, '.Part', q, ';', chr(10)), '' ORDER BY q) AS imps
         FROM tg GROUP BY p),
mi AS (SELECT p, string_agg(concat('public int m', i, '() { }', chr(10)), '' ORDER BY i) AS ms
       FROM (SELECT p, unnest(generate_series(0, CAST(p % 4 AS INTEGER) - 1)) AS i FROM f WHERE p % 4 > 0) GROUP BY p),
src AS (SELECT f.file, concat('package com.brand', f.b, ';', chr(10), coalesce(il.imps, ''),
                CASE WHEN f.p % 3 = 0 THEN concat('import java.util.List;', chr(10)) ELSE '' END,
                'public class Part', f.p, ' extends Base', f.b, ' implements Sized, Item', f.z, ' {', chr(10),
                'private int size = ', f.z, ';', chr(10), coalesce(mi.ms, ''), '}', chr(10),
                CASE WHEN f.p % 11 = 0 THEN concat('public interface IPart', f.p, ' {', chr(10), '}', chr(10)) ELSE '' END,
                CASE WHEN f.p % 5 = 0 THEN concat('enum Kind', f.p, ' {A', f.z, ',B,C}', chr(10)) ELSE '' END) AS text
        FROM f LEFT JOIN il ON il.p = f.p LEFT JOIN mi ON mi.p = f.p),
ch AS (SELECT file, text, CASE WHEN length(text) <= 120 THEN 1 ELSE 1 + CAST(ceil((length(text) - 120) / 80.0) AS BIGINT) END AS n
       FROM src),
cx AS (SELECT file, i AS chunk_index,
              CASE WHEN n = 1 THEN text ELSE substr(text, CAST((i - 1) * 80 + 1 AS BIGINT), 120) END AS c
       FROM (SELECT file, text, n, unnest(generate_series(1, n)) AS i FROM ch)),
named AS (
  SELECT file, chunk_index, 'class' AS kind, arr FROM (SELECT file, chunk_index, regexp_extract_all(c,
    '(?:public|private|protected|abstract|final|static)?\\s*class\\s+(\\w+)(?:\\s+extends\\s+(\\w+))?(?:\\s+implements\\s+([\\w,\\s]+))?\\s*\\{', 1) AS arr FROM cx)
  UNION ALL
  SELECT file, chunk_index, 'interface', regexp_extract_all(c,
    '(?:public|private|protected)?\\s*interface\\s+(\\w+)(?:\\s+extends\\s+([\\w,\\s]+))?\\s*\\{', 1) FROM cx
  UNION ALL
  SELECT file, chunk_index, 'enum', regexp_extract_all(c, '(?:public|private|protected)?\\s*enum\\s+(\\w+)\\s*\\{', 1) FROM cx),
nrows AS (SELECT file, chunk_index, kind, unnest(arr) AS value, unnest(generate_series(0, len(arr) - 1)) AS ord
          FROM named WHERE len(arr) > 0),
nkeep AS (SELECT * FROM nrows
          WHERE chunk_index = (SELECT min(n2.chunk_index) FROM nrows n2
                               WHERE n2.file = nrows.file AND n2.kind = nrows.kind AND n2.value = nrows.value)),
irows AS (SELECT file, chunk_index, unnest(arr) AS value, unnest(generate_series(0, len(arr) - 1)) AS ord
          FROM (SELECT file, chunk_index, regexp_extract_all(c, 'import\\s+(?:static\\s+)?([\\w.*]+);', 1) AS arr FROM cx)
          WHERE len(arr) > 0),
ikeep AS (SELECT file, chunk_index, value, ord FROM (
            SELECT *, row_number() OVER (PARTITION BY file, value ORDER BY chunk_index, ord) AS r FROM irows) WHERE r = 1)
SELECT 'parts' AS repo, file, CAST(chunk_index AS BIGINT) AS chunk_index, kind, CAST(ord AS BIGINT) AS ord, value FROM nkeep
UNION ALL
SELECT 'parts', file, CAST(chunk_index AS BIGINT), 'import', CAST(ord AS BIGINT), value FROM ikeep
""")
ORACLES["txt_merge"] = _MERGE_SQL

ORACLES["txt_documents"] = _docs("""
, s AS (SELECT repo, language, relative_path FROM fx WHERE language <> 'unknown'),
pl AS (SELECT repo, language, count(*) AS n FROM s GROUP BY repo, language)
SELECT DISTINCT repo, 0 AS section, '' AS sort_key, concat('# ', repo, ' Technical Documentation', chr(10)) AS line FROM s
UNION ALL SELECT repo, 1, language, concat('- ', language, ': ', n, ' file(s)') FROM pl
UNION ALL SELECT repo, 2, concat(language, chr(0)), concat(chr(10), '## ', upper(language), ' Files', chr(10)) FROM pl
UNION ALL SELECT repo, 2, concat(language, chr(0), relative_path), concat('### ', relative_path) FROM s
""")


# ---------------------------------------------------------------- four languages, five repos
LINKS_CTE = r"""
WITH RECURSIVE c AS (SELECT c_custkey AS k, c_nationkey AS n, n_regionkey AS r, c_custkey % 4 AS l,
    concat('region', n_regionkey) AS repo, concat('src/n', c_nationkey, '/C', c_custkey, ['.java', '.cs', '.php', '.vb'][c_custkey % 4 + 1]) AS file,
    ['java', 'csharp', 'php', 'vbnet'][c_custkey % 4 + 1] AS language
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
i AS (SELECT DISTINCT o_custkey AS k, (o_orderkey * 13 + 5) % (SELECT count(*) FROM customer) AS q FROM orders),
-- dotted imports find the class by its full name, PHP classes by their short one; a PHP import finds the first PHP class that its text begins
x AS (SELECT s.repo, s.file, concat('com.n', t.n, '.C', t.k) AS "import", CASE WHEN t.l = 2 THEN 2 ELSE 1 END AS rule, t.file AS target
      FROM i JOIN c s ON s.k = i.k JOIN c t ON t.k = i.q WHERE s.l <> 2 AND s.r = t.r
      UNION ALL
      SELECT s.repo, s.file, concat('com\n', t.n, '\C', t.k), 4, min(u.file)
      FROM i JOIN c s ON s.k = i.k JOIN c t ON t.k = i.q JOIN c u ON u.l = 2 AND u.r = s.r AND u.n = t.n AND starts_with(CAST(u.k AS VARCHAR), CAST(t.k AS VARCHAR))
      WHERE s.l = 2 GROUP BY s.repo, s.file, t.n, t.k),
e AS (SELECT DISTINCT repo, file AS a, target AS b FROM x)
"""

ORACLES["sym_links_types"] = LINKS_CTE + """
SELECT repo, file, language, 'class' AS kind, concat('C', k) AS name, CAST(0 AS BIGINT) AS ord FROM c
"""

ORACLES["sym_links_heritage"] = LINKS_CTE + """
SELECT repo, file, language, 'class' AS kind, concat('C', k) AS type, CASE WHEN l = 1 THEN 'inherits' ELSE 'extends' END AS relation,
       CAST(0 AS BIGINT) AS ord, concat('Base', n) AS parent FROM c WHERE l < 3
UNION ALL SELECT repo, file, language, 'class', concat('C', k), CASE WHEN l = 1 THEN 'inherits' ELSE 'implements' END, 1, 'Sized' FROM c WHERE l < 2
"""

ORACLES["dep_links_resolve"] = LINKS_CTE + """
SELECT repo, file, "import", rule, target FROM x
"""

ORACLES["dep_links_orphans"] = LINKS_CTE + """
SELECT repo, file FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.repo = c.repo AND (e.a = c.file OR e.b = c.file))
"""

_LINKS_REACH = """
, reach AS (SELECT repo, a, b FROM e UNION SELECT r.repo, r.a, e.b FROM reach r JOIN e ON e.repo = r.repo AND e.a = r.b)
"""

ORACLES["dep_links_in_cycle"] = LINKS_CTE + _LINKS_REACH + """
SELECT DISTINCT repo, a AS file FROM reach WHERE a = b
"""

ORACLES["dep_links_components"] = LINKS_CTE + _LINKS_REACH + """
SELECT p.repo, p.a AS file, least(p.a, min(p.b)) AS scc FROM reach p JOIN reach q ON q.repo = p.repo AND q.a = p.b AND q.b = p.a
WHERE p.a <> p.b GROUP BY p.repo, p.a
"""

ORACLES["dep_links_cycles"] = LINKS_CTE + """
, w AS (SELECT repo, a AS s, [a] AS p, a AS x FROM e WHERE a <> b GROUP BY repo, a
        UNION ALL
        SELECT w.repo, w.s, list_append(w.p, e.b), e.b FROM w JOIN e ON e.repo = w.repo AND e.a = w.x
        WHERE e.b > w.s AND NOT list_contains(w.p, e.b) AND len(w.p) < 5),
allc AS (SELECT w.repo, w.p AS c FROM w JOIN e ON e.repo = w.repo AND e.a = w.x AND e.b = w.s WHERE len(w.p) > 1
         UNION ALL SELECT repo, [a] FROM e WHERE a = b)
SELECT repo, CAST(len(c) AS BIGINT) AS cycle_len, array_to_string(c, ' -> ') AS cycle, CAST(i - 1 AS BIGINT) AS pos, c[i] AS file
FROM (SELECT repo, c, unnest(generate_series(1, len(c))) AS i FROM allc)
"""


# ---------------------------------------------------------------- documents as ordered lines
def _heading(rows: str, section: int, *lines: str) -> str:
    """The fixed lines of a section in every repo that has rows in the relation ``rows``."""
    return "".join(f"""
UNION ALL SELECT DISTINCT repo, {section}, '{i:06d}', '{t}' FROM {rows}""" for i, t in enumerate(lines))


ORACLES["dep_links_report"] = LINKS_CTE + r"""
, ext AS (SELECT count(*) AS n, repo FROM (
      SELECT DISTINCT s.repo, s.file, t.n, t.k FROM i JOIN c s ON s.k = i.k JOIN c t ON t.k = i.q
      WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.repo = s.repo AND x.file = s.file
                        AND x."import" = CASE WHEN s.l = 2 THEN concat('com\n', t.n, '\C', t.k) ELSE concat('com.n', t.n, '.C', t.k) END)) GROUP BY repo),
dg AS (SELECT c.repo, c.file, (SELECT count(*) FROM e WHERE e.repo = c.repo AND e.a = c.file) AS o,
              (SELECT count(*) FROM e WHERE e.repo = c.repo AND e.b = c.file) AS n FROM c),
tot AS (SELECT repo, count(*) AS files, CAST(sum(o) AS BIGINT) AS edges, coalesce(max(ext.n), 0) AS external FROM dg LEFT JOIN ext USING (repo) GROUP BY repo),
w AS (SELECT repo, a AS s, [a] AS p, a AS x FROM e WHERE a <> b GROUP BY repo, a
      UNION ALL SELECT w.repo, w.s, list_append(w.p, e.b), e.b FROM w JOIN e ON e.repo = w.repo AND e.a = w.x
      WHERE e.b > w.s AND NOT list_contains(w.p, e.b) AND len(w.p) < 3),
cy AS (SELECT w.repo, w.p AS c FROM w JOIN e ON e.repo = w.repo AND e.a = w.x AND e.b = w.s WHERE len(w.p) > 1
       UNION ALL SELECT repo, [a] FROM e WHERE a = b),
orph AS (SELECT repo, file FROM dg WHERE o = 0 AND n = 0),
coup AS (SELECT * FROM dg WHERE o + n >= 5 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY o + n DESC, file) <= 10),
smp AS (SELECT repo, a, b FROM (SELECT repo, a, b, dense_rank() OVER (PARTITION BY repo ORDER BY a) AS i,
               row_number() OVER (PARTITION BY repo, a ORDER BY b) AS j FROM e) WHERE i <= 20 AND j <= 5),
dr AS (SELECT repo, replace(replace(a, '/', '_'), '.', '_') AS x, replace(replace(b, '/', '_'), '.', '_') AS y,
              regexp_extract(a, '[^/]*$') AS l, regexp_extract(b, '[^/]*$') AS r FROM smp)
SELECT repo, 1 AS section, '0' AS sort_key, concat('**Total Files:** ', files) AS line FROM tot
UNION ALL SELECT repo, 1, '1', concat('**Total Classes:** ', 2 * files) FROM tot
UNION ALL SELECT repo, 1, '2', concat('**Internal Dependencies:** ', edges) FROM tot
UNION ALL SELECT repo, 1, '3', concat('**External Dependencies:** ', external) FROM tot
UNION ALL SELECT repo, 4, concat(lpad(CAST(len(c) AS VARCHAR), 6, '0'), chr(1), array_to_string(c, ' -> ')),
       concat('- ', array_to_string(c, ' → '), ' → ', c[1]) FROM cy
UNION ALL SELECT repo, 7, file, concat('- `', file, '`') FROM orph
UNION ALL SELECT repo, 10, concat(lpad(CAST(1000000000000000 - (o + n) AS VARCHAR), 16, '0'), chr(1), file),
       concat('| `', file, '` | ', o, ' | ', n, ' | ', o + n, ' |') FROM coup
UNION ALL SELECT repo, 13, concat(x, chr(1), y), concat('  ', x, '["', l, '"] --> ', y, '["', r, '"]') FROM dr
""" + (_heading("tot", 0, "# Dependency Map Analysis", "") + _heading("tot", 2, "")
       + _heading("cy", 3, "## Circular Dependencies", "") + _heading("cy", 5, "")
       + _heading("orph", 6, "## Orphaned Files", "", "Files with no dependencies:", "") + _heading("orph", 8, "")
       + _heading("coup", 9, "## Highly Coupled Files", "", "| File | Dependencies | Dependents | Total Coupling |", "|---|---|---|---|")
       + _heading("coup", 11, "") + _heading("dr", 12, "## Dependency Graph", "", "```mermaid", "graph TD") + _heading("dr", 14, "```"))

ORACLES["dep_links_json"] = LINKS_CTE + r"""
, dg AS (SELECT c.repo, c.file, (SELECT count(*) FROM e WHERE e.repo = c.repo AND e.a = c.file) AS o,
              (SELECT count(*) FROM e WHERE e.repo = c.repo AND e.b = c.file) AS n FROM c),
im AS (SELECT DISTINCT s.repo, s.file, CASE WHEN s.l = 2 THEN concat('com\n', t.n, '\C', t.k) ELSE concat('com.n', t.n, '.C', t.k) END AS m
       FROM i JOIN c s ON s.k = i.k JOIN c t ON t.k = i.q),
j AS (SELECT repo, 0 AS section, concat('{"table":"nodes","file":"', file, '","dependency_count":', o, ',"dependent_count":', n, '}') AS line FROM dg
      UNION ALL SELECT repo, 1, concat('{"table":"edges","source":"', a, '","target":"', b, '","type":"internal"}') FROM e
      UNION ALL SELECT repo, 2, concat('{"table":"external","file":"', file, '","import":"', replace(m, '\', '\\'), '"}') FROM im
                WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.repo = im.repo AND x.file = im.file AND x."import" = im.m)
      UNION ALL SELECT repo, 3, concat('{"table":"orphans","file":"', file, '"}') FROM dg WHERE o = 0 AND n = 0)
SELECT repo, section, line AS sort_key, line FROM j
"""

ORACLES["txt_catalog_document"] = _shop("""
, ep AS (SELECT 'shop' AS repo, od.ctl, od.method, od.verb, od.route, CASE WHEN depl.deps IS NULL THEN od.ctl ELSE concat(od.ctl, ', ', depl.deps) END AS comps,
                concat(od.ctl, chr(1), od.method) AS k FROM od LEFT JOIN depl ON depl.ctl = od.ctl),
ct AS (SELECT 'shop' AS repo, * FROM cu), sv AS (SELECT 'shop' AS repo, name FROM svc)
SELECT repo, 1 AS section, concat(ctl, chr(1), file) AS sort_key, concat('- `', ctl, '` (Route: `api/customer', k, '`)') AS line FROM ct
UNION ALL SELECT repo, 4, k, concat('| `', ctl, '` | `', method, '` | ', verb, ' | `', route, '` |') FROM ep
UNION ALL SELECT repo, 7, concat(k, chr(1)), concat('#### ', verb, ' ', route, ' (', ctl, '.', method, ')') FROM ep
UNION ALL SELECT 'shop', 7, concat(ctl, chr(1), method, chr(1), lpad(CAST(step_ord AS VARCHAR), 9, '0')), concat('- ', step) FROM flows
UNION ALL SELECT repo, 7, concat(k, chr(1), '0'), '- No flow steps detected.' FROM ep
          WHERE NOT EXISTS (SELECT 1 FROM flows WHERE flows.ctl = ep.ctl AND flows.method = ep.method)
UNION ALL SELECT repo, 10, name, concat('- `', name, '`') FROM sv
UNION ALL SELECT repo, 16, k, concat('| ', verb, ' | `', route, '` | `', ctl, '.', method, '` | ', comps, ' |') FROM ep
""" + (_heading("ct", 0, "## Service Catalog", "", "### Controllers", "") + _heading("ct", 2, "")
       + _heading("ep", 3, "### Endpoints", "", "| Controller | Method | HTTP | Route |", "|---|---|---|---|") + _heading("ep", 5, "")
       + _heading("ep", 6, "### Endpoint Flow Details", "") + _heading("ep", 8, "")
       + _heading("sv", 9, "### Services / Repositories", "") + _heading("sv", 11, "")
       + _heading("ep", 15, "## API Specifications", "", "| HTTP | Route | Controller.Method | Components/Services |", "|---|---|---|---|")))

ORACLES["src_read_rejected"] = _docs("""
SELECT 'corpus' AS repo, concat(repo, '/main/', relative_path) AS relative_path, size_bytes,
       CASE WHEN language = 'unknown' THEN 'extension' WHEN excluded THEN 'excluded' ELSE 'oversized' END AS reason
FROM fx WHERE language = 'unknown' OR excluded OR size_bytes > 10485
""")

ORACLES["txt_context_catalog"] = _shop("""
, ends AS (SELECT od.*, cu.file, row_number() OVER (PARTITION BY cu.k ORDER BY od.o) - 1 AS mo FROM od JOIN cu ON cu.k = od.k),
mq AS (SELECT concat('q-nation', s_nationkey) AS q, s_suppkey AS s FROM supplier),
heads(of, section, line) AS (VALUES ('c', 4, concat(chr(10), '## Service Catalog', chr(10))), ('c', 5, concat('### Controllers', chr(10))),
  ('e', 7, concat(chr(10), '### Endpoints', chr(10))), ('s', 9, concat(chr(10), '### Services'))),
has AS (SELECT 'c' AS of FROM cu UNION SELECT 'e' FROM od UNION SELECT 's' FROM svc)
SELECT 'shop' AS repo, section, CASE WHEN section = 4 THEN '' ELSE '000000' END AS sort_key, line FROM heads JOIN has USING (of)
UNION ALL SELECT 'shop', 6, concat(file, chr(1), ctl), concat('- ', ctl, ' (Route: api/customer', k, ')') FROM cu
UNION ALL SELECT 'shop', 8, concat(file, chr(1), '000000000', chr(1), lpad(CAST(mo AS VARCHAR), 9, '0')), concat('- ', verb, ' ', route, ' -> ', ctl, '.', method) FROM ends
UNION ALL SELECT DISTINCT 'shop', 10, name, concat('- ', name) FROM svc
UNION ALL SELECT DISTINCT 'mq', 13, '000000', concat(chr(10), '## Messaging Flows', chr(10)) FROM mq
UNION ALL SELECT 'mq', 14, concat(q, chr(1), 'cs/Supplier', s, '.cs'), concat('- Queue: ', q, ' -> Consumers: Supplier', s, 'Consumer') FROM mq
""")

ORACLES["txt_file_document"] = f"""
WITH st AS (SELECT repo, file, language, class_count AS c, interface_count AS i, enum_count AS e, import_count AS m, function_count AS f, type_count AS t
            FROM ({ORACLES["rep_structure"]})
            UNION ALL SELECT repo, file, language, CASE language WHEN 'csharp' THEN 1 ELSE 0 END, 0, 0, CASE language WHEN 'config' THEN 0 ELSE 1 END, 0, 0
            FROM ({ORACLES["mq_candidates"]})),
pl AS (SELECT repo, language, count(*) AS n FROM st GROUP BY repo, language),
tot AS (SELECT repo, sum(n) AS n, string_agg(language, ', ' ORDER BY language) AS l FROM pl GROUP BY repo),
own AS (SELECT st.*, concat(language, chr(1), file, chr(1)) AS k FROM st),
num AS (SELECT repo, k, unnest([4, 5, 6, 7, 8, 9]) AS part, unnest(['Classes', 'Interfaces', 'Functions', 'Enums', 'Types', 'Imports']) AS label,
               unnest([c, i, f, e, t, m]) AS n FROM own),
fact AS (SELECT repo, file, 12 AS part, queue AS k, concat('- Queue `', queue, '` -> Consumers: ', consumers, '; Sagas: N/A') AS line FROM ({ORACLES["mq_flows"]})
         UNION ALL SELECT repo, file, 13, message, concat('- Publishes: ', message) FROM ({ORACLES["mq_messages"]})
         UNION ALL SELECT repo, file, 15, endpoint, concat('- Send Endpoint: ', endpoint) FROM ({ORACLES["mq_send_endpoints"]})
         UNION ALL SELECT repo, file, 16, lpad(CAST(ord AS VARCHAR), 9, '0'), concat('- Consumer: ', consumer, '(', message, ')') FROM ({ORACLES["mq_consumers"]})),
told AS (SELECT * FROM fact UNION ALL SELECT DISTINCT repo, file, 11, '', concat(chr(10), '#### Messaging Flows', chr(10)) FROM fact)
SELECT repo, 0 AS section, '' AS sort_key, concat('# ', repo, ' Technical Documentation', chr(10)) AS line FROM tot
UNION ALL SELECT repo, 1, language, concat('- ', language, ': ', n, ' file(s)') FROM pl
UNION ALL SELECT repo, 2, concat(language, chr(1)), concat(chr(10), '## ', upper(language), ' Files', chr(10)) FROM pl
UNION ALL SELECT repo, 3, '0', concat('## Summary', chr(10)) FROM tot
UNION ALL SELECT repo, 3, '1', concat('- Total files processed: ', n) FROM tot
UNION ALL SELECT repo, 3, '2', concat('- Languages: ', l, chr(10)) FROM tot
UNION ALL SELECT repo, 3, '3', concat('---', chr(10)) FROM tot
UNION ALL SELECT repo, 3, '4', '*This documentation was automatically generated.*' FROM tot
UNION ALL SELECT repo, 2, concat(k, '00'), concat('### ', list_extract(string_split(file, '/'), -1), ' (', upper(language), ')', chr(10)) FROM own
UNION ALL SELECT repo, 2, concat(k, '01'), concat('**Path:** `', file, '`', chr(10)) FROM own
UNION ALL SELECT repo, 2, concat(k, '02'), concat(CASE language WHEN 'config' THEN '*Error generating content: no response*'
                                                  ELSE md5(concat('Document the file ', file)) END, chr(10)) FROM own
UNION ALL SELECT repo, 2, concat(k, '03'), concat('#### Code Structure', chr(10)) FROM own WHERE c + i + f + e + t + m > 0
UNION ALL SELECT repo, 2, concat(k, lpad(CAST(part AS VARCHAR), 2, '0')), concat('- ', label, ': ', n) FROM num WHERE n > 0
UNION ALL SELECT repo, 2, concat(k, '20'), concat(chr(10), '---', chr(10)) FROM own
UNION ALL SELECT own.repo, 2, concat(own.k, part, chr(1), told.k), line FROM told JOIN own ON own.repo = told.repo AND own.file = told.file
"""
