"""The same queries in DuckDB SQL, written on their own; adapters are stated again as common table expressions."""

from __future__ import annotations

NL = "chr(10)"
LOGS = """ev AS (SELECT user_id AS id, ts, event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
er AS (SELECT *, (CASE WHEN event_type = 'error' THEN 'skip ' ELSE '' END) || 'worker ' || id || ' processed item ' || k || ' at ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') AS line FROM ev),
logs AS (SELECT id, string_agg(line, chr(10) ORDER BY ts, event_id) AS text FROM er GROUP BY id)"""
FACTS = """fa AS (SELECT 's' || user_id AS session_id, ts::DATE AS day, ts, event_type AS tool, 'cmd' || (json_extract_string(props, '$.k')::BIGINT % 7) AS command, 'p' || (user_id % 5) AS project,
 json_extract_string(props, '$.k')::BIGINT * 10 + 1000 AS bytes_in, event_id * 7 % 900 + 500 AS bytes_out, 1::BIGINT AS events, event_id FROM events)"""
HISTORY = FACTS + """, hi AS (SELECT day, CASE grouping(tool, command, project) WHEN 3 THEN 'tool' WHEN 5 THEN 'command' ELSE 'project' END AS dim, coalesce(tool, command, project) AS key,
 sum(events)::BIGINT AS events, sum(bytes_in)::BIGINT AS bytes_in, sum(bytes_out)::BIGINT AS bytes_out FROM fa GROUP BY GROUPING SETS ((day, tool), (day, command), (day, project)))"""
DEDUP = """l AS (SELECT doc_id AS id, source, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
k AS (SELECT *, line = '--' OR row_number() OVER (PARTITION BY id, line ORDER BY pos) = 1 AS kept FROM l),
j AS (SELECT id, source, text, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE kept) AS out FROM k GROUP BY id, source, text),
sv AS (SELECT id, source, strlen(text)::BIGINT AS bytes_in, strlen(out)::BIGINT AS bytes_out, text FROM j),
oc AS (SELECT id, source, bytes_in, bytes_out, CASE WHEN length(text) < 500 THEN 'skippedBelowThreshold' WHEN bytes_in = 0 OR bytes_out * 10 > bytes_in * 9 THEN 'skippedPoorRatio' ELSE 'compressed' END AS outcome FROM sv)"""
READS = """rd AS (SELECT 's' || (doc_id // 50) AS session_id, 'f' || (doc_id * 7 % 5) || '.txt' AS path, doc_id AS seq, (doc_id * 13 // 7) % 5 AS step,
 'file ' || (doc_id * 7 % 5) || ' version ' || ((doc_id // 11) % 2) || chr(10) || repeat('x y z' || chr(10), 100) AS content FROM documents),
rf AS (SELECT *, CASE step WHEN 3 THEN 'Edit' WHEN 4 THEN 'Write' ELSE 'Read' END AS op, sha256(content) AS hash, len(string_split(content, chr(10))) AS n_lines, step <> 2 AS ok FROM rd),
rs AS (SELECT *, coalesce(bool_or(ok AND op <> 'Edit') OVER b, false) AS seeded FROM rf WINDOW b AS (PARTITION BY session_id, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rt AS (SELECT *, ok AND (op <> 'Edit' OR seeded) AS touches FROM rs),
rh AS (SELECT *, last_value(CASE WHEN touches THEN hash END IGNORE NULLS) OVER b AS old FROM rt WINDOW b AS (PARTITION BY session_id, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ri AS (SELECT *, op = 'Read' AND touches AND coalesce(hash = old, false) AS hit FROM rh),
rj AS (SELECT *, last_value(CASE WHEN touches AND NOT hit THEN op END IGNORE NULLS) OVER b AS source, last_value(CASE WHEN touches AND NOT hit THEN n_lines END IGNORE NULLS) OVER b AS header_lines
 FROM ri WINDOW b AS (PARTITION BY session_id, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
GREP = """g0 AS (SELECT doc_id AS id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS body, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
g1 AS (SELECT id, n, source || '/f' || (n // 5) || '.txt:' || n || ':' || body AS line FROM g0),
gr AS (SELECT id, n * 3 AS pos, line FROM g1 UNION ALL SELECT id, n * 3 + 1, line FROM g1 WHERE n % 5 = 0 UNION ALL SELECT id, n * 3 + 2, '--' FROM g1 WHERE n % 7 = 6),
gk AS (SELECT *, line = '--' OR row_number() OVER (PARTITION BY id, line ORDER BY pos) = 1 AS kept FROM gr)"""
ARRAYS = """ja AS (SELECT 's' || l_suppkey AS id, l_orderkey AS a, l_linenumber AS b, '{"order": ' || l_orderkey || ', "line": ' || l_linenumber || ', "flag": "' || l_returnflag || '"}' AS line,
 '{"order":' || l_orderkey || ',"line":' || l_linenumber || ',"flag":"' || l_returnflag || '"}' AS small FROM lineitem
 UNION ALL SELECT 'c' || o_custkey, o_orderkey, 0, '{"order": ' || o_orderkey || '}', '{"order":' || o_orderkey || '}' FROM orders),
jt AS (SELECT id, count(*) AS n, list(small ORDER BY a, b, line) AS smalls FROM ja GROUP BY id)"""
CHAIN = LOGS + """, isl AS (SELECT *, event_type = 'error' AS skip, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS pos, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY id, event_type = 'error' ORDER BY ts, event_id) AS g FROM er),
cl AS (SELECT *, count(*) OVER (PARTITION BY id, skip, g) AS n, row_number() OVER (PARTITION BY id, skip, g ORDER BY pos) AS nth FROM isl),
sm AS (SELECT id, string_agg(CASE WHEN n >= 4 AND nth = 2 THEN '[skein: ' || (n - 1) || ' more similar lines collapsed]' ELSE line END, chr(10) ORDER BY pos) AS small FROM cl WHERE n < 4 OR nth <= 2 GROUP BY id),
chained AS (SELECT id, text, replace(text, 'worker', chr(27) || '[32mworker' || chr(27) || '[0m') AS whole, small, strlen(small) * 10 < strlen(replace(text, 'worker', chr(27) || '[32mworker' || chr(27) || '[0m')) AS restored FROM logs JOIN sm USING (id))"""
PARTS = "p AS (SELECT p_partkey AS key FROM part)"
RUNNER = PARTS + """, rl AS (SELECT key % 30 AS id, key, CASE WHEN key % 5 = 0 THEN 'PASS src/t' || key WHEN key % 47 = 3 THEN 'Tests  ' || key || ' passed' ELSE 'running case ' || key END AS line FROM p),
rx AS (SELECT id, string_agg(line, chr(10) ORDER BY key) AS text FROM rl GROUP BY id)"""
FAILING = """fl AS (SELECT key % 10 AS id, key, CASE WHEN key % 23 = 0 THEN 'FAIL src/t' || key WHEN key % 23 = 10 THEN '    expected ' || key WHEN key % 5 = 0 THEN 'PASS src/t' || key WHEN key % 47 = 3 THEN 'Tests  1 failed, ' || key || ' passed' ELSE 'running case ' || key END AS line FROM p)"""
TALK = """cm AS (SELECT conv_id, turn, role, text, ['npm install', 'git status', 'pytest -q', 'cargo build', 'FOO=1 npx eslint src', 'docker ps', 'pip install x && ls', 'make'][conv_id % 8 + 1] AS command FROM conversations),
fm AS (SELECT *, CASE command WHEN 'pytest -q' THEN 'pytest' WHEN 'FOO=1 npx eslint src' THEN 'npx' WHEN 'pip install x && ls' THEN 'pip install' ELSE command END AS family FROM cm),
pr AS (SELECT 'conv' || r.conv_id AS file, r.turn AS line_no, 'u' || (r.turn - 1) AS use_id, u.command, u.family, strlen(r.text)::BIGINT AS bytes FROM fm r JOIN fm u ON r.conv_id = u.conv_id AND u.turn = r.turn - 1 AND u.role = 'user' WHERE r.role <> 'user')"""


def _section(where: str) -> str:
    return f"WITH {TALK} SELECT family AS command, sum(bytes)::BIGINT AS bytes, floor(sum(bytes) / 3 + 0.5)::BIGINT AS tokens, count(*) AS occurrences FROM pr {where} GROUP BY family ORDER BY tokens DESC, family LIMIT 4"


def _period(dim: str, where: str) -> str:
    return f"""WITH {HISTORY} SELECT key, sum(events)::BIGINT AS events, sum(bytes_in)::BIGINT AS bytes_in, sum(bytes_out)::BIGINT AS bytes_out, sum(bytes_in - bytes_out)::BIGINT AS bytes_saved,
        greatest(0, floor(sum(bytes_in - bytes_out) / 3 + 0.5))::BIGINT AS est_tokens FROM hi WHERE dim = '{dim}' AND {where} GROUP BY key"""


_DAYS = "dr AS (SELECT day, sum(bytes_in)::BIGINT AS bytes_in, sum(bytes_out)::BIGINT AS bytes_out, sum(bytes_in - bytes_out)::BIGINT AS bytes_saved, sum(events)::BIGINT AS events FROM fa GROUP BY day)"
_FP = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
 line, '\\b[0-9a-f]{7,64}\\b', '<hex>', 'gi'), '\\b(?:id|sha|hash)=[0-9a-f]{3,64}\\b', '<id>', 'gi'),
 '\\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\\b', '<uuid>', 'gi'),
 '\\b\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(?:\\.\\d+)?Z?\\b', '<timestamp>', 'g'), '\\b\\d{1,2}:\\d{2}:\\d{2}(?:\\.\\d+)?\\b', '<time>', 'g'),
 '\\b\\d+(?:\\.\\d+)?\\s?(?:ms|s|kB|MB|MiB|KiB|B)\\b', '<num><unit>', 'gi'), '\\b\\d+(?:\\.\\d+)?\\b', '<num>', 'g')"""

ORACLES: dict[str, str] = {
    "doc_line_scan": "SELECT doc_id AS id, len(string_split(text, chr(10))) AS n_lines, len(string_split(text, chr(10))) - 1 AS last_pos FROM documents",
    "doc_nonblank_lines": "SELECT doc_id AS id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) AS n_solid FROM documents",
    "doc_exact_dedup": f"WITH {DEDUP} SELECT id, out AS text FROM j",
    "doc_dedup_savings": f"WITH {DEDUP} SELECT id, bytes_in, bytes_out, outcome FROM oc",
    "savings_by_source_top": f"WITH {DEDUP} SELECT source, count(*) AS events, sum(bytes_in)::BIGINT AS bytes_in, sum(bytes_out)::BIGINT AS bytes_out, sum(bytes_in - bytes_out)::BIGINT AS bytes_saved FROM oc WHERE outcome = 'compressed' GROUP BY source ORDER BY bytes_saved DESC, source LIMIT 10",
    "size_gate": "SELECT doc_id AS id, length(text) AS units FROM documents WHERE length(text) >= 500",
    "ratio_gate": f"WITH {DEDUP} SELECT id, floor((bytes_in - bytes_out) / bytes_in * 100 * 10 + 0.5) / 10 AS percent FROM sv WHERE bytes_in > 0 AND bytes_out * 10 <= bytes_in * 9",
    "outcome_counts": f"WITH {DEDUP} SELECT 'Doc' AS tool, 'scan' AS event, outcome, count(*) AS n FROM (SELECT outcome FROM oc UNION ALL SELECT 'attempted' FROM oc) GROUP BY outcome",
    "dup_document_reads": "WITH h AS (SELECT lang, source, doc_id, sha256(coalesce(text, '')) AS h FROM documents) SELECT lang AS session_id, source AS path, doc_id AS seq, coalesce(h = lag(h) OVER (PARTITION BY lang, source ORDER BY doc_id), false) AS hit, h[1:12] AS hash12 FROM h",
    "head_tail_truncate": """WITH s AS (SELECT doc_id AS id, text, string_split(text, chr(10)) AS ls FROM documents),
        m AS (SELECT *, ls[4:len(ls) - 4] AS mid FROM s), i AS (SELECT *, list_filter(mid, lambda x: regexp_matches(x, '(?i)error|fail|exception|warning|fatal|panic')) AS imp FROM m)
        SELECT id, CASE WHEN length(text) > 800 AND len(ls) > 7 THEN regexp_replace(array_to_string(list_concat(ls[1:3], ['[skein: ' || len(mid) || ' lines omitted]'], CASE WHEN len(imp) > 0 THEN list_concat(['[skein: important omitted lines]'], imp) ELSE [] END, ls[len(ls) - 3:]), chr(10)), '\\n+$', '') ELSE text END AS text FROM i""",
    "read_guard_advice": """WITH s AS (SELECT 'f' || doc_id AS path, strlen(text)::BIGINT AS size, len(string_split(text, chr(10))) AS n_lines FROM documents)
        SELECT path, size, n_lines, false AS capped, floor(size / 3 + 0.5)::BIGINT AS tokens, '[skein: ' || path || ' is ' || n_lines || ' lines (~' || floor(size / 3 + 0.5)::BIGINT || ' tokens); read it with offset/limit]' AS advice FROM s WHERE n_lines > 12""",
    "exact_run_islands": """WITH o AS (SELECT user_id AS id, event_id AS pos, event_type AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
        SELECT id, min(pos) AS first_pos, count(*) AS size, line FROM o GROUP BY id, line, g HAVING count(*) >= 2""",
    "line_fingerprint": f"WITH {LOGS} SELECT event_id, trim({_FP}) AS fp FROM er",
    "doc_fingerprint_counts": f"""WITH l AS (SELECT regexp_replace(unnest(string_split(text, chr(10))), '[^\\x00-\\x7F]', 'x', 'g') AS line FROM documents), n AS (SELECT line FROM l WHERE regexp_matches(line, '[0-9]'))
        SELECT trim({_FP}) AS fp, count(*) AS n FROM n GROUP BY fp""",
    "similar_run_collapse": f"""WITH {LOGS}, fp AS (SELECT *, event_type = 'error' AS skip FROM er),
        isl AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS pos, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY id, skip ORDER BY ts, event_id) AS g FROM fp),
        c AS (SELECT *, count(*) OVER (PARTITION BY id, skip, g) AS n, row_number() OVER (PARTITION BY id, skip, g ORDER BY pos) AS nth FROM isl)
        SELECT id, string_agg(CASE WHEN n >= 4 AND nth = 2 THEN '[skein: ' || (n - 1) || ' more similar lines collapsed]' ELSE line END, chr(10) ORDER BY pos) AS text FROM c WHERE n < 4 OR nth <= 2 GROUP BY id""",
    "strip_ansi": f"WITH {LOGS} SELECT id, text FROM logs",
    "strip_progress": f"""WITH {LOGS}, q AS (SELECT id, ts, event_id, CASE event_id % 4 WHEN 0 THEN 'download ' || k || '%' ELSE line END AS line, event_id % 4 = 0 AND k < 100 AS noise FROM er)
        SELECT id, coalesce(string_agg(line, chr(10) ORDER BY ts, event_id) FILTER (WHERE NOT noise), '') || CASE WHEN count(*) FILTER (WHERE noise) > 0 THEN CASE WHEN count(*) FILTER (WHERE NOT noise) > 0 THEN chr(10) ELSE '' END || '[skein: ' || count(*) FILTER (WHERE noise) || ' progress lines omitted]' ELSE '' END AS text FROM q GROUP BY id""",
    "failure_gate": f"""WITH {RUNNER}, {FAILING}, {LOGS} SELECT id, bool_or(line LIKE 'FAIL %' OR regexp_matches(line, '\\b[1-9][0-9]*\\s+failed')) AS failed FROM fl GROUP BY id
        UNION ALL SELECT id + 1000, false FROM rx UNION ALL SELECT id + 100000, false FROM logs""",
    "test_output_detect": f"""WITH {RUNNER}, {LOGS} SELECT id, count(DISTINCT CASE WHEN line LIKE 'PASS %' THEN line END) >= 2 OR (count(DISTINCT CASE WHEN line LIKE 'PASS %' THEN line END) = 1 AND bool_or(line LIKE 'Tests %')) AS is_test FROM rl GROUP BY id
        UNION ALL SELECT id + 100000, false FROM logs""",
    "test_summary_pass": f"""WITH {RUNNER}, z AS (SELECT id, string_agg(line, chr(10) ORDER BY key) FILTER (WHERE line LIKE 'Tests %') AS kept, count(*) - count(*) FILTER (WHERE line LIKE 'Tests %') AS gone, string_agg(line, chr(10) ORDER BY key) AS text FROM rl GROUP BY id)
        SELECT id, CASE WHEN kept IS NULL THEN text ELSE kept || CASE WHEN gone > 0 THEN chr(10) || '[skein: ' || gone || ' passing test lines omitted]' ELSE '' END END AS text FROM z""",
    "test_summary_fail": f"""WITH {PARTS}, {FAILING}, k AS (SELECT *, lag(line) OVER (PARTITION BY id ORDER BY key) AS before FROM fl),
    m AS (SELECT *, line LIKE 'FAIL %' OR line LIKE 'Tests %' OR (line LIKE '    expected%' AND coalesce(before LIKE 'FAIL %', false)) AS kept FROM k),
    j AS (SELECT id, string_agg(line, chr(10) ORDER BY key) FILTER (WHERE kept) AS text, string_agg(line, chr(10) ORDER BY key) AS whole, count(*) FILTER (WHERE NOT kept) AS gone FROM m GROUP BY id)
    SELECT id, coalesce(text || chr(10), '') || CASE WHEN gone > 0 THEN '[skein: ' || gone || ' test runner lines omitted]' ELSE '' END AS text FROM j""",
    "stacktrace_dedup": f"""WITH {LOGS}, n AS (SELECT *, row_number() OVER (PARTITION BY id, event_type, CASE WHEN event_type = 'error' THEN k % 2 END ORDER BY ts, event_id) AS nth, count(*) OVER (PARTITION BY id, event_type, CASE WHEN event_type = 'error' THEN k % 2 END) AS total FROM er)
        SELECT id, string_agg(CASE WHEN event_type = 'error' THEN 'Traceback (most recent call last):' || chr(10) || '  File "a' || (k % 2) || '.py", line 3' || chr(10) || '    run()' || chr(10) || '[skein: 2 repeated frames]' || chr(10) || 'ValueError: bad ' || (k % 2) || CASE WHEN total > 1 THEN chr(10) || '[skein: stack trace repeated ' || total || ' times]' ELSE '' END ELSE line END, chr(10) ORDER BY ts, event_id) AS text
        FROM n WHERE event_type <> 'error' OR nth = 1 GROUP BY id""",
    "generic_chain": f"""WITH {CHAIN} SELECT id, CASE WHEN restored THEN whole ELSE small END AS reduced, CASE WHEN restored THEN '' WHEN small <> text THEN 'stripAnsi,collapseRepeatedLines' ELSE 'stripAnsi' END AS rules FROM chained""",
    "grep_dedup": f"WITH {GREP} SELECT id, count(*) FILTER (WHERE kept) AS n_kept, count(*) FILTER (WHERE NOT kept) AS n_omitted FROM gk GROUP BY id",
    "grep_match_collapse": f"""WITH {GREP}, s AS (SELECT id, pos, line, CASE WHEN line <> '--' THEN string_split(line, ':')[1] END AS path, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM gk WHERE kept),
        i AS (SELECT *, rn - row_number() OVER (PARTITION BY id, path ORDER BY pos) AS g FROM s),
        c AS (SELECT *, count(*) OVER (PARTITION BY id, path, g) AS n, row_number() OVER (PARTITION BY id, path, g ORDER BY pos) AS nth FROM i),
        parts AS (SELECT id, pos, 0 AS part, line FROM c WHERE path IS NULL OR n <= 3 OR nth <= 3
          UNION ALL SELECT id, min(pos), 1, '... [skein: ' || count(*) || ' more at ' || string_agg(string_split(line, ':')[1] || ':' || string_split(line, ':')[2], ', ' ORDER BY pos) || ']' FROM c WHERE path IS NOT NULL AND n > 3 AND nth > 3 GROUP BY id, path, g
          UNION ALL SELECT id, 2147483647, 2, '... [skein: ' || count(*) || ' duplicate match lines omitted]' FROM gk WHERE NOT kept GROUP BY id)
        SELECT id, string_agg(line, chr(10) ORDER BY pos, part) AS text FROM parts GROUP BY id""",
    "glob_group": """WITH n AS (SELECT lang AS id, doc_id AS pos, lang || '/' || source AS dir, 'd' || doc_id AS base FROM documents UNION ALL SELECT lang || '_flat', doc_id, lang, 'd' || doc_id FROM documents),
        g AS (SELECT id, dir, min(pos) AS pos, list(base ORDER BY pos) AS bs FROM n GROUP BY id, dir)
        SELECT id, string_agg(dir || '/ (' || len(bs) || ' files: ' || array_to_string(bs[1:50], ', ') || CASE WHEN len(bs) > 50 THEN ', ... [skein: ' || (len(bs) - 50) || ' more]' ELSE '' END || ')', chr(10) ORDER BY pos) AS text FROM g GROUP BY id""",
    "array_homogeneous": f"WITH {ARRAYS} SELECT id, n, n > 50 AS homogeneous, CASE WHEN id LIKE 's%' THEN 'flag,line,order' ELSE 'order' END AS keys FROM jt",
    "array_collapse": f"""WITH {ARRAYS} SELECT id, '[' || CASE WHEN n > 50 THEN array_to_string(smalls[1:10], ',') || ',"[skein: ' || (n - 10) || ' more items, same keys: ' || CASE WHEN id LIKE 's%' THEN 'flag,line,order' ELSE 'order' END || ']"' ELSE array_to_string(smalls, ',') END || ']' AS text FROM jt""",
    "json_minify": f"WITH {ARRAYS} SELECT id, '[' || array_to_string(smalls, ',') || ']' AS text FROM jt",
    "base64_truncate": """WITH b AS (SELECT doc_id AS id, repeat('QUJD', (doc_id % 400 + 80)::INT) AS blob FROM documents)
        SELECT id, CASE WHEN id % 2 = 0 THEN 'img ' || ('data:image/png;base64,' || blob)[1:64] || '[skein: ' || (22 + length(blob) - 64) || ' base64 chars omitted] end'
          WHEN length(blob) + 2 >= 1022 THEN 'raw ' || blob[1:64] || '[skein: ' || (length(blob) + 4 - 64) || ' base64 chars omitted] end' ELSE 'raw ' || blob || 'QQ== end' END AS text FROM b""",
    "git_status_counts": """WITH f AS (SELECT s_nationkey AS id, s_suppkey AS pos, [' M', '??', 'A ', 'MM'][s_suppkey % 4 + 1] AS code FROM supplier),
        u AS (SELECT DISTINCT id, pos, unnest(list_distinct(string_split(replace(code, ' ', ''), ''))) AS c FROM f), k AS (SELECT id, c, count(*) AS n, min(pos) AS pos FROM u GROUP BY id, c),
        s AS (SELECT id, string_agg(n || c, ' ' ORDER BY pos) AS counts FROM k GROUP BY id), fs AS (SELECT id, string_agg(code || ' src/s' || pos, chr(10) ORDER BY pos) AS files FROM f GROUP BY id)
        SELECT n_nationkey AS id, 'main...origin/' || lower(n_name) || ' | ' || coalesce(counts || chr(10) || files, 'clean') AS text FROM nation LEFT JOIN s ON id = n_nationkey LEFT JOIN fs ON fs.id = n_nationkey""",
    "git_log_subjects": """WITH c AS (SELECT c_nationkey AS id, c_custkey AS k, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nxt FROM customer)
        SELECT id, k * 5 AS pos, md5(k::VARCHAR) AS hash, CASE WHEN k % 11 <> 0 THEN 'subject ' || k WHEN nxt IS NOT NULL THEN 'commit ' || md5(nxt::VARCHAR) END AS subject FROM c""",
    "git_log_text": """WITH c AS (SELECT c_nationkey AS id, c_custkey AS k, lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nxt FROM customer)
        SELECT id, string_agg(md5(k::VARCHAR) || CASE WHEN k % 11 <> 0 THEN ' subject ' || k WHEN nxt IS NOT NULL THEN ' commit ' || md5(nxt::VARCHAR) ELSE '' END, chr(10) ORDER BY k) AS text FROM c GROUP BY id""",
    "git_diff_context": """WITH b AS (SELECT o_custkey % 40 AS id, o_orderkey AS pos, CASE WHEN o_orderkey % 9 = 0 THEN '+added ' WHEN o_orderkey % 13 = 0 THEN '-removed ' ELSE ' context ' END || o_orderkey AS line, o_orderkey % 9 <> 0 AND o_orderkey % 13 <> 0 AS ctx FROM orders),
        g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) - row_number() OVER (PARTITION BY id, ctx ORDER BY pos) AS g FROM b),
        c AS (SELECT *, count(*) OVER (PARTITION BY id, ctx, g) AS n, row_number() OVER (PARTITION BY id, ctx, g ORDER BY pos) AS nth FROM g),
        s AS (SELECT id, pos, CASE WHEN ctx AND n > 6 AND nth = 4 THEN '... [skein: ' || (n - 6) || ' unchanged context lines omitted]' ELSE line END AS line FROM c WHERE NOT ctx OR n <= 6 OR nth <= 4 OR nth > n - 3)
        SELECT id, 'diff --git a/f' || id || ' b/f' || id || chr(10) || string_agg(line, chr(10) ORDER BY pos) AS text FROM s GROUP BY id""",
    "package_summary": f"""WITH {PARTS}, l AS (SELECT key % 25 AS id, key, CASE WHEN key % 4 = 0 THEN 'npm warn deprecated x' || (key % 3) WHEN key % 50 = 49 THEN 'added ' || key || ' packages in 2s' ELSE 'timing step ' || key END AS line, key % 4 = 0 AS sig, key % 4 <> 0 AND key % 50 = 49 AS su FROM p),
        d AS (SELECT id, line, min(key) AS k, count(*) AS n FROM l WHERE sig GROUP BY id, line),
        w AS (SELECT id, string_agg(line, chr(10) ORDER BY k) AS ws, string_agg('... [skein: ' || (n - 1) || ' duplicate package warnings omitted]', chr(10) ORDER BY k) FILTER (WHERE n > 1) AS ds FROM d GROUP BY id),
        t AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE sig) AS ns, arg_max(line, key) FILTER (WHERE su) AS last FROM l GROUP BY id)
        SELECT t.id, CASE WHEN last IS NOT NULL THEN 'npm install: ' || last || coalesce(chr(10) || ws, '') || coalesce(chr(10) || ds, '') || CASE WHEN n - 1 - ns > 0 THEN chr(10) || '... [skein: ' || (n - 1 - ns) || ' package-manager lines omitted]' ELSE '' END END AS text FROM t LEFT JOIN w ON t.id = w.id""",
    "go_json_summary": f"""WITH {PARTS}, g AS (SELECT key % 50 AS id, bool_or(key % 97 = 0) AS bad, count(*) FILTER (WHERE key % 2 = 0) AS ok, count(DISTINCT key % 4) AS pk FROM p GROUP BY 1)
        SELECT id, CASE WHEN NOT bad THEN 'go test: ok (' || ok || ' tests, ' || pk || ' packages)' END AS text FROM g""",
    "runner_summary": f"WITH {RUNNER} SELECT id, string_agg(line, chr(10) ORDER BY key) FILTER (WHERE line LIKE 'Tests %') AS text FROM rl GROUP BY id",
    "linter_dedup": f"""WITH {PARTS}, l AS (SELECT key % 20 AS id, key AS pos, key % 3 AS f, 'TS' || (key % 2 + 1000) AS rule, key % 5 AS m FROM p WHERE key % 17 <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY id, f, rule, m ORDER BY pos) AS nth, count(*) OVER (PARTITION BY id, f, rule, m) AS total FROM l) SELECT id, pos, rule, nth, total FROM n WHERE nth <= 3""",
    "linter_text": f"""WITH {PARTS}, l AS (SELECT key % 20 AS id, key AS pos, key % 3 AS f, 'TS' || (key % 2 + 1000) AS rule, key % 5 AS m, 'src/a' || (key % 3) || '.ts(' || key || ',1): error TS' || (key % 2 + 1000) || ': message ' || (key % 5) AS line FROM p WHERE key % 17 <> 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY id, f, rule, m ORDER BY pos) AS nth, count(*) OVER (PARTITION BY id, f, rule, m) AS total, min(pos) OVER (PARTITION BY id, f, rule, m) AS first FROM l),
        s AS (SELECT id, 0 AS part, pos, line FROM n WHERE nth <= 3 UNION ALL SELECT id, 1, first, '... [skein: ' || (total - 3) || ' identical diagnostics omitted (' || rule || ')]' FROM n WHERE nth = 1 AND total > 3)
        SELECT id, string_agg(line, chr(10) ORDER BY part, pos) AS text FROM s GROUP BY id""",
    "container_table": """SELECT r_regionkey AS id, 'NAME | STATUS | AGE' || string_agg(chr(10) || n_name || ' | Running | ' || n_nationkey || 'd', '' ORDER BY n_nationkey) AS text FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey""",
    "command_family": f"WITH {TALK} SELECT family, count(*) AS n FROM fm GROUP BY family",
    "command_meta": f"""WITH {TALK} SELECT conv_id, turn, CASE command WHEN 'FOO=1 npx eslint src' THEN 'eslint' WHEN 'pip install x && ls' THEN NULL ELSE string_split(command, ' ')[1] END AS binary,
        CASE command WHEN 'FOO=1 npx eslint src' THEN 'src' WHEN 'pip install x && ls' THEN NULL WHEN 'make' THEN '' ELSE string_split(command, ' ')[2] END AS subcommand FROM cm""",
    "rewrite_command": f"""WITH {TALK}, t(command, rewritten, rewrite_rule) AS (VALUES ('npm install', 'npm install --loglevel=error --no-fund --no-audit', 'npm-quiet'), ('git status', 'git status --porcelain=v1 -b', 'git-status-porcelain'), ('cargo build', 'cargo build --quiet', 'cargo-quiet'))
        SELECT command, rewritten, rewrite_rule, count(*) AS n FROM cm JOIN t USING (command) GROUP BY ALL""",
    "custom_filter": f"""WITH {LOGS}, k AS (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS rn, ts, event_id FROM er WHERE event_type <> 'error'), j AS (SELECT id, string_agg(line, chr(10) ORDER BY rn) AS text FROM k WHERE rn <= 5 GROUP BY id)
        SELECT logs.id, j.text, CASE WHEN j.text IS NOT NULL THEN 'custom:quiet' END AS rule FROM logs LEFT JOIN j ON j.id = logs.id""",
    "ledger_by_tool": f"WITH {FACTS} SELECT tool, sum(events)::BIGINT AS events, sum(bytes_in)::BIGINT AS bytes_in, sum(bytes_out)::BIGINT AS bytes_out, sum(bytes_in - bytes_out)::BIGINT AS bytes_saved FROM fa GROUP BY tool",
    "session_summary": f"""WITH {FACTS}, s AS (SELECT session_id, tool, sum(events)::BIGINT AS events, sum(bytes_in)::BIGINT AS bytes_in, sum(bytes_out)::BIGINT AS bytes_out, sum(bytes_in - bytes_out)::BIGINT AS bytes_saved FROM fa GROUP BY GROUPING SETS ((session_id, tool), (session_id)))
        SELECT *, greatest(0, floor(bytes_saved / 3 + 0.5))::BIGINT AS est_tokens, greatest(0, floor(bytes_saved / 3 + 0.5))::BIGINT / 1e6 * 3 AS est_usd FROM s""",
    "token_cost": f"""WITH {FACTS}, s AS (SELECT tool, sum(bytes_in)::BIGINT AS b, greatest(0, floor(sum(bytes_in - bytes_out) / 3 + 0.5))::BIGINT AS t FROM fa GROUP BY tool)
        SELECT tool, t AS est_tokens, t * 3 AS micro_usd, CASE WHEN b >= 1048576 THEN printf('%.1fMB', b / 1048576) WHEN b >= 1024 THEN printf('%.1fKB', b / 1024) ELSE b || 'B' END AS size_in FROM s""",
    "history_marginals": f"WITH {HISTORY} SELECT * REPLACE (day::VARCHAR AS day) FROM hi",
    "period_daily": _period("tool", "day = DATE '2024-01-30'"),
    "period_weekly": _period("tool", "day >= DATE '2024-01-24'"),
    "period_monthly": _period("project", "strftime(day, '%Y-%m') = '2024-01'"),
    "retention_90d": f"WITH {HISTORY} SELECT dim, count(DISTINCT day) AS days, min(day)::VARCHAR AS first_day, sum(events)::BIGINT AS events FROM hi WHERE day >= DATE '2024-01-16' GROUP BY dim",
    "top_commands": _period("command", "true") + " ORDER BY bytes_saved DESC, key LIMIT 3",
    "day_graph": f"WITH {FACTS}, {_DAYS}, t AS (SELECT day, bytes_saved FROM dr ORDER BY day DESC LIMIT 20) SELECT day::VARCHAR AS day, bytes_saved, repeat('█', greatest(0, floor(bytes_saved / greatest(1, max(bytes_saved) OVER ()) * 20 + 0.5))::INT) AS bar FROM t",
    "csv_days": f"WITH {FACTS}, {_DAYS} SELECT day::VARCHAR AS at, day || ',' || bytes_in || ',' || bytes_out || ',' || bytes_saved || ',' || events AS line FROM dr",
    "project_report": f"""WITH {FACTS}, w AS (SELECT 'project' AS section, project AS key, events, bytes_in, bytes_out FROM fa WHERE project = 'p3' AND day >= DATE '2024-01-24' UNION ALL SELECT 'command', command, events, bytes_in, bytes_out FROM fa WHERE day >= DATE '2024-01-24')
        SELECT section, key, sum(events)::BIGINT AS events, sum(bytes_in)::BIGINT AS bytes_in, sum(bytes_out)::BIGINT AS bytes_out, sum(bytes_in - bytes_out)::BIGINT AS bytes_saved FROM w GROUP BY section, key""",
    "diagnostics_table": f"WITH {FACTS} SELECT tool, project AS event, count(*) AS attempted, count(*) FILTER (WHERE bytes_out <= bytes_in) AS compressed, count(*) FILTER (WHERE bytes_out > bytes_in) AS \"skippedPoorRatio\" FROM fa GROUP BY tool, project",
    "latest_ledger": f"WITH {FACTS} SELECT session_id FROM fa ORDER BY ts DESC, session_id DESC LIMIT 1",
    "status_line": f"""WITH {FACTS}, s AS (SELECT session_id, max(CASE WHEN event_id % 2 = 0 THEN event_id % 97 END) AS ctx, greatest(0, floor(sum(bytes_in - bytes_out) / 3 + 0.5))::BIGINT AS t FROM fa GROUP BY session_id)
        SELECT session_id, concat_ws(' | ', CASE WHEN session_id <> 's1' THEN 'm1' END, CASE WHEN ctx IS NOT NULL THEN 'ctx ' || ctx || '%' END, CASE WHEN t > 0 THEN 'skein -' || CASE WHEN t >= 1000 THEN printf('%.1fk', t / 1000) ELSE t::VARCHAR END || ' tok' END) AS line FROM s""",
    "tee_retention": f"""WITH {FACTS}, r AS (SELECT session_id, 'u' || event_id AS use_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) AS nth FROM fa WHERE event_id % 5 <> 0 AND event_id % 3 > 0)
        SELECT session_id, use_id, nth, session_id || '/' || use_id || '%2Ea%20b.log' AS path FROM r WHERE nth <= 4""",
    "transcript_pairs": f"WITH {TALK} SELECT file, line_no, use_id, command, bytes FROM pr",
    "discover_families": _section(""),
    "discover_sinks": _section(""),
    "discover_opportunities": _section("WHERE family IN ('npm install', 'git status', 'cargo build')"),
    "read_cache_batch": f"""WITH {READS} SELECT session_id, path, seq, op, hit, source, coalesce(header_lines, 0) AS header_lines, CASE WHEN hit THEN 'deduped' WHEN op = 'Edit' AND NOT seeded THEN 'skippedNoPriorRead' WHEN op IN ('Edit', 'Write') THEN 'updated' ELSE 'skippedFirstRead' END AS outcome FROM rj""",
    "read_cache_savings": f"""WITH {READS}, b AS (SELECT CASE WHEN source IN ('Edit', 'Write') THEN 'Edit' ELSE 'Read' END AS bucket, strlen(content) AS i, strlen('[skein: ' || path || ' unchanged since ' || CASE WHEN source IN ('Edit', 'Write') THEN 'your last Edit/Write' ELSE 'previous read' END || ' in this session (' || header_lines || ' lines, sha256:' || hash[1:12] || '); read with offset/limit for the content]') AS o FROM rj WHERE hit)
        SELECT bucket, count(*) AS events, sum(i)::BIGINT AS bytes_in, sum(o)::BIGINT AS bytes_out FROM b GROUP BY bucket""",
    "read_cache_stream_run": f"WITH {READS} SELECT session_id, path, seq, op, hit, source, coalesce(header_lines, 0) AS header_lines FROM rj",
}
