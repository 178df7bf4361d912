"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on views named after the provided tables. Fixture derivations
are written out again here in SQL, independently of the Spark code, so a
mistake on either side shows up as a mismatch.
"""

from __future__ import annotations

import re

from failurelens.operators.cluster import ANCHOR_EXEMPLARS
from failurelens.schemas import CLUSTER_NAMES

NL = "chr(10)"

# ---------------------------------------------------------------------------
# Shared fragments
# ---------------------------------------------------------------------------
EXEC_LOG = f"""
log AS (
  SELECT CAST(user_id AS VARCHAR) AS task_id, event_id AS sample_id,
    CASE WHEN event_type = 'purchase' THEN 'running tests' || {NL} || 'RESULTS: passed=' || CAST(n AS VARCHAR) || ' failed=0 total=' || CAST(n AS VARCHAR)
         WHEN event_type = 'click' THEN 'RESULTS: passed=' || CAST(n - 1 AS VARCHAR) || ' failed=1 total=' || CAST(n AS VARCHAR)
         WHEN event_type = 'view' THEN 'no summary line' || {NL} || 'done'
         WHEN event_type = 'signup' AND event_id % 2 = 1 THEN 'RESULTS: passed=' || CAST(n AS VARCHAR) || ' failed=x total=' || CAST(n AS VARCHAR)
         ELSE '' END AS stdout,
    CASE WHEN event_type = 'click' THEN 'FAIL: assertion failed' || {NL} || 'AssertionError' || {NL}
         WHEN event_type = 'error' THEN 'Traceback (most recent call last):' || {NL} || '  File "solution.py", line ' || CAST(n AS VARCHAR) || {NL}
              || (['SyntaxError', 'NameError', 'TypeError', 'IndexError', 'ZeroDivisionError', 'RecursionError', 'ModuleNotFoundError', 'KeyboardInterrupt'])[event_id % 8 + 1]
              || ': failed on input ' || props
              || CASE WHEN event_id % 3 = 0 THEN {NL} || 'while handling ValueError' ELSE '' END
         ELSE '' END AS stderr,
    CAST(CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'signup' AND event_id % 2 = 0 THEN -9 ELSE 0 END AS INTEGER) AS returncode,
    (event_type = 'signup' AND event_id % 2 = 0) AS timed_out,
    value * 10 AS elapsed_ms,
    CASE WHEN user_id % 2 = 0 THEN 'HumanEval' ELSE 'MBPP' END AS benchmark
  FROM (SELECT *, CAST(floor(value) AS BIGINT) % 4 + 1 AS n FROM events) ev
),
lines AS (
  SELECT *, list_filter(string_split(stdout, {NL}), lambda l: starts_with(l, 'RESULTS:'))[1] AS rline FROM log
),
toks AS (
  SELECT *, CASE WHEN rline IS NULL THEN []::VARCHAR[]
                 ELSE list_filter(regexp_split_to_array(rline, '\\s+'), lambda t: t <> '')[2:] END AS tk FROM lines
),
perr AS (
  SELECT *,
    list_filter(list_transform(tk, lambda t:
      CASE WHEN len(string_split(t, '=')) < 2 THEN 'not enough values to unpack (expected 2, got 1)'
           WHEN len(string_split(t, '=')) > 2 THEN 'too many values to unpack (expected 2)'
           WHEN string_split(t, '=')[1] IN ('passed', 'failed', 'total') AND TRY_CAST(string_split(t, '=')[2] AS BIGINT) IS NULL
             THEN 'invalid literal for int() with base 10: ''' || string_split(t, '=')[2] || ''''
           ELSE NULL END), lambda x: x IS NOT NULL)[1] AS perr_msg,
    coalesce(list_transform(list_filter(tk, lambda t: string_split(t, '=')[1] = 'passed'), lambda t: TRY_CAST(string_split(t, '=')[2] AS BIGINT))[-1], 0) AS p_passed,
    coalesce(list_transform(list_filter(tk, lambda t: string_split(t, '=')[1] = 'failed'), lambda t: TRY_CAST(string_split(t, '=')[2] AS BIGINT))[-1], 0) AS p_failed,
    coalesce(list_transform(list_filter(tk, lambda t: string_split(t, '=')[1] = 'total'), lambda t: TRY_CAST(string_split(t, '=')[2] AS BIGINT))[-1], 0) AS p_total
  FROM toks
),
res0 AS (
  SELECT task_id, sample_id, benchmark, timed_out,
    (NOT timed_out AND perr_msg IS NOT NULL) AS bad, perr_msg, stdout, stderr, returncode, elapsed_ms,
    p_passed, p_failed, p_total,
    (returncode <> 0 AND p_total = 0) AS crashed
  FROM perr
),
results AS (
  SELECT task_id, sample_id, benchmark,
    CASE WHEN timed_out OR bad THEN 0 ELSE p_passed END AS passed,
    CASE WHEN timed_out OR bad THEN 0 WHEN crashed THEN 1 ELSE p_failed END AS failed,
    CASE WHEN timed_out OR bad THEN 0 WHEN crashed THEN 1 ELSE p_total END AS total,
    CASE WHEN timed_out THEN 'Execution timed out after 30 seconds' WHEN bad THEN perr_msg ELSE stderr END AS stderr,
    CASE WHEN timed_out OR bad THEN '' ELSE stdout END AS stdout,
    CASE WHEN timed_out OR bad THEN -1 ELSE returncode END AS returncode,
    timed_out AS timeout,
    CASE WHEN timed_out THEN NULL WHEN bad THEN 'ValueError'
         WHEN contains(stderr, 'SyntaxError') THEN 'SyntaxError'
         WHEN contains(stderr, 'IndentationError') THEN 'IndentationError'
         WHEN contains(stderr, 'NameError') THEN 'NameError'
         WHEN contains(stderr, 'TypeError') THEN 'TypeError'
         WHEN contains(stderr, 'ValueError') THEN 'ValueError'
         WHEN contains(stderr, 'IndexError') THEN 'IndexError'
         WHEN contains(stderr, 'KeyError') THEN 'KeyError'
         WHEN contains(stderr, 'AttributeError') THEN 'AttributeError'
         WHEN contains(stderr, 'ZeroDivisionError') THEN 'ZeroDivisionError'
         WHEN contains(stderr, 'RecursionError') THEN 'RecursionError'
         WHEN contains(stderr, 'MemoryError') THEN 'MemoryError'
         WHEN contains(stderr, 'TimeoutError') THEN 'TimeoutError'
         WHEN contains(stderr, 'RuntimeError') THEN 'RuntimeError'
         WHEN contains(stderr, 'AssertionError') THEN 'AssertionError'
         WHEN contains(stderr, 'ImportError') THEN 'ImportError'
         WHEN stderr <> '' THEN 'UnknownError' ELSE NULL END AS error_type,
    CASE WHEN timed_out OR bad THEN ''
         WHEN strpos(stderr, 'Traceback') > 0 THEN substr(stderr, strpos(stderr, 'Traceback')) ELSE '' END AS traceback,
    elapsed_ms AS execution_time_ms
  FROM res0
),
scored AS (
  SELECT *, (failed = 0 AND passed > 0 AND NOT timeout) AS success FROM results
)"""


def pass_at_k_sql(n: str, c: str, k: int) -> str:
    """pass@k for integer k as a DuckDB expression."""
    if k == 0:
        return "0.0"
    prod = " * ".join(f"(CAST({n} - {c} - {i} AS DOUBLE) / CAST({n} - {i} AS DOUBLE))" for i in range(k))
    return f"CASE WHEN {n} - {c} < {k} THEN 1.0 ELSE 1.0 - ({prod}) END"


def _pass_at_k_metrics() -> str:
    return f"""
WITH {EXEC_LOG.strip()},
counts AS (
  SELECT benchmark, task_id, count(*) AS n, count(*) FILTER (WHERE success) AS c FROM scored GROUP BY benchmark, task_id
),
agg AS (
  SELECT benchmark,
    avg({pass_at_k_sql('n', 'c', 1)}) AS p1,
    avg({pass_at_k_sql('n', 'c', 5)}) AS p5,
    avg({pass_at_k_sql('n', 'c', 10)}) AS p10,
    count(*) AS np
  FROM counts GROUP BY benchmark
)
SELECT benchmark, lower(benchmark) || '/pass@1' AS metric, round(p1, 6) AS value FROM agg
UNION ALL SELECT benchmark, lower(benchmark) || '/pass@5', round(p5, 6) FROM agg
UNION ALL SELECT benchmark, lower(benchmark) || '/pass@10', round(p10, 6) FROM agg
UNION ALL SELECT benchmark, lower(benchmark) || '/num_problems', round(CAST(np AS DOUBLE), 6) FROM agg
"""


def _exec_results() -> str:
    return f"""
WITH {EXEC_LOG.strip()}
SELECT task_id, sample_id, passed, failed, total, stderr, stdout, returncode, timeout, error_type, traceback,
       round(execution_time_ms, 6) AS execution_time_ms, success
FROM scored
"""


ORACLE: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


register("pass_at_k_metrics", _pass_at_k_metrics())
register("exec_results", _exec_results())


# ---------------------------------------------------------------------------
# failure text
# ---------------------------------------------------------------------------
def _failure_text_expr(task_l, tb_l, se_l, code_l) -> str:
    return f"""concat_ws({NL},
        'Task: ' || left(coalesce(task, ''), {task_l}),
        'Error Type: ' || coalesce(nullif(error_type, ''), 'Unknown'),
        CASE WHEN coalesce(traceback, '') <> '' THEN 'Traceback: ' || left(traceback, {tb_l}) END,
        CASE WHEN coalesce(stderr, '') <> '' THEN 'Stderr: ' || left(stderr, {se_l}) END,
        'Code Snippet: ' || left(coalesce(code, ''), {code_l}))"""


FAILURE_TEXT_INPUTS = f"""
ft AS (
  SELECT doc_id, text AS task, text,
    'def solve():' || {NL} || '    return ' || source AS student_code,
    CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN NULL
         ELSE 'def solve():' || {NL} || '    return ''' || lang || '''' END AS repaired_code,
    CASE WHEN lang = 'en' THEN 'TypeError' WHEN lang = 'de' THEN NULL WHEN lang = 'fr' THEN '' ELSE 'ValueError' END AS error_type,
    CASE WHEN n_chars % 2 = 0 THEN '' ELSE 'Error while reading ' || text END AS stderr,
    CASE WHEN lang IN ('en', 'fr') THEN 'Traceback (most recent call last):' || {NL} || text ELSE '' END AS traceback
  FROM documents
),
ft2 AS (SELECT *, coalesce(nullif(repaired_code, ''), student_code) AS code FROM ft)"""

EMBED_PREFIX = "Represent this programming traceback and source code failure for clustering error categories: "

register("failure_text", f"""
WITH {FAILURE_TEXT_INPUTS.strip()}
SELECT doc_id, code AS failing_code,
  {_failure_text_expr(200, 500, 300, 300)} AS failure_text,
  {_failure_text_expr(10, 9, 5, 12)} AS failure_text_short,
  length('{EMBED_PREFIX}' || text) AS embed_input_chars,
  left(sha256('{EMBED_PREFIX}' || text), 16) AS embed_input_fp,
  left(sha256(text), 16) AS text_fingerprint
FROM ft2
""")

#: Texts that the clusters are anchored by (fixed values, as in the library).
ANCHOR_TEXTS = ", ".join("(%d, '%s', '%s')" % (i, name, text.replace("'", "''"))
                         for i, (name, text) in enumerate(zip(CLUSTER_NAMES, ANCHOR_EXEMPLARS, strict=True)))

register("failure_embedding", f"""
WITH {FAILURE_TEXT_INPUTS.strip()},
anchors(idx, name, t) AS (VALUES {ANCHOR_TEXTS}),
texts AS (
  SELECT 'd' AS kind, doc_id AS id, '{EMBED_PREFIX}' || {_failure_text_expr(200, 500, 300, 300)} AS t FROM ft2
  UNION ALL SELECT 'a', idx, '{EMBED_PREFIX}' || t FROM anchors
),
terms AS (SELECT kind, id, md5(lower(unnest(regexp_extract_all(t, '[A-Za-z0-9_]+')))) AS h FROM texts),
sums AS (
  SELECT kind, id, CAST('0x' || substr(h, 1, 6) AS BIGINT) % 256 AS place,
    sum(CASE WHEN substr(h, 7, 1) < '8' THEN 1 ELSE -1 END) AS v
  FROM terms GROUP BY ALL
),
units AS (SELECT kind, id, place, v / sqrt(sum(v * v) OVER (PARTITION BY kind, id)) AS x FROM sums),
dots AS (
  SELECT d.id, a.id AS idx, sum(d.x * a.x) AS sim
  FROM units d JOIN units a ON a.place = d.place AND a.kind = 'a' WHERE d.kind = 'd' GROUP BY ALL
),
scored AS (
  SELECT f.doc_id, a.idx, a.name, coalesce(s.sim, 0) AS sim, max(coalesce(s.sim, 0)) OVER (PARTITION BY f.doc_id) AS best
  FROM ft2 f CROSS JOIN anchors a LEFT JOIN dots s ON s.id = f.doc_id AND s.idx = a.idx
)
SELECT doc_id, name AS cluster_name, round(best, 6) AS similarity FROM scored
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sim < best - 1e-12, idx) = 1
""")

# ---------------------------------------------------------------------------
# failure store
# ---------------------------------------------------------------------------
CLUSTER_LIST = "['Syntax', 'Runtime', 'Logic', 'EdgeCases', 'AlgorithmDesign', 'Efficiency']"

STORE = f"""
{EXEC_LOG.strip()},
batch AS (
  SELECT CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d') AS record_id,
    'task ' || CAST(user_id AS VARCHAR) AS task,
    'def solve(x):' || {NL} || '    return x * ' || printf('%.2f', value) AS code,
    'Traceback (most recent call last):' || {NL} || 'Error ' || props AS traceback,
    ({CLUSTER_LIST})[event_id % 6 + 1] AS failure_cluster,
    event_id % (SELECT count(*) FROM embeddings) AS vid,
    ts AS created_at, event_id AS seq
  FROM events JOIN (SELECT sample_id FROM scored WHERE NOT success) ON sample_id = event_id
),
batch_e AS (
  SELECT b.*, CASE WHEN len(e.embedding) > 0 THEN e.embedding END AS embedding
  FROM batch b LEFT JOIN embeddings e ON e.vec_id = b.vid
),
store AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) AS rn FROM batch_e) WHERE rn = 1
)"""

register("failure_store", f"""
WITH {STORE.strip()}
SELECT record_id, task, code, traceback, failure_cluster,
  strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at, seq, coalesce(len(embedding), 0) AS emb_dim
FROM store
""")

register("failure_counts", f"""
WITH {STORE.strip()},
dim AS (SELECT unnest({CLUSTER_LIST}) AS cluster_name),
cnt AS (SELECT failure_cluster AS cluster_name, count(*) AS n FROM store GROUP BY 1),
j AS (SELECT d.cluster_name, coalesce(c.n, 0) AS total_failures FROM dim d LEFT JOIN cnt c USING (cluster_name)),
tot AS (SELECT sum(total_failures) AS t FROM j)
SELECT cluster_name, total_failures,
  round(CAST(total_failures AS DOUBLE) / CASE WHEN t > 0 THEN t ELSE 1 END, 6) AS failure_rate,
  'stable' AS recent_trend,
  (SELECT count(*) FROM store) AS store_total,
  (SELECT count(*) FROM store WHERE embedding IS NOT NULL) AS with_embedding
FROM j, tot
""")

register("recent_failures_by_cluster", f"""
WITH {STORE.strip()}
SELECT failure_cluster, rank, record_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY failure_cluster ORDER BY created_at DESC, record_id ASC) AS rank FROM store)
WHERE rank <= 100
""")

register("recent_failures", f"""
WITH {STORE.strip()}
SELECT record_id, failure_cluster, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at
FROM store ORDER BY created_at DESC, record_id ASC LIMIT 1000
""")

# ---------------------------------------------------------------------------
# vectors and clustering
# ---------------------------------------------------------------------------
VEC = """
vec AS (SELECT vec_id, vec_id AS seq, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
vnorm AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM vec),
unit AS (SELECT vec_id, seq, label, CASE WHEN nrm > 0 THEN list_transform(e, lambda x: x / nrm) ELSE e END AS u FROM vnorm),
anch_c AS (
  SELECT g AS cluster_idx, i, avg(x) AS x FROM (
    SELECT label % 6 AS g, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM unit) GROUP BY g, i
),
anch_l AS (SELECT cluster_idx, list(x ORDER BY i) AS c FROM anch_c GROUP BY cluster_idx),
anchors AS (
  SELECT cluster_idx, (%CLUSTERS%)[cluster_idx + 1] AS cluster_name,
    list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c
  FROM anch_l
),
scores AS (
  SELECT u.vec_id, u.seq, u.u, a.cluster_idx, a.cluster_name, a.c, list_sum(list_transform(list_zip(u.u, a.c), lambda p: p[1] * p[2])) AS sim
  FROM unit u, anchors a
),
assigned AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cluster_idx ASC) AS rn FROM scores) WHERE rn = 1
)""".replace("%CLUSTERS%", CLUSTER_LIST)

register("cluster_assign", f"""
WITH {VEC.strip()}
SELECT vec_id, cluster_idx, cluster_name, round(sim, 6) AS similarity FROM assigned
""")

register("cluster_stats", f"""
WITH {VEC.strip()},
dim AS (SELECT unnest({CLUSTER_LIST}) AS cluster_name),
cnt AS (SELECT cluster_name, count(*) AS n FROM assigned GROUP BY 1),
j AS (SELECT d.cluster_name, coalesce(c.n, 0) AS total_failures FROM dim d LEFT JOIN cnt c USING (cluster_name)),
tot AS (SELECT sum(total_failures) AS t FROM j)
SELECT cluster_name, total_failures,
  round(CAST(total_failures AS DOUBLE) / CASE WHEN t > 0 THEN t ELSE 1 END, 6) AS failure_rate, 'stable' AS recent_trend
FROM j, tot
""")

register("kmeans_step", f"""
WITH {VEC.strip()},
m AS (
  SELECT cluster_idx, i, avg(x) AS x, count(*) AS n FROM (
    SELECT cluster_idx, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM assigned) GROUP BY cluster_idx, i
),
old AS (SELECT cluster_idx, cluster_name, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM anchors)
SELECT o.cluster_idx, o.cluster_name, coalesce(m.n, 0) AS n_assigned, o.i - 1 AS dim,
  round(coalesce(m.x, o.x), 6) AS value
FROM old o LEFT JOIN m ON m.cluster_idx = o.cluster_idx AND m.i = o.i
""")

register("centroid_ema", f"""
WITH {VEC.strip()},
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_idx ORDER BY seq DESC) - 1 AS r FROM assigned),
cnt AS (SELECT cluster_idx, count(*) AS m FROM assigned GROUP BY 1),
s AS (
  SELECT cluster_idx, i, sum(0.1 * pow(0.9, r) * x) AS sx FROM (
    SELECT cluster_idx, r, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM ranked) GROUP BY cluster_idx, i
),
old AS (SELECT cluster_idx, cluster_name, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM anchors),
moved AS (
  SELECT o.cluster_idx, o.cluster_name, o.i, coalesce(cnt.m, 0) AS m,
    CASE WHEN s.sx IS NULL THEN o.x ELSE pow(0.9, coalesce(cnt.m, 0)) * o.x + s.sx END AS x
  FROM old o LEFT JOIN cnt ON cnt.cluster_idx = o.cluster_idx LEFT JOIN s ON s.cluster_idx = o.cluster_idx AND s.i = o.i
),
nrm AS (SELECT cluster_idx, sqrt(sum(x * x)) AS nn FROM moved GROUP BY 1)
SELECT moved.cluster_idx, cluster_name, m AS n_assigned, i - 1 AS dim,
  round(CASE WHEN nn > 0 THEN x / nn ELSE x END, 6) AS value
FROM moved JOIN nrm USING (cluster_idx)
""")

register("similar_vectors", """
WITH vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
qc AS (
  SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM vec) GROUP BY label, i
),
q AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS qv FROM qc GROUP BY label),
qn AS (SELECT query_id, list_transform(qv, lambda x: x / (sqrt(list_sum(list_transform(qv, lambda y: y * y))) + 1e-8)) AS qv FROM q),
en AS (SELECT vec_id, list_transform(e, lambda x: x / (sqrt(list_sum(list_transform(e, lambda y: y * y))) + 1e-8)) AS ev FROM vec),
sc AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(qv, ev), lambda p: p[1] * p[2])) AS sim FROM qn, en),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id ASC) AS rank FROM sc)
SELECT query_id, vec_id, rank, round(sim, 6) AS similarity FROM rk WHERE rank <= 5
""")
register("similar_vectors_indexed", ORACLE["similar_vectors"])


# ---------------------------------------------------------------------------
# replay buffer and curriculum
# ---------------------------------------------------------------------------
BUFFER = f"""
ex AS (
  SELECT event_id AS seq, 'Problem for user ' || CAST(user_id AS VARCHAR) AS problem,
    CASE WHEN event_id % 5 = 0 THEN '' ELSE 'Use approach ' || props END AS plan,
    'def f(x):' || {NL} || '    return x + ' || printf('%.2f', value) AS failed_code,
    'Root cause: ' || event_type AS repair_reasoning,
    'def f(x):' || {NL} || '    return x - ' || printf('%.2f', value) AS repaired_code,
    CASE lower(trim(CASE event_type WHEN 'click' THEN 'Syntax' WHEN 'error' THEN 'Runtime' WHEN 'view' THEN 'Logic'
                                    WHEN 'purchase' THEN 'EdgeCases' WHEN 'signup' THEN ' efficiency ' END))
      WHEN 'syntax' THEN 'Syntax' WHEN 'runtime' THEN 'Runtime' WHEN 'logic' THEN 'Logic' WHEN 'edgecases' THEN 'EdgeCases'
      WHEN 'algorithmdesign' THEN 'AlgorithmDesign' WHEN 'efficiency' THEN 'Efficiency' ELSE 'Unknown' END AS failure_cluster,
    't' || CAST(event_id AS VARCHAR) AS trajectory_id
  FROM events
),
buf AS (SELECT * FROM ex)"""

STORE_RATES = f"""
{STORE.strip()},
sdim AS (SELECT unnest({CLUSTER_LIST}) AS cluster_name),
scnt AS (SELECT failure_cluster AS cluster_name, count(*) AS n FROM store GROUP BY 1),
sj AS (SELECT d.cluster_name, coalesce(c.n, 0) AS n FROM sdim d LEFT JOIN scnt c USING (cluster_name)),
rates AS (SELECT cluster_name, CAST(n AS DOUBLE) / CASE WHEN (SELECT sum(n) FROM sj) > 0 THEN (SELECT sum(n) FROM sj) ELSE 1 END AS rate FROM sj)"""

WEIGHTED = f"""
{BUFFER.strip()},
{STORE_RATES.strip()},
w AS (SELECT b.*, 1.0 + coalesce(r.rate, 0.0) * 5.0 AS raw_weight FROM buf b LEFT JOIN rates r ON r.cluster_name = b.failure_cluster),
wn AS (SELECT *, raw_weight / (SELECT sum(raw_weight) FROM w) AS weight FROM w),
u AS (SELECT *, (CAST(('0x' || substr(md5(CAST(seq AS VARCHAR) || '|42'), 1, 12)) AS BIGINT) + 1.0) / 281474976710657.0 AS uu FROM wn),
wsample AS (SELECT * FROM u ORDER BY -ln(uu) / raw_weight ASC, seq ASC LIMIT 1000)"""

register("buffer_fifo", f"""
WITH {BUFFER.strip()}
SELECT seq, failure_cluster, problem, plan, trajectory_id FROM buf ORDER BY seq DESC LIMIT 500
""")

register("buffer_distribution", f"""
WITH {BUFFER.strip()}
SELECT failure_cluster, count(*) AS n FROM buf GROUP BY 1
""")

register("curriculum_weights", f"""
WITH {WEIGHTED.strip()}
SELECT seq, failure_cluster, round(raw_weight, 6) AS raw_weight, round(weight, 12) AS weight FROM wn
""")

register("curriculum_sample_uniform", f"""
WITH {BUFFER.strip()},
u AS (SELECT *, (CAST(('0x' || substr(md5(CAST(seq AS VARCHAR) || '|42'), 1, 12)) AS BIGINT) + 1.0) / 281474976710657.0 AS uu FROM buf)
SELECT seq, failure_cluster FROM u ORDER BY uu ASC, seq ASC LIMIT 1000
""")

register("curriculum_sample_weighted", f"""
WITH {WEIGHTED.strip()}
SELECT seq, failure_cluster, round(raw_weight, 6) AS raw_weight FROM wsample
""")

DISTILL_SYSTEM_SQL = ("'You are a Python programmer who learns from mistakes. Given a coding problem, "
                      "an algorithmic plan, and a previous failed attempt with its error analysis, "
                      "write a corrected solution.'")

register("chat_dataset", f"""
WITH {WEIGHTED.strip()}
SELECT seq, failure_cluster, {DISTILL_SYSTEM_SQL} AS system_msg,
  '## Problem' || {NL} || {NL} || problem || {NL} || {NL} ||
  '## Plan' || {NL} || {NL} || coalesce(nullif(plan, ''), 'No plan available.') || {NL} || {NL} ||
  '## Previous Failed Attempt' || {NL} || {NL} || '```python' || {NL} || failed_code || {NL} || '```' || {NL} || {NL} ||
  '## What Went Wrong' || {NL} || {NL} || repair_reasoning || {NL} || {NL} ||
  '## Task' || {NL} || {NL} || 'Write the corrected Python function.' AS user_msg,
  '```python' || {NL} || repaired_code || {NL} || '```' AS assistant_msg,
  'system,user,assistant' AS roles
FROM wsample
""")

register("cluster_labels", """
WITH e AS (SELECT DISTINCT event_type FROM events),
l AS (SELECT event_type, CASE event_type WHEN 'click' THEN 'Syntax' WHEN 'error' THEN 'Runtime' WHEN 'view' THEN 'Logic'
                                         WHEN 'purchase' THEN 'EdgeCases' WHEN 'signup' THEN ' efficiency ' END AS raw_label FROM e),
m AS (SELECT * FROM (VALUES ('syntax', 'Syntax'), ('runtime', 'Runtime'), ('logic', 'Logic'), ('edgecases', 'EdgeCases'),
                            ('algorithmdesign', 'AlgorithmDesign'), ('efficiency', 'Efficiency'), ('unknown', 'Unknown')) t(k, v))
SELECT event_type, raw_label,
  coalesce((SELECT v FROM m WHERE k = lower(trim(raw_label))), 'Unknown') AS lenient,
  CASE WHEN raw_label IN ('Syntax', 'Runtime', 'Logic', 'EdgeCases', 'AlgorithmDesign', 'Efficiency', 'Unknown') THEN raw_label ELSE 'Unknown' END AS strict,
  coalesce((SELECT v FROM m WHERE k = lower(trim(upper(event_type)))), 'Unknown') AS upper_lenient
FROM l
""")

# ---------------------------------------------------------------------------
# routing
# ---------------------------------------------------------------------------
LABELS = f"""
{EXEC_LOG.strip()},
att AS (
  SELECT *, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY task_id ORDER BY sample_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS attempt,
         coalesce(error_type = 'AssertionError', false) AS repair_verified
  FROM scored
),
labels AS (
  SELECT task_id, sample_id, attempt, success, repair_verified,
    CASE WHEN success THEN 'success_store' ELSE 'failure_analysis' END AS after_execution,
    CASE WHEN repair_verified THEN 're_execute' WHEN attempt < 3 THEN 'expert_repair' ELSE 'distillation' END AS after_repair,
    CASE WHEN success THEN 'distillation' WHEN attempt < 3 THEN 'failure_analysis' ELSE 'distillation' END AS after_re_execution
  FROM att
)"""

register("routing_labels", f"""
WITH {LABELS.strip()}
SELECT * FROM labels
""")

# Topology of each preset run, written out edge by edge.
TOPOLOGY_VALUES = """
('run0', 'after_execution', 'success_store', 'success_store'),
('run0', 'after_execution', 'failure_analysis', 'success_store'),
('run1', 'after_execution', 'success_store', 'success_store'),
('run1', 'after_execution', 'failure_analysis', 'failure_analysis'),
('run1', 'after_repair', 're_execute', 're_execute'),
('run1', 'after_repair', 'expert_repair', 'expert_repair'),
('run1', 'after_repair', 'distillation', 'success_store'),
('run1', 'after_re_execution', 'distillation', 'success_store'),
('run1', 'after_re_execution', 'failure_analysis', 'failure_analysis'),
('run2', 'after_execution', 'success_store', 'success_store'),
('run2', 'after_execution', 'failure_analysis', 'failure_analysis'),
('run2', 'after_repair', 're_execute', 're_execute'),
('run2', 'after_repair', 'expert_repair', 'expert_repair'),
('run2', 'after_repair', 'distillation', 'distillation'),
('run2', 'after_re_execution', 'distillation', 'distillation'),
('run2', 'after_re_execution', 'failure_analysis', 'failure_analysis'),
('run3', 'after_execution', 'success_store', 'success_store'),
('run3', 'after_execution', 'failure_analysis', 'failure_analysis'),
('run4', 'after_execution', 'success_store', 'success_store'),
('run4', 'after_execution', 'failure_analysis', 'failure_analysis'),
('run4', 'after_repair', 're_execute', 're_execute'),
('run4', 'after_repair', 'expert_repair', 'expert_repair'),
('run4', 'after_repair', 'distillation', 'distillation'),
('run4', 'after_re_execution', 'distillation', 'distillation'),
('run4', 'after_re_execution', 'failure_analysis', 'failure_analysis')
"""

register("ablation_funnel", f"""
WITH {LABELS.strip()},
topo AS (SELECT * FROM (VALUES {TOPOLOGY_VALUES}) t(run_name, edge, label, target)),
long AS (
  SELECT 'after_execution' AS edge, after_execution AS label FROM labels
  UNION ALL SELECT 'after_repair', after_repair FROM labels
  UNION ALL SELECT 'after_re_execution', after_re_execution FROM labels
)
SELECT t.run_name, t.edge, t.target, count(*) AS n
FROM long l JOIN topo t ON t.edge = l.edge AND t.label = l.label
GROUP BY t.run_name, t.edge, t.target
""")

# ---------------------------------------------------------------------------
# trajectories
# ---------------------------------------------------------------------------
STEPS = """
steps AS (
  SELECT CAST(conv_id AS VARCHAR) AS trajectory_id, turn AS seq, role AS agent,
    CASE WHEN role = 'assistant' THEN 'generate_repair' WHEN role = 'user' THEN 'analyse_failure' ELSE 'set_context' END AS action,
    text AS output
  FROM conversations
),
stats AS (
  SELECT trajectory_id, count(*) AS num_steps, CAST(count(*) FILTER (WHERE action = 'generate_repair') AS INTEGER) AS num_attempts,
    arg_min(agent, seq) AS first_agent, arg_max(agent, seq) AS last_agent, arg_max(output, seq) AS last_output,
    arg_min(output, seq) AS first_output
  FROM steps GROUP BY trajectory_id
)"""

register("trajectory_summary", f"""
WITH {STEPS.strip()}
SELECT trajectory_id, num_steps, num_attempts, first_agent, last_agent, length(last_output) AS last_output_chars FROM stats
""")

register("training_examples", f"""
WITH {STEPS.strip()},
x AS (SELECT *, sha256(trajectory_id) AS h, last_agent = 'assistant' AS verified FROM stats)
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS example_id,
  trajectory_id,
  CASE WHEN length(first_output) % 2 = 0 THEN 'Logic' ELSE 'Unknown' END AS failure_cluster,
  'Root cause: ' || first_agent || {NL} || 'Category: Logic' || {NL} || 'Fix: rewrite after ' || CAST(num_steps AS VARCHAR) || ' steps'
    || {NL} || 'Critic verdict: ' || CASE WHEN verified THEN 'Valid' ELSE 'Invalid' END AS repair_reasoning,
  CASE WHEN verified THEN length(last_output) ELSE 0 END AS repaired_chars,
  verified
FROM x
""")

# ---------------------------------------------------------------------------
# reports
# ---------------------------------------------------------------------------
ROUND_METRICS = """
j AS (SELECT l.*, d.lang, d.source, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
g AS (
  SELECT lang AS run_name, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS round,
    avg(quality) AS m_pass1, avg(toxic) AS m_toxic, CAST(count(*) AS DOUBLE) AS m_n,
    avg(CASE WHEN toxic = 1 THEN quality END) AS m_pass1_toxic
  FROM j GROUP BY 1, 2
),
rm AS (
  SELECT * FROM (
    SELECT run_name, round, 'labels/pass@1' AS metric, m_pass1 AS value FROM g
    UNION ALL SELECT run_name, round, 'labels/toxic_rate', m_toxic FROM g
    UNION ALL SELECT run_name, round, 'labels/num_problems', m_n FROM g
    UNION ALL SELECT run_name, round, 'toxic/pass@1', m_pass1_toxic FROM g) WHERE value IS NOT NULL
)"""

register("round_metrics", f"""
WITH {ROUND_METRICS.strip()}
SELECT run_name, round, metric, round(value, 6) AS value,
  CASE WHEN metric = 'labels/num_problems' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE printf('%.4f', value) END AS cell
FROM rm
""")

register("round_log", f"""
WITH {ROUND_METRICS.strip()},
first AS (SELECT *, 1 AS logged_at FROM rm),
again AS (SELECT run_name, round, 'relogged/pass@1' AS metric, value, 2 AS logged_at FROM rm
          WHERE run_name = 'en' AND metric = 'labels/pass@1'),
allr AS (SELECT * FROM first UNION ALL SELECT * FROM again),
latest AS (SELECT run_name, round, max(logged_at) AS logged_at FROM allr GROUP BY 1, 2)
SELECT a.run_name, a.round, a.metric, round(a.value, 6) AS value, a.logged_at
FROM allr a JOIN latest l ON a.run_name = l.run_name AND a.round = l.round AND a.logged_at = l.logged_at
""")


register("run_comparison", f"""
WITH j AS (SELECT l.*, d.lang, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
g AS (
  SELECT lang AS run_name, avg(quality) AS m_pass1, avg(toxic) AS m_toxic, CAST(count(*) AS DOUBLE) AS m_n,
    avg(CASE WHEN n_chars > 20000 THEN quality END) AS m_long
  FROM j GROUP BY 1
),
rm AS (
  SELECT * FROM (
    SELECT run_name, 'labels/pass@1' AS metric, m_pass1 AS value FROM g
    UNION ALL SELECT run_name, 'labels/toxic_rate', m_toxic FROM g
    UNION ALL SELECT run_name, 'labels/num_problems', m_n FROM g
    UNION ALL SELECT run_name, 'long_docs/pass@1', m_long FROM g) WHERE value IS NOT NULL
),
runs AS (SELECT DISTINCT run_name FROM rm), names AS (SELECT DISTINCT metric FROM rm)
SELECT metric, run_name, CASE WHEN value IS NULL THEN 'N/A' WHEN metric = 'labels/num_problems' THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
       ELSE printf('%.4f', value) END AS cell
FROM names CROSS JOIN runs LEFT JOIN rm USING (metric, run_name)
""")

register("round_deltas", f"""
WITH {ROUND_METRICS.strip()},
f AS (SELECT * FROM rm WHERE metric IN ('labels/pass@1', 'toxic/pass@1')),
l AS (SELECT *, lag(round) OVER w AS pr, lag(value) OVER w AS pv FROM f WINDOW w AS (PARTITION BY run_name, metric ORDER BY round))
SELECT run_name, round, metric, round(value, 6) AS value,
  round(CASE WHEN pr = round - 1 AND pv IS NOT NULL AND value IS NOT NULL THEN value - pv END, 6) AS delta
FROM l
""")

register("experiment_summary", f"""
WITH {ROUND_METRICS.strip()},
pr AS (
  SELECT run_name, round,
    list_sort(list(metric || ': ' || printf('%.4f', value)) FILTER (WHERE contains(metric, 'pass@1'))) AS ms
  FROM rm GROUP BY run_name, round
)
SELECT run_name, round, CASE WHEN len(ms) > 0 THEN array_to_string(ms, ', ') ELSE 'None' END AS key_metrics,
  count(*) OVER (PARTITION BY run_name) AS total_rounds
FROM pr
""")

register("step_totals", f"""
WITH {EXEC_LOG.strip()}
SELECT benchmark, CAST(sum(passed) AS BIGINT) AS tests_passed, CAST(sum(failed) AS BIGINT) AS tests_failed,
  CAST(sum(total) AS BIGINT) AS tests_total,
  round(avg(execution_time_ms), 6) AS avg_execution_time_ms, count(*) FILTER (WHERE success) AS task_success,
  count(*) AS executions, count(*) FILTER (WHERE NOT success) AS experts_called,
  count(*) FILTER (WHERE error_type = 'AssertionError') AS repairs_verified
FROM scored GROUP BY benchmark
""")

# ---------------------------------------------------------------------------
# responses
# ---------------------------------------------------------------------------
def _code_block(t: str) -> str:
    """DuckDB: first fenced block of text ``t`` (unclosed runs to end; none or empty -> t)."""
    lines = f"string_split({t}, chr(10))"
    fences = f"list_transform({lines}, lambda l: regexp_matches(l, '^\\s*```'))"
    first = f"coalesce(list_position({fences}, true), 0)"
    second = f"coalesce(list_position(({fences})[{first} + 1:], true), 0)"
    body = (f"CASE WHEN {second} > 0 THEN ({lines})[{first} + 1:{first} + {second} - 1] "
            f"ELSE ({lines})[{first} + 1:] END")
    return f"(CASE WHEN {first} > 0 AND len({body}) > 0 THEN array_to_string({body}, chr(10)) ELSE {t} END)"


JSON_RESP = f"""
ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
d AS (
  SELECT event_id, k,
    '{{"algorithm_strategy": "' || event_type || '", "complexity_estimate": "O(n^' || CAST(k % 3 + 1 AS VARCHAR)
    || ')", "edge_cases": ["user ' || CAST(user_id AS VARCHAR) || '", "empty"], "key_observations": "k=' || CAST(k AS VARCHAR)
    || '", "is_valid": ' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END
    || ', "confidence": 0.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') || '}}' AS doc
  FROM ev
),
r AS (
  SELECT event_id,
    CASE WHEN event_id % 7 = 0 THEN '[' || CAST(k AS VARCHAR) || ']'
         WHEN event_id % 3 = 0 THEN doc || ' trailing words'
         WHEN event_id % 3 = 1 THEN 'Here you go:' || chr(10) || '```json' || chr(10) || doc || chr(10) || '```'
         ELSE doc END AS response
  FROM d
),
c AS (SELECT event_id, response, {_code_block('response')} AS block FROM r),
p AS (
  SELECT event_id, response,
    CASE WHEN json_valid(response) AND json_type(response) = 'OBJECT' THEN response
         WHEN json_valid(block) AND json_type(block) = 'OBJECT' THEN block END AS js
  FROM c
)"""

register("json_responses", f"""
WITH {JSON_RESP.strip()}
SELECT event_id, js IS NOT NULL AS parsed,
  'Strategy: ' || CASE WHEN js IS NULL THEN response ELSE coalesce(json_extract_string(js, '$.algorithm_strategy'), '') END
    || chr(10) || 'Complexity: ' || CASE WHEN js IS NULL THEN 'Unknown' ELSE coalesce(json_extract_string(js, '$.complexity_estimate'), 'Unknown') END
    || chr(10) || 'Edge Cases: ' || CASE WHEN js IS NULL THEN '' ELSE coalesce(array_to_string(json_extract_string(js, '$.edge_cases[*]'), ', '), '') END
    || chr(10) || 'Observations: ' || CASE WHEN js IS NULL THEN '' ELSE coalesce(json_extract_string(js, '$.key_observations'), '') END AS plan_text,
  CASE WHEN js IS NULL THEN response ELSE coalesce(json_extract_string(js, '$.algorithm_strategy'), '') END AS algorithm_strategy,
  CASE WHEN js IS NULL THEN 'Unknown' ELSE coalesce(json_extract_string(js, '$.complexity_estimate'), 'Unknown') END AS complexity_estimate,
  CASE WHEN js IS NULL THEN '' ELSE coalesce(array_to_string(json_extract_string(js, '$.edge_cases[*]'), ', '), '') END AS edge_cases,
  CASE WHEN js IS NULL THEN '' ELSE coalesce(json_extract_string(js, '$.key_observations'), '') END AS key_observations,
  CASE WHEN js IS NULL THEN false ELSE coalesce(CAST(json_extract(js, '$.is_valid') AS BOOLEAN), false) END AS is_valid,
  round(CASE WHEN js IS NULL THEN 0.0 ELSE coalesce(CAST(json_extract(js, '$.confidence') AS DOUBLE), 0.0) END, 6) AS confidence,
  CASE WHEN js IS NULL THEN 'Could not parse critic response'
       ELSE coalesce(array_to_string(json_extract_string(js, '$.issues_found[*]'), '; '), '') END AS issues_found
FROM p
""")

register("code_blocks", f"""
WITH r AS (
  SELECT doc_id,
    CASE WHEN doc_id % 4 = 0 THEN 'Here is the fix:' || chr(10) || '```python' || chr(10) || text || chr(10) || '```' || chr(10) || 'Hope it helps.'
         WHEN doc_id % 4 = 1 THEN text
         WHEN doc_id % 4 = 2 THEN '```' || chr(10) || text
         ELSE '  ```' || chr(10) || '```' || chr(10) || text END AS response
  FROM documents
)
SELECT doc_id, {_code_block('response')} AS code,
  'Could not parse structured response' AS debug_root_cause,
  length(left(response, 500)) AS debug_explanation_chars
FROM r
""")

# ---------------------------------------------------------------------------
# problems and scripts
# ---------------------------------------------------------------------------
RUNNER_SQL = """
  'def run_checks(checks):' || chr(10) || '    import sys, traceback' || chr(10) || '    outcomes = []' || chr(10)
  || '    for name, check in checks:' || chr(10) || '        try:' || chr(10) || '            check()' || chr(10)
  || '            outcomes.append(True)' || chr(10) || '        except Exception:' || chr(10)
  || '            outcomes.append(False)' || chr(10)
  || '            print(f"check {name} failed", file=sys.stderr)' || chr(10)
  || '            traceback.print_exc()' || chr(10)
  || '    print("RESULTS:", f"passed={sum(outcomes)}", f"failed={len(outcomes) - sum(outcomes)}", f"total={len(outcomes)}")'
  || chr(10)"""
WRAPPED = ("prompt || chr(10) || chr(10) || 'candidate = ' || entry_point || chr(10) || 'def body_check():' || chr(10) "
           "|| array_to_string(list_transform(string_split(regexp_replace(test, '^\\s+|\\s+$', '', 'g'), chr(10)), "
           "lambda l: '    ' || l), chr(10)) || chr(10) || chr(10) || " + RUNNER_SQL
           + " || chr(10) || 'run_checks([(''body'', body_check)])'")
BENCH = ("prompt || chr(10) || chr(10) || test || chr(10) || chr(10) || " + RUNNER_SQL
         + " || chr(10) || 'run_checks([(''check'', lambda: check(' || entry_point || '))])'")

register("problems", """
WITH p AS (
  SELECT item_id AS ordinal, 'Bench/' || CAST(item_id AS VARCHAR) AS task_id, text AS prompt,
    'solve_' || CAST(item_id AS VARCHAR) AS entry_point,
    'def check(candidate):' || chr(10) || '    assert candidate(' || CAST(item_id AS VARCHAR) || ') is not None' AS test
  FROM benchmark
)
SELECT ordinal, task_id, entry_point, length(prompt) AS prompt_chars, test AS test_code,
  'def ' || entry_point || '(x):' || chr(10) || '    return x' || chr(10) || chr(10)
    || 'assert ' || entry_point || '(1) == 1' || chr(10) || 'assert ' || entry_point || '(2) == 2' AS mbpp_script,
  left(sha256(""" + WRAPPED + """), 16) AS wrapped_fp,
  left(sha256(""" + BENCH + """), 16) AS benchmark_fp
FROM p
""")


# ---------------------------------------------------------------------------
# prompt requests (planner + coder user messages over benchmark items)
# ---------------------------------------------------------------------------
def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _prompt_sql() -> str:
    from failurelens.functions.prompts import CODER_SYSTEM, PLANNER_SYSTEM
    nl2 = "chr(10) || chr(10)"
    planner_user = (f"'## Coding Problem' || {nl2} || text || {nl2} || '---' || {nl2} || "
                    "'Analyze this problem and provide your algorithmic plan as JSON.'")
    coder_user = (f"'## Problem' || {nl2} || text || {nl2} || '## Algorithmic Plan' || {nl2} || "
                  "coalesce(CASE WHEN item_id % 2 = 0 THEN 'Strategy: loop over solve_' || CAST(item_id AS VARCHAR) END, "
                  f"'No plan provided.') || {nl2} || '---' || {nl2} || "
                  "'Write a complete Python function that solves this problem. "
                  "Output ONLY the function in a ```python code block.'")
    return f"""
SELECT 'Bench/' || CAST(item_id AS VARCHAR) AS request_id, 'planner' AS role, {_sql_str(PLANNER_SYSTEM)} AS system_prompt,
  {planner_user} AS user_prompt FROM benchmark
UNION ALL
SELECT 'Bench/' || CAST(item_id AS VARCHAR), 'coder', {_sql_str(CODER_SYSTEM)}, {coder_user} FROM benchmark
"""


register("prompt_requests", _prompt_sql())


# ---------------------------------------------------------------------------
# heuristic start on the per-label mean vectors (10 rows, k = 6)
# ---------------------------------------------------------------------------
register("heuristic_init", f"""
WITH vec AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
qc AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM vec) GROUP BY label, i),
q AS (SELECT label, list(x ORDER BY i) AS v FROM qc GROUP BY label),
qn AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS pos, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS nn, v FROM q),
n AS (SELECT count(*) AS n FROM qn),
picks AS (
  SELECT i AS cluster_idx,
    CASE WHEN i = 5 THEN (SELECT n FROM n) - 1
         ELSE CAST(floor(i * (CAST((SELECT n FROM n) - 1 AS DOUBLE) / 5.0)) AS BIGINT) END AS pos
  FROM range(6) t(i)
),
chosen AS (
  SELECT p.cluster_idx, ({CLUSTER_LIST})[p.cluster_idx + 1] AS cluster_name,
    list_transform(qn.v, lambda y: y / qn.nn) AS c
  FROM picks p JOIN qn ON qn.pos = p.pos
)
SELECT CAST(cluster_idx AS INTEGER) AS cluster_idx, cluster_name, CAST(0 AS BIGINT) AS n_assigned,
  CAST(i - 1 AS BIGINT) AS dim, round(x, 6) AS value
FROM (SELECT cluster_idx, cluster_name, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM chosen)
""")


# ---------------------------------------------------------------------------
# operators by themselves
# ---------------------------------------------------------------------------
RUN_METRICS = """
jm AS (SELECT l.*, d.lang, d.n_chars FROM labels l JOIN documents d USING (doc_id)),
gm AS (SELECT lang AS run_name, avg(quality) AS a, avg(toxic) AS b, CAST(count(*) AS DOUBLE) AS c,
         avg(CASE WHEN n_chars > 20000 THEN quality END) AS e FROM jm GROUP BY 1),
rmet AS (SELECT * FROM (
  SELECT run_name, 'labels/pass@1' AS metric, a AS value FROM gm UNION ALL SELECT run_name, 'labels/toxic_rate', b FROM gm
  UNION ALL SELECT run_name, 'labels/num_problems', c FROM gm UNION ALL SELECT run_name, 'long_docs/pass@1', e FROM gm)
  WHERE value IS NOT NULL)"""

register("pass_at_k_fixed_n", f"""
WITH {EXEC_LOG.strip()},
cnt AS (SELECT task_id, count(*) AS samples, count(*) FILTER (WHERE success) AS c FROM scored GROUP BY 1),
most AS (SELECT greatest(coalesce(max(samples), 0), 5) AS n FROM cnt),
ids AS (SELECT CAST(c_custkey AS VARCHAR) AS task_id FROM customer UNION SELECT task_id FROM cnt),
t AS (SELECT task_id, n, coalesce(c, 0) AS c FROM ids CROSS JOIN most LEFT JOIN cnt USING (task_id)),
agg AS (SELECT avg({pass_at_k_sql('n', 'c', 1)}) AS p1, avg({pass_at_k_sql('n', 'c', 5)}) AS p5, count(*) AS np FROM t)
SELECT 'Users' AS benchmark, 'users/pass@1' AS metric, round(p1, 6) AS value FROM agg
UNION ALL SELECT 'Users', 'users/pass@5', round(p5, 6) FROM agg
UNION ALL SELECT 'Users', 'users/num_problems', CAST(np AS DOUBLE) FROM agg
""")

register("expanded_samples", """
SELECT 'Bench/' || CAST(item_id AS VARCHAR) AS task_id, s AS sample_id FROM benchmark, range(5) r(s)
""")

register("first_problems", """
SELECT item_id AS ordinal, 'Bench/' || CAST(item_id AS VARCHAR) AS task_id, 'solve_' || CAST(item_id AS VARCHAR) AS entry_point,
  'def check(candidate):' || chr(10) || '    assert candidate(' || CAST(item_id AS VARCHAR) || ') is not None' AS test_code
FROM benchmark ORDER BY item_id LIMIT 25
""")

register("benchmark_log", """
SELECT 'HumanEval' AS benchmark, count(*) AS n FROM events WHERE user_id % 2 = 0 HAVING count(*) > 0
""")

register("recent_logic_failures", f"""
WITH {STORE.strip()}
SELECT record_id, failure_cluster, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS created_at
FROM store WHERE failure_cluster = 'Logic' ORDER BY created_at DESC, record_id ASC LIMIT 100
""")

register("store_totals", f"""
WITH {STORE.strip()}
SELECT 'cluster' AS kind, failure_cluster AS name, count(*) AS n FROM store GROUP BY 2
UNION ALL SELECT 'all', '', count(*) FROM store
UNION ALL SELECT 'embedded', '', count(*) FROM store WHERE embedding IS NOT NULL
""")

register("store_replaced", f"""
WITH {STORE.strip()}
SELECT record_id, failure_cluster, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY (seq % 4 >= 2) DESC, seq DESC) AS k FROM batch) WHERE k = 1
""")

register("similar_to_one", f"""
WITH {VEC.strip()},
n1 AS (SELECT vec_id, list_transform(e, lambda x: x / (nrm + 1e-8)) AS v FROM vnorm),
q AS (SELECT v AS qv FROM n1 WHERE vec_id = 7),
s AS (SELECT vec_id, list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2])) AS sim FROM n1, q)
SELECT vec_id, round(sim, 6) AS similarity FROM s ORDER BY sim DESC, vec_id ASC LIMIT 10
""")

register("execution_outcomes", f"""
WITH {EXEC_LOG.strip()}
SELECT task_id, sample_id, CASE WHEN success THEN 'ok' ELSE 'failed' END AS outcome FROM scored
""")

register("code_test_pairs", """
SELECT item_id AS ordinal, length(d.text) AS code_chars, 'solve_' || CAST(item_id AS VARCHAR) AS entry_point
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id
""")

register("task_stages", f"""
WITH {EXEC_LOG.strip()},
{BUFFER.strip()},
r AS (SELECT * FROM (SELECT task_id, sample_id, passed, success,
        row_number() OVER (PARTITION BY task_id ORDER BY sample_id DESC) AS k FROM scored) WHERE k = 1),
x AS (SELECT * FROM (SELECT e.user_id, seq, failure_cluster, row_number() OVER (PARTITION BY e.user_id ORDER BY seq DESC) AS k
        FROM ex JOIN events e ON e.event_id = seq) WHERE k = 1)
SELECT r.task_id, r.sample_id AS run_attempt, r.passed AS run_passed, r.success AS run_success,
  x.seq AS example_attempt, x.failure_cluster AS example_failure_cluster
FROM r LEFT JOIN x ON CAST(x.user_id AS VARCHAR) = r.task_id
""")

register("kept_examples", """
SELECT event_id AS seq, 'kept' AS list FROM events WHERE event_id % 2 = 0 AND event_id % 5 <> 0
UNION ALL SELECT event_id, 'produced' FROM events WHERE event_id % 3 = 0
""")

register("metric_names", f"""
WITH {ROUND_METRICS.strip()},
{RUN_METRICS.strip()}
SELECT metric FROM rm UNION SELECT metric FROM rmet
""")

register("merged_metrics", f"""
WITH {RUN_METRICS.strip()}
SELECT run_name, metric, round(CASE WHEN run_name = 'en' THEN value + 1 ELSE value END, 6) AS value FROM rmet
""")

register("buffer_append", f"""
WITH {BUFFER.strip()}
SELECT seq, failure_cluster, trajectory_id FROM ex ORDER BY seq DESC LIMIT 700
""")

register("debug_answers", """
SELECT event_id, event_type AS root_cause, 'seen by ' || CAST(user_id AS VARCHAR) AS explanation FROM events
""")

register("run_flags", f"""
WITH {RUN_METRICS.strip()},
f(run_name, a, b) AS (VALUES ('run0', false, false), ('run1', true, false), ('run2', true, true), ('run3', false, true), ('run4', true, true)),
m AS (SELECT 'run' || CAST(length(metric) % 6 AS VARCHAR) AS run_name, metric, value FROM rmet)
SELECT run_name, metric, round(value, 6) AS value, a AS use_agentic_repair, b AS use_distillation FROM m LEFT JOIN f USING (run_name)
""")


def _repair_requests() -> str:
    """The requests' user texts with the document in every slot."""
    from failurelens.functions.prompts import CRITIC, DEBUGGER
    parts = []
    for role in (DEBUGGER, CRITIC):
        text = " || ".join(_sql_str(piece) if i % 2 == 0 else "coalesce(text, '')"
                           for i, piece in enumerate(re.split(r"\{(\w+)\}", role.user_template)))
        parts.append(f"SELECT CAST(doc_id AS VARCHAR) AS request_id, '{role.name}' AS role, "
                     f"left(sha256({text}), 16) AS user_fp FROM documents")
    return " UNION ALL ".join(parts)


register("repair_requests", _repair_requests())

register("buffer_file", f"""
WITH {BUFFER.strip()}
SELECT failure_cluster, trajectory_id, problem, plan FROM ex ORDER BY seq DESC LIMIT 700
""")

register("event_file", f"""
WITH {EXEC_LOG.strip()},
{BUFFER.strip()}
SELECT 'execution_completed' AS event, task_id, success, CAST(sample_id AS BIGINT) AS attempt, CAST(passed AS BIGINT) AS passed,
  CAST(total AS BIGINT) AS total, CAST(NULL AS BIGINT) AS plan_len FROM scored
UNION ALL
SELECT 'planner_executed', CAST(user_id AS VARCHAR), NULL, NULL, NULL, NULL, length(plan) FROM ex JOIN events ON event_id = seq
""")

register("tracker_file", f"""
WITH {ROUND_METRICS.strip()}
SELECT round, run_name || '/' || metric AS metric, round(value, 6) AS value FROM rm
""")

register("store_replaced_bucketed", ORACLE["store_replaced"])

register("sample_summary", f"""
WITH {WEIGHTED.strip()}
SELECT 'store' AS rates, seq, failure_cluster, round(raw_weight, 6) AS raw_weight FROM wsample
UNION ALL SELECT * FROM (SELECT 'none', seq, failure_cluster, 1.0::DOUBLE FROM u ORDER BY -ln(uu) ASC, seq ASC LIMIT 1000)
UNION ALL SELECT * FROM (SELECT 'uniform', seq, failure_cluster, 1.0::DOUBLE FROM u ORDER BY uu ASC, seq ASC LIMIT 1000)
""")
