from failurelens.functions import responses as rs
from failurelens.functions import text as tx


def test_cluster_labels_lenient_and_strict(spark):
    df = spark.createDataFrame([("Syntax",), ("syntax ",), ("RUNTIME",), ("unknown_val",), (" Logic ",)], "l string")
    got = df.select(tx.canonical_cluster("l", "lenient").alias("a"), tx.canonical_cluster("l", "strict").alias("b")).collect()
    assert [r.a for r in got] == ["Syntax", "Syntax", "Runtime", "Unknown", "Logic"]
    assert [r.b for r in got] == ["Syntax", "Unknown", "Unknown", "Unknown", "Unknown"]


def test_failure_text_truncation(spark):
    df = spark.createDataFrame([("A long task description", "def check(x): return x", "TypeError", "Error here",
                                 "Traceback line")], "task string, code string, et string, se string, tb string")
    t = df.select(tx.failure_text("task", "code", "et", "se", "tb", task_limit=10, traceback_limit=9,
                                  stderr_limit=5, code_limit=12).alias("t")).first().t
    for part in ["Task: A long tas", "Error Type: TypeError", "Traceback: Traceback", "Stderr: Error",
                 "Code Snippet: def check(x)"]:
        assert part in t
    assert "Task: A long task" not in t


def test_failure_text_drops_empty_parts(spark):
    df = spark.createDataFrame([("t", "c", None, "", "")], "task string, code string, et string, se string, tb string")
    t = df.select(tx.failure_text("task", "code", "et", "se", "tb").alias("t")).first().t
    assert t == "Task: t\nError Type: Unknown\nCode Snippet: c"


def test_extract_code_block_edges(spark):
    cases = [("x\n```python\ncode1\ncode2\n```\ny", "code1\ncode2"),
             ("no fence here", "no fence here"),
             ("```\nopen to end\nmore", "open to end\nmore"),
             ("```\n```\ntext", "```\n```\ntext"),
             ("  ```js\n\n```", ""),
             ("a\n```", "a\n```")]
    df = spark.createDataFrame(cases, "t string, want string")
    for r in df.select("want", tx.extract_code_block("t").alias("got")).collect():
        assert r.got == r.want


def test_strict_json(spark):
    cases = [('{"a": 1}', True), ('{"a": 1} x', False), (' {"a": 1} ', True), ("[1, 2]", False), ('"s"', False),
             ("", False), ("{", False), ('```json\n{"a": 2}\n```', True), ('{"a": 1, "a": 2}', True)]
    df = spark.createDataFrame(cases, "t string, ok boolean")
    got = df.select("ok", rs.parse_response_json("t").isNotNull().alias("p")).collect()
    assert [r.p for r in got] == [r.ok for r in got]
    dup = spark.createDataFrame([('{"a": 1, "a": 2}',)], "t string")
    assert dup.select(rs.planner_output("t").alias("p")).first().p.algorithm_strategy == ""


def test_planner_and_critic_fallbacks(spark):
    df = spark.createDataFrame([("not json",), ('{"algorithm_strategy": "dp", "edge_cases": ["e1"], "is_valid": true, '
                                               '"confidence": 0.9}',)], "t string")
    rows = df.select(rs.planner_output("t").alias("p"), rs.critic_output("t").alias("c")).collect()
    assert rows[0].p.algorithm_strategy == "not json" and rows[0].p.complexity_estimate == "Unknown"
    assert rows[0].c.is_valid is False and rows[0].c.issues_found == ["Could not parse critic response"]
    assert rows[1].p.algorithm_strategy == "dp" and rows[1].p.edge_cases == ["e1"]
    assert rows[1].c.is_valid is True and abs(rows[1].c.confidence - 0.9) < 1e-12


def test_debugger_strips_fence_in_code(spark):
    df = spark.createDataFrame([('{"root_cause": "r", "repaired_code": "```python\\nx = 1\\n```"}',), ("plain",)], "t string")
    rows = df.select(rs.debugger_output("t").alias("d")).collect()
    assert rows[0].d.repaired_code == "x = 1" and rows[0].d.analysis.root_cause == "r"
    assert rows[1].d.analysis.root_cause == "Could not parse structured response" and rows[1].d.repaired_code == "plain"


def test_chat_messages_and_placeholder(spark):
    df = spark.createDataFrame([("P", "", "F", "R", "C")], "problem string, plan string, failed_code string, "
                               "repair_reasoning string, repaired_code string")
    m = df.select(tx.chat_messages().alias("m")).first().m
    assert [x.role for x in m] == ["system", "user", "assistant"]
    assert "## Plan\n\nNo plan available." in m[1].content
    assert m[2].content == "```python\nC\n```"


def test_metric_cell_and_fingerprint(spark):
    df = spark.createDataFrame([(0.03125,), (None,), (1.0,)], "v double")
    assert [r.c for r in df.select(tx.metric_cell("v").alias("c")).collect()] == ["0.0312", "N/A", "1.0000"]
    fp = spark.createDataFrame([("abc",)], "t string").select(tx.fingerprint("t").alias("f")).first().f
    assert fp == "ba7816bf8f01cfea"


def test_plan_and_reasoning_text(spark):
    df = spark.createDataFrame([("s", "O(n)", ["a", "b"], "o", "rc", "cat", "fix", True)],
                               "s string, c string, e array<string>, o string, rc string, cat string, f string, v boolean")
    r = df.select(tx.plan_text("s", "c", "e", "o").alias("p"), tx.repair_reasoning_text("rc", "cat", "f", "v").alias("r")).first()
    assert r.p == "Strategy: s\nComplexity: O(n)\nEdge Cases: a, b\nObservations: o"
    assert r.r == "Root cause: rc\nCategory: cat\nFix: fix\nCritic verdict: Valid"


def test_strict_json_adversarial_trailing(spark):
    cases = ['{"a":1}] junk [{"b":2}', '{"a":1},{"b":2}', '{"a":"\\u0001"}', '{"a":1,"\\u0001"] x [0',
             '{"a": "x"} ', '{"a":1}}', '{"a":[1,2]}']
    want = [False, False, True, False, True, False, True]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r.p for r in df.select(rs.strict_json_object("t").isNotNull().alias("p")).collect()]
    assert got == want


def test_report_cells_round_the_binary_value_once(spark):
    import random
    rng = random.Random(1)
    values = [0.00015, 2.00005, 0.00005, 0.00025, -0.0, -0.00004, 99999.99995, 1e10 + 0.00005] + \
        [k / 20000 for k in range(-400, 400)] + [rng.uniform(-10, 10) for _ in range(500)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert [r.c for r in df.select(tx.metric_cell("v").alias("c")).collect()] == [f"{v:.4f}" for v in values]
    whole = spark.createDataFrame([(164.0, True), (164.0, False), (None, True)], "v double, w boolean")
    assert [r.c for r in whole.select(tx.metric_cell("v", "w").alias("c")).collect()] == ["164", "164.0000", "N/A"]
