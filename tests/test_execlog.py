from pyspark.sql import functions as F

from failurelens.functions import execlog as ex

LOG_SCHEMA = "task_id string, sample_id bigint, stdout string, stderr string, returncode int, timed_out boolean, elapsed_ms double"


def _parse(spark, rows):
    df = spark.createDataFrame(rows, LOG_SCHEMA)
    return {r.sample_id: r for r in ex.parse_exec_log(df).collect()}


def test_reference_rows(spark):
    rows = [
        ("t", 1, "RESULTS: passed=1 failed=0 total=1", "", 0, False, 1.0),
        ("t", 2, "RESULTS: passed=0 failed=1 total=1", "FAIL: assertion failed\nAssertionError\n", 0, False, 1.0),
        ("t", 3, "", "SyntaxError: invalid syntax", 1, False, 1.0),
    ]
    got = _parse(spark, rows)
    assert (got[1].passed, got[1].failed, got[1].total, got[1].success, got[1].error_type) == (1, 0, 1, True, None)
    assert (got[2].passed, got[2].failed, got[2].total, got[2].success, got[2].error_type) == (0, 1, 1, False, "AssertionError")
    assert (got[3].passed, got[3].failed, got[3].total, got[3].success, got[3].error_type) == (0, 1, 1, False, "SyntaxError")


def test_error_names(spark):
    df = spark.createDataFrame([("ZeroDivisionError: division by zero",), ("NameError: name 'foo' is not defined",),
                                ("Some unexpected message",), ("",), ("ModuleNotFoundError: x",),
                                ("ZeroDivisionError then ValueError",)], "stderr string")
    got = [r.e for r in df.select(ex.detect_error_type("stderr").alias("e")).collect()]
    assert got == ["ZeroDivisionError", "NameError", "UnknownError", None, "UnknownError", "ValueError"]


def test_timeout_and_malformed(spark):
    rows = [("t", 1, "RESULTS: passed=1 failed=0 total=1", "", 0, True, 5.0),
            ("t", 2, "RESULTS: passed=x failed=0 total=1", "", 0, False, 5.0),
            ("t", 3, "RESULTS: passed failed=0", "", 0, False, 5.0),
            ("t", 4, "RESULTS: passed=1=2", "", 0, False, 5.0),
            ("t", 5, "x\nRESULTS: passed=2 passed=3 failed=0 total=3\nRESULTS: passed=9", "", 0, False, 5.0)]
    got = _parse(spark, rows)
    assert got[1].timeout and got[1].returncode == -1 and got[1].error_type is None and not got[1].success
    assert got[1].stderr == "Execution timed out after 30 seconds"
    assert got[2].error_type == "ValueError" and got[2].returncode == -1
    assert got[2].stderr == "invalid literal for int() with base 10: 'x'"
    assert got[3].stderr == "not enough values to unpack (expected 2, got 1)"
    assert got[4].stderr == "too many values to unpack (expected 2)"
    assert (got[5].passed, got[5].total, got[5].success) == (3, 3, True)


def test_crash_fallback_only_without_parsed_tests(spark):
    rows = [("t", 1, "", "boom", 2, False, 1.0), ("t", 2, "RESULTS: passed=1 failed=0 total=1", "", 3, False, 1.0)]
    got = _parse(spark, rows)
    assert (got[1].failed, got[1].total) == (1, 1)
    assert (got[2].failed, got[2].total, got[2].success) == (0, 1, True)


def test_traceback(spark):
    df = spark.createDataFrame([("warn\nTraceback (most recent call last):\n  x",), ("no tb",)], "stderr string")
    got = [r.t for r in df.select(ex.extract_traceback("stderr").alias("t")).collect()]
    assert got == ["Traceback (most recent call last):\n  x", ""]


def test_success_truth_table(spark):
    df = spark.createDataFrame([(3, 0, 3, False), (2, 1, 3, False), (3, 0, 3, True), (0, 0, 0, False)],
                               "passed int, failed int, total int, timeout boolean")
    assert [r.s for r in df.select(ex.is_success().alias("s")).collect()] == [True, False, False, False]


def test_scripts_print_the_results_line(spark):
    """The scripts run, and their output parses into the right counts."""
    import subprocess
    import sys
    add = "def add(a, b):\n    return a + b"
    rows = [(0, add, "assert candidate(1, 2) == 3", "add"), (1, add, "assert candidate(1, 2) == 4", "add"),
            (2, "def f(): pass", "", ""), (3, add, None, None), (4, add, "x = 1\nif x:\n    assert add(x, 1) == 2", "")]
    df = spark.createDataFrame(rows, "i long, code string, test string, ep string")
    bench = df.where("i < 2").withColumn("test", F.concat(F.lit("def check(candidate):\n    "), "test"))
    scripts = [r.s for r in df.orderBy("i").select(ex.wrapped_script("code", "test", "ep").alias("s")).collect()]
    scripts += [r.s for r in bench.orderBy("i").select(ex.benchmark_script("code", "test", "ep").alias("s")).collect()]
    logs = []
    for i, s in enumerate(scripts):
        run = subprocess.run([sys.executable, "-c", s], capture_output=True, text=True)
        logs.append(("t", i, run.stdout, run.stderr, run.returncode, False, 1.0))
    got = ex.parse_exec_log(spark.createDataFrame(logs, LOG_SCHEMA)).orderBy("sample_id").collect()
    assert [(r.passed, r.failed, r.total) for r in got] == [(1, 0, 1), (0, 1, 1), (1, 0, 1), (1, 0, 1), (1, 0, 1),
                                                            (1, 0, 1), (0, 1, 1)]
    assert got[1].error_type == "AssertionError"


def test_test_code_from_cases_keeps_newline_for_missing(spark):
    df = spark.createDataFrame([([("a",), (None,), ("b",)],)], "cases array<struct<test_code:string>>")
    assert df.select(ex.test_code_from_cases("cases").alias("t")).first().t == "a\n\nb"


def test_launch_error_row(spark):
    df = spark.createDataFrame([("t", 1, "", "", 0, False, 2.0, "FileNotFoundError", "no python"),
                                ("t", 2, "RESULTS: passed=1 failed=0 total=1", "", 0, False, 2.0, None, None)],
                               LOG_SCHEMA + ", launch_error_type string, launch_error_message string")
    got = {r.sample_id: r for r in ex.parse_exec_log(df).collect()}
    assert (got[1].error_type, got[1].stderr, got[1].returncode, got[1].total, got[1].success) == \
        ("FileNotFoundError", "no python", -1, 0, False)
    assert got[2].success and "launch_error_type" not in ex.parse_exec_log(df).columns
