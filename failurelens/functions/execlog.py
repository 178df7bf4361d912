"""Execution-log parsing as Column expressions (JVM-side, codegen friendly).

Input is a raw run log ``(task_id, sample_id, stdout, stderr, returncode,
timed_out, elapsed_ms)`` recorded by an external runner; output is one typed
execution result per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failurelens.functions.text import py_strip
from failurelens.schemas import ERROR_TYPES

RESULTS_PREFIX = "RESULTS:"
_COUNT_KEYS = ("passed", "failed", "total")
# First line starting with RESULTS: (only '\n' ends a line, as in Python's split).
_LINE_RE = r"(?md)^(RESULTS:.*)$"
# A RESULTS line whose every token after the first is key=value with a single '=',
# and whose count keys carry plain integers: nothing on it can fail to parse.
_WELL_FORMED_RE = (r"(?U)^\S*(?:\s+(?:(?:passed|failed|total)=[+-]?[0-9]+"
                   r"|(?!(?:passed|failed|total)=)[^=\s]+=[^=\s]*))*+\s*$")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def results_line(stdout) -> Column:
    """First stdout line that starts with ``RESULTS:`` (lines split on '\\n' only)."""
    lines = F.split(_c(stdout), "\n", -1)
    return F.try_element_at(F.filter(lines, lambda l: l.startswith(RESULTS_PREFIX)), F.lit(1))


def _tokens(line: Column) -> Column:
    """Whitespace tokens after the leading ``RESULTS:`` token (Unicode whitespace)."""
    toks = F.filter(F.split(line, r"(?U)\s+", -1), lambda t: t != "")
    return F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0)))


def _token_error(tok: Column) -> Column:
    """Error text a ``key=value`` token raises when parsed, or null."""
    parts = F.split(tok, "=", -1)
    key = F.try_element_at(parts, F.lit(1))
    val = F.try_element_at(parts, F.lit(2))
    return (
        F.when(F.size(parts) < 2, F.lit("not enough values to unpack (expected 2, got 1)"))
        .when(F.size(parts) > 2, F.lit("too many values to unpack (expected 2)"))
        .when(key.isin(*_COUNT_KEYS) & val.try_cast("bigint").isNull(),
              F.concat(F.lit("invalid literal for int() with base 10: '"), val, F.lit("'")))
    )


def detect_error_type(stderr) -> Column:
    """First error name, in list order, that occurs anywhere in stderr.

    Non-empty stderr with no known name -> 'UnknownError'; empty -> null.
    """
    s = _c(stderr)
    expr = None
    for name in ERROR_TYPES:
        cond = s.contains(name)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.when(F.coalesce(s, F.lit("")) != "", F.lit("UnknownError"))


def extract_traceback(stderr) -> Column:
    """stderr from the first 'Traceback' to the end, else ''."""
    s = _c(stderr)
    pos = F.instr(s, "Traceback")
    return F.when(pos > 0, F.substring(s, pos, 2147483647)).otherwise(F.lit(""))


def is_success(passed="passed", failed="failed", timeout="timeout") -> Column:
    """failed == 0 and passed > 0 and not timed out (null counts as false)."""
    return F.coalesce(
        (_c(failed) == 0) & (_c(passed) > 0) & ~F.coalesce(_c(timeout), F.lit(False)),
        F.lit(False),
    )


def _count_from_line(line: Column, key: str) -> Column:
    """Last ``key=<int>`` token on a well-formed RESULTS line, else 0 (no lambdas)."""
    vals = F.regexp_extract_all(line, F.lit(r"(?U)(?:^|\s)" + key + r"=(\S*)"), 1)
    return F.coalesce(F.try_element_at(vals, F.lit(-1)).try_cast("bigint"), F.lit(0).cast("bigint"))


def parse_exec_log(df: DataFrame, timeout_seconds: int = 30) -> DataFrame:
    """Raw run log -> typed execution results (one row in, one row out).

    Branches, as the runner reports them:
      * timed out: returncode -1, no tests, fixed message, null error type
      * malformed RESULTS line: returncode -1, error 'ValueError', its message
      * otherwise parsed counts; a crash with no parsed tests counts as 1 failed
    Adds ``success``. Narrow transformation: no shuffle. Well-formed lines are
    read with regular expressions only; just the malformed ones are split into
    tokens to find the first failing token and its message.
    """
    timed_out = F.coalesce(F.col("timed_out"), F.lit(False))
    raw_cols = ("stdout", "stderr", "returncode", "timed_out", "elapsed_ms", "launch_error_type", "launch_error_message")
    keep = [c for c in df.columns if c not in raw_cols]
    if "launch_error_type" in df.columns:
        # the runner could not start the script: its exception name and message
        launch = F.col("launch_error_type")
        launch_msg = F.coalesce(F.col("launch_error_message"), F.lit("")) if "launch_error_message" in df.columns \
            else F.lit("")
    else:
        launch, launch_msg = F.lit(None).cast("string"), F.lit("")
    line = F.regexp_extract(F.coalesce(F.col("stdout"), F.lit("")), _LINE_RE, 1)
    slow_err = F.try_element_at(F.filter(F.transform(_tokens(F.col("_line")), _token_error),
                                         lambda e: e.isNotNull()), F.lit(1))
    staged = (df.withColumn("_to", timed_out)
              .withColumn("_line", F.when(~F.col("_to"), line).otherwise(F.lit("")))
              .withColumn("_perr", F.when((F.col("_line") != "") & ~F.col("_line").rlike(_WELL_FORMED_RE), slow_err))
              .withColumn("_bad", F.col("_perr").isNotNull())
              .withColumn("_p", _count_from_line(F.col("_line"), "passed"))
              .withColumn("_f", _count_from_line(F.col("_line"), "failed"))
              .withColumn("_t", _count_from_line(F.col("_line"), "total"))
              .withColumn("_rc", F.coalesce(F.col("returncode"), F.lit(0)))
              .withColumn("_err", F.coalesce(F.col("stderr"), F.lit("")))
              .withColumn("_launch", F.when(~F.col("_to"), launch))
              .withColumn("_launch_msg", launch_msg))
    launched_bad = F.col("_launch").isNotNull()
    void = F.col("_to") | F.col("_bad") | launched_bad
    crashed = (F.col("_rc") != 0) & (F.col("_t") == 0)
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    out = staged.select(
        *keep,
        F.when(void, zero).otherwise(F.col("_p")).alias("passed"),
        F.when(void, zero).when(crashed, one).otherwise(F.col("_f")).alias("failed"),
        F.when(void, zero).when(crashed, one).otherwise(F.col("_t")).alias("total"),
        F.when(F.col("_to"), F.lit(f"Execution timed out after {timeout_seconds} seconds"))
        .when(launched_bad, F.col("_launch_msg"))
        .when(F.col("_bad"), F.col("_perr")).otherwise(F.col("_err")).alias("stderr"),
        F.when(void, F.lit("")).otherwise(F.coalesce(F.col("stdout"), F.lit(""))).alias("stdout"),
        F.when(void, F.lit(-1)).otherwise(F.col("_rc")).cast("int").alias("returncode"),
        F.col("_to").alias("timeout"),
        F.when(F.col("_to"), F.lit(None).cast("string")).when(launched_bad, F.col("_launch"))
        .when(F.col("_bad"), F.lit("ValueError"))
        .otherwise(detect_error_type(F.col("_err"))).alias("error_type"),
        F.when(void, F.lit("")).otherwise(extract_traceback(F.col("_err"))).alias("traceback"),
        F.col("elapsed_ms").cast("double").alias("execution_time_ms"),
    )
    return out.withColumn("success", is_success())


# ---------------------------------------------------------------------------
# Test scripts for an external runner; of them only the RESULTS line is fixed
# ---------------------------------------------------------------------------
def test_code_from_cases(test_cases) -> Column:
    """Join test-case snippets with '\\n'; a missing snippet is '' but keeps its newline."""
    return F.array_join(F.transform(_c(test_cases), lambda t: F.coalesce(t["test_code"], F.lit(""))), "\n")


def mbpp_script(code, test_list) -> Column:
    """code + blank line + assertions joined by newlines."""
    tests = F.coalesce(F.array_join(_c(test_list), "\n"), F.lit(""))
    return F.concat(_c(code), F.lit("\n\n"), tests)


#: Runs a list of named checks and prints the counts that the log parser reads.
RUNNER = """\
def run_checks(checks):
    import sys, traceback
    outcomes = []
    for name, check in checks:
        try:
            check()
            outcomes.append(True)
        except Exception:
            outcomes.append(False)
            print(f"check {name} failed", file=sys.stderr)
            traceback.print_exc()
    print("RESULTS:", f"passed={sum(outcomes)}", f"failed={len(outcomes) - sum(outcomes)}", f"total={len(outcomes)}")
"""


def _as_function(name: str, body: Column) -> Column:
    """A function without arguments around the lines of ``body``."""
    lines = F.transform(F.split(py_strip(body), "\n", -1), lambda x: F.concat(F.lit("    "), x))
    return F.concat(F.lit(f"def {name}():\n"), F.array_join(lines, "\n"), F.lit("\n"))


def wrapped_script(code, test_code, entry_point) -> Column:
    """A script that runs the test body as one check on the candidate; without test code,
    loading the code is the check."""
    code, test_code, entry_point = _c(code), F.coalesce(_c(test_code), F.lit("")), F.coalesce(_c(entry_point), F.lit(""))
    candidate = F.when(entry_point != "", F.concat(F.lit("candidate = "), entry_point, F.lit("\n"))).otherwise(F.lit(""))
    body = F.when(test_code != "", test_code).otherwise(F.lit("pass"))
    return F.concat(code, F.lit("\n\n"), candidate, _as_function("body_check", body), F.lit("\n" + RUNNER),
                    F.lit("\nrun_checks([('body', body_check)])"))


def benchmark_script(code, test, entry_point) -> Column:
    """A script for benchmark tests that define their own ``check(candidate)``."""
    call = F.concat(F.lit("\nrun_checks([('check', lambda: check("), _c(entry_point), F.lit("))])"))
    return F.concat(_c(code), F.lit("\n\n"), _c(test), F.lit("\n\n" + RUNNER), call)
