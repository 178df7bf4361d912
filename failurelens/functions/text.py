"""Text-building and label expressions (all built-in functions, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from failurelens.schemas import ALL_LABELS, UNKNOWN_CLUSTER

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
EMBED_INSTRUCTION = ("Represent this programming traceback and source code failure "
                     "for clustering error categories: ")

DISTILL_SYSTEM = ("You are a Python programmer who learns from mistakes. Given a coding problem, "
                  "an algorithmic plan, and a previous failed attempt with its error analysis, "
                  "write a corrected solution.")
DISTILL_USER_TEMPLATE = (
    "## Problem\n\n{problem}\n\n"
    "## Plan\n\n{plan}\n\n"
    "## Previous Failed Attempt\n\n```python\n{failed_code}\n```\n\n"
    "## What Went Wrong\n\n{repair_reasoning}\n\n"
    "## Task\n\nWrite the corrected Python function."
)
DISTILL_ASSISTANT_TEMPLATE = "```python\n{repaired_code}\n```"
NO_PLAN_PLACEHOLDER = "No plan available."

FENCE = "```"
WS_TRIM = r"(?U)^\s+|\s+$"


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x)


def py_strip(x) -> Column:
    """Strip leading/trailing Unicode whitespace like Python's ``str.strip``."""
    return F.regexp_replace(_c(x), WS_TRIM, "")


def left(x, n: int) -> Column:
    """First ``n`` characters (code points), like Python ``s[:n]``."""
    return F.substring(_c(x), 1, n)


def failure_text(task, code, error_type, stderr, traceback, task_limit: int = 200,
                 traceback_limit: int = 500, stderr_limit: int = 300, code_limit: int = 300) -> Column:
    """Structured failure description; empty traceback/stderr lines are dropped."""
    tb, se = F.coalesce(_c(traceback), F.lit("")), F.coalesce(_c(stderr), F.lit(""))
    et = F.coalesce(F.nullif(_c(error_type), F.lit("")), F.lit("Unknown"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Task: "), left(F.coalesce(_c(task), F.lit("")), task_limit)),
        F.concat(F.lit("Error Type: "), et),
        F.when(tb != "", F.concat(F.lit("Traceback: "), left(tb, traceback_limit))),
        F.when(se != "", F.concat(F.lit("Stderr: "), left(se, stderr_limit))),
        F.concat(F.lit("Code Snippet: "), left(F.coalesce(_c(code), F.lit("")), code_limit)),
    )


def failing_code(repaired_code, student_code) -> Column:
    """Repaired code when non-empty, else the student's code."""
    return F.coalesce(F.nullif(_c(repaired_code), F.lit("")), _c(student_code))


def embed_input(text, instruction: str = EMBED_INSTRUCTION) -> Column:
    """Embedding model input: instruction prefix + text."""
    return F.concat(F.lit(instruction), _c(text))


def canonical_cluster(label, mode: str = "lenient") -> Column:
    """Map a label onto the cluster domain; unknown values -> 'Unknown'.

    lenient: trims Unicode whitespace and ignores case; strict: exact match.
    """
    x = _c(label)
    if mode == "strict":
        return F.when(x.isin(*ALL_LABELS), x).otherwise(F.lit(UNKNOWN_CLUSTER))
    if mode != "lenient":
        raise ValueError(f"unknown mode {mode!r}")
    key = F.lower(py_strip(x))
    mapping = F.create_map(*[v for name in ALL_LABELS for v in (F.lit(name.lower()), F.lit(name))])
    return F.coalesce(F.try_element_at(mapping, key), F.lit(UNKNOWN_CLUSTER))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Expressions built in Python are trees: a sub-expression used three times
    is evaluated three times. Binding it through a one-element ``transform``
    evaluates it once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def extract_code_block(text) -> Column:
    """First fenced code block; an unclosed fence runs to the end.

    No fence, or an empty block, returns the whole text. Lines split on '\\n';
    the lines and the fence flags are computed once per row.
    """
    t = _c(text)

    def on_lines(lines: Column) -> Column:
        def on_first(first: Column) -> Column:
            rest = F.slice(lines, (first + 1).cast("int"), F.greatest(F.size(lines) - first, F.lit(0)).cast("int"))

            def on_rest(r: Column) -> Column:
                second = F.array_position(F.transform(r, lambda l: l.rlike(r"(?U)^\s*```")), True)
                body = F.when(second > 0, F.slice(r, 1, F.greatest(second - 1, F.lit(0)).cast("int"))).otherwise(r)
                return F.when((first > 0) & (F.size(body) > 0), F.array_join(body, "\n")).otherwise(t)
            return let(rest, on_rest)
        return let(F.array_position(F.transform(lines, lambda l: l.rlike(r"(?U)^\s*```")), True), on_first)
    # no fence anywhere -> the text itself, without splitting it into lines
    return F.when(F.instr(t, FENCE) > 0, let(F.split(t, "\n", -1), on_lines)).otherwise(t)


def plan_text(strategy, complexity, edge_cases, observations) -> Column:
    """Plan text: strategy, complexity, comma-joined edge cases, observations."""
    return F.concat(
        F.lit("Strategy: "), _c(strategy),
        F.lit("\nComplexity: "), _c(complexity),
        F.lit("\nEdge Cases: "), F.coalesce(F.array_join(_c(edge_cases), ", "), F.lit("")),
        F.lit("\nObservations: "), _c(observations),
    )


def repair_reasoning_text(root_cause, category, fix, is_valid) -> Column:
    """Repair reasoning summary with the critic's verdict."""
    return F.concat(
        F.lit("Root cause: "), _c(root_cause),
        F.lit("\nCategory: "), _c(category),
        F.lit("\nFix: "), _c(fix),
        F.lit("\nCritic verdict: "),
        F.when(F.coalesce(_c(is_valid), F.lit(False)), F.lit("Valid")).otherwise(F.lit("Invalid")),
    )


def _fill(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` slots of a fixed template with columns (no format-string parsing of data)."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(F.coalesce(cols[rest[i + 1:j]], F.lit("")))
        rest = rest[j + 1:]
    return F.concat(*parts)


def chat_messages(problem="problem", plan="plan", failed_code="failed_code",
                  repair_reasoning="repair_reasoning", repaired_code="repaired_code") -> Column:
    """Training example -> [system, user, assistant] chat messages."""
    user = _fill(DISTILL_USER_TEMPLATE, problem=_c(problem),
                 plan=F.coalesce(F.nullif(_c(plan), F.lit("")), F.lit(NO_PLAN_PLACEHOLDER)),
                 failed_code=_c(failed_code), repair_reasoning=_c(repair_reasoning))
    assistant = _fill(DISTILL_ASSISTANT_TEMPLATE, repaired_code=_c(repaired_code))
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(msg("system", F.lit(DISTILL_SYSTEM)), msg("user", user), msg("assistant", assistant))


def fixed4(value) -> Column:
    """A double with four decimals, its binary value rounded once, ties to even, as C does it.

    10**4 times the value is taken as a product and its exact error (Dekker's splitting),
    so that 0.00015, which is stored a little lower, gives 0.0001. From 1e11 on, where the
    product has no more decimals to round, ``format_string`` writes the value.
    """
    def rounded(x: Column) -> Column:
        def with_parts(s: Column) -> Column:
            high, low, product = s["high"], s["low"], s["product"]
            error = ((high * 10000.0 - product) + low * 10000.0)  # exact: 10**4 has 14 bits
            floor = F.floor(product)
            beyond = (product - floor) - 0.5  # exact below 2**52
            even = floor % 2 == 0
            up = (beyond > 0) | ((beyond == 0) & ((error > 0) | ((error == 0) & ~even)))
            units = F.when(up, floor + 1).otherwise(floor)
            text = units.cast("decimal(20,0)").cast("string")
            padded = F.lpad(text, F.greatest(F.length(text), F.lit(5)), "0")
            return F.concat(F.substring(padded, F.lit(1), F.length(padded) - 4), F.lit("."),
                            F.substring(padded, F.length(padded) - 3, F.lit(4)))
        split = x * 134217729.0  # 2**27 + 1
        high = split - (split - x)
        return let(F.struct(high.alias("high"), (x - high).alias("low"), (x * 10000.0).alias("product")), with_parts)

    v = _c(value).cast("double")
    small = F.abs(v) < 1e11
    return (F.when(small, F.concat(F.when((v < 0) | (v.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit("")),
                                   let(F.abs(v), rounded)))
            .otherwise(F.format_string("%.4f", v)))


def metric_cell(value, integral=None) -> Column:
    """Report cell: a whole-number metric (flag ``integral``) as it is, else 4 decimals; missing -> 'N/A'."""
    v = _c(value)
    number = fixed4(v)
    if integral is not None:
        number = F.when(F.coalesce(_c(integral), F.lit(False)), v.cast("decimal(38,0)").cast("string")).otherwise(number)
    return F.coalesce(F.when(v.isNotNull(), number), F.lit("N/A"))


def fingerprint(text, n: int = 16) -> Column:
    """First ``n`` hex digits of SHA-256 of the text."""
    return F.substring(F.sha2(_c(text), 256), 1, n)


def iso_utc(ts) -> Column:
    """Timestamp -> ISO-8601 text with microseconds (session time zone UTC)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
