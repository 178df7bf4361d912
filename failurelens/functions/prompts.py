"""Role prompts as columns: a request table for offline batch inference.

A :class:`Role` bundles a system prompt, a user template filled from columns
(with per-field defaults) and a Column-returning response parser.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failurelens.functions import responses as rs
from failurelens.functions.text import _fill

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------
PLANNER_SYSTEM = """You are an expert algorithm designer. Given a coding problem, your job is to:

1. Understand the problem requirements completely.
2. Identify edge cases and constraints.
3. Design an optimal algorithmic approach.
4. Estimate time and space complexity.

You must respond in valid JSON with exactly these keys:
{
    "algorithm_strategy": "description of the algorithm approach",
    "complexity_estimate": "time and space complexity",
    "edge_cases": ["edge case 1", "edge case 2", ...],
    "key_observations": "important observations about the problem"
}

Be precise and concise. Focus on correctness first, then efficiency."""

PLANNER_USER = """## Coding Problem

{task}

---

Analyze this problem and provide your algorithmic plan as JSON."""

CODER_SYSTEM = """You are a Python programmer. Given a coding problem and an algorithmic plan, \
write a complete, correct Python function that solves the problem.

Rules:
- Write ONLY the function implementation — no test code, no examples.
- Follow the function signature given in the problem exactly.
- Handle all edge cases identified in the plan.
- Use clear variable names and add brief inline comments for complex logic.
- Wrap your code in a ```python code block."""

CODER_USER = """## Problem

{task}

## Algorithmic Plan

{plan}

---

Write a complete Python function that solves this problem. \
Output ONLY the function in a ```python code block."""

DEBUGGER_SYSTEM = """You are an expert Python debugger. You receive:
- The original coding problem
- The student's failed code
- The execution output (stderr, stdout, test results)

Your job is to:
1. Identify the exact root cause of the failure.
2. Explain why the code fails.
3. Propose a concrete fix.
4. Write the corrected code.

Respond in valid JSON:
{
    "root_cause": "what exactly went wrong",
    "error_category": "Syntax | Runtime | Logic | EdgeCases | AlgorithmDesign | Efficiency",
    "detailed_explanation": "step-by-step explanation of the bug",
    "suggested_fix_strategy": "how to fix it",
    "repaired_code": "the complete corrected Python function"
}

The repaired_code must be a complete, standalone function — not a diff or patch."""

DEBUGGER_USER = """## Original Problem

{task}

## Algorithmic Plan

{plan}

## Student's Failed Code

```python
{failed_code}
```

## Execution Result

- Return code: {returncode}
- Passed: {passed}/{total} tests
- Error type: {error_type}

### Stderr
```
{stderr}
```

### Stdout
```
{stdout}
```

### Traceback
```
{traceback}
```

---

Identify the root cause and provide a corrected implementation as JSON."""

CRITIC_SYSTEM = """You are a code review critic. You validate whether a proposed repair is correct.

You receive:
- The original problem
- The student's original (failed) code
- The debugger's repaired code
- The original execution errors

Your responsibilities:
1. Verify the repair actually addresses the root cause.
2. Check for hallucinated or unnecessary changes.
3. Ensure the repaired code would pass all test cases.
4. Flag any remaining issues.

Respond in valid JSON:
{
    "is_valid": true/false,
    "confidence": 0.0 to 1.0,
    "issues_found": ["issue 1", ...],
    "reasoning": "explanation of your assessment",
    "suggested_improvements": "any further improvements, or empty string"
}"""

CRITIC_USER = """## Original Problem

{task}

## Student's Original Code (FAILED)

```python
{failed_code}
```

## Execution Errors

- Error type: {error_type}
- Stderr: {stderr}

## Proposed Repair

```python
{repaired_code}
```

## Debugger's Reasoning

{repair_reasoning}

---

Validate this repair and respond as JSON."""


@dataclass
class Role:
    """Extension hook: system prompt, user template + defaults, response parser."""
    name: str
    system: str
    user_template: str
    defaults: dict[str, str] = field(default_factory=dict)
    parse: Callable[[Column], Column] | None = None

    def user_expr(self, **cols) -> Column:
        filled = {}
        for slot in _slots(self.user_template):
            c = cols.get(slot)
            c = F.col(c) if isinstance(c, str) else c
            default = F.lit(self.defaults[slot]) if slot in self.defaults else None
            if c is None:
                if default is None:
                    raise ValueError(f"role {self.name}: no column for required field {slot!r}")
                c = default
            elif default is not None:
                c = F.coalesce(c.cast("string"), default)
            filled[slot] = c.cast("string")
        return _fill(self.user_template, **filled)

    def messages(self, **cols) -> Column:
        return F.array(F.struct(F.lit("system").alias("role"), F.lit(self.system).alias("content")),
                       F.struct(F.lit("user").alias("role"), self.user_expr(**cols).alias("content")))


def _slots(template: str) -> list[str]:
    out, i = [], 0
    while True:
        i = template.find("{", i)
        if i < 0:
            return out
        j = template.index("}", i)
        out.append(template[i + 1:j])
        i = j + 1


def slots(role: Role) -> list[str]:
    """The columns that a role's user template takes."""
    return list(dict.fromkeys(_slots(role.user_template)))


PLANNER = Role("planner", PLANNER_SYSTEM, PLANNER_USER, parse=rs.planner_output)
CODER = Role("coder", CODER_SYSTEM, CODER_USER, defaults={"plan": "No plan provided."}, parse=rs.coder_output)
DEBUGGER = Role("debugger", DEBUGGER_SYSTEM, DEBUGGER_USER,
                defaults={"plan": "", "returncode": "-1", "passed": "0", "total": "0", "error_type": "Unknown",
                          "stderr": "", "stdout": "", "traceback": ""}, parse=rs.debugger_output)
CRITIC = Role("critic", CRITIC_SYSTEM, CRITIC_USER,
              defaults={"error_type": "Unknown", "stderr": "", "repair_reasoning": ""}, parse=rs.critic_output)
ROLES = {r.name: r for r in (PLANNER, CODER, DEBUGGER, CRITIC)}


def request_table(df: DataFrame, role: Role, id_col: str, **cols) -> DataFrame:
    """One chat request per row: ``(id, role, messages)``. Narrow, no shuffle."""
    return df.select(F.col(id_col).alias("request_id"), F.lit(role.name).alias("role"),
                     role.messages(**cols).alias("messages"))
