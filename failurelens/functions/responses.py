"""Parsing recorded model responses into typed columns (VARIANT-based, JVM-side).

A response parses when the whole text is one JSON document; otherwise its
first fenced code block is tried; otherwise it is unparsed. Only JSON objects
count as structured output (a list or a bare string is treated as unparsed).
Duplicate keys resolve last-wins (``spark.sql.variant.allowDuplicateKeys``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from failurelens.functions.text import extract_code_block, let

# Fallback texts of the role parsers.
PLANNER_UNKNOWN_COMPLEXITY = "Unknown"
DEBUGGER_FALLBACK_ROOT_CAUSE = "Could not parse structured response"
DEBUGGER_FALLBACK_FIX = "See raw response"
CRITIC_FALLBACK_ISSUE = "Could not parse critic response"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


_SENTINEL_ESC = "\\u0001"   # JSON escape text of U+0001
_SENTINEL = "\u0001"


def _strict_two_parse(t: Column) -> Column:
    """Exact test with two parses (used when the text mentions the sentinel).

    ``try_parse_json`` ignores text after a complete top-level value, so the
    text wrapped as ``[t]`` must give one element and wrapped as an object
    value ``{"v":t}`` must parse as well; together they reject any trailing or
    partial document.
    """
    def check(as_list: Column) -> Column:
        one = F.coalesce(F.size(F.try_variant_get(as_list, "$", "array<variant>")), F.lit(0)) == 1
        as_value = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}"))).isNotNull()
        return F.when(one & as_value, F.try_variant_get(as_list, "$[0]", "variant"))
    return let(F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))), check)


def strict_json_object(text) -> Column:
    """VARIANT of ``text`` if the whole text is exactly one JSON object, else null.

    One parse of ``[t,"\\u0001"]``: the result has exactly two elements, the
    second being U+0001, only if ``t`` was consumed as one complete value (a
    premature ``]`` inside ``t`` would end the array before the sentinel). Texts
    containing the sentinel (raw or escaped) take the two-parse test instead.
    A single valid document is an object exactly when it starts with '{'.
    """
    t = _c(text)
    is_obj = t.rlike(r"^[ \t\n\r]*\{")
    mentions = (F.instr(t, _SENTINEL) > 0) | (F.instr(t, _SENTINEL_ESC) > 0)

    def check(parsed: Column) -> Column:
        items = F.try_variant_get(parsed, "$", "array<variant>")
        ok = (F.coalesce(F.size(items), F.lit(0)) == 2) & \
            (F.coalesce(F.try_variant_get(parsed, "$[1]", "string"), F.lit("")) == _SENTINEL)
        return F.when(ok, F.try_variant_get(parsed, "$[0]", "variant"))
    fast = let(F.try_parse_json(F.concat(F.lit("["), t, F.lit(',"' + _SENTINEL_ESC + '"]'))), check)
    return F.when(is_obj, F.when(mentions, _strict_two_parse(t)).otherwise(fast))


def parse_response_json(text) -> Column:
    """Whole text as JSON, else its first code block as JSON, else null."""
    t = _c(text)
    fenced = F.instr(t, "```") > 0
    return F.coalesce(strict_json_object(t), F.when(fenced, strict_json_object(extract_code_block(t))))


def with_parsed(df, text_col: str = "response", out_col: str = "parsed"):
    """Add the parsed JSON (VARIANT) once, for the role parsers to share."""
    return df.withColumn(out_col, parse_response_json(text_col))


def _get(v: Column, field: str, typ: str) -> Column:
    return F.try_variant_get(v, f"$.{field}", typ)


def _str_field(v: Column, field: str, default: str) -> Column:
    return F.coalesce(_get(v, field, "string"), F.lit(default))


def planner_output(text, parsed=None) -> Column:
    """PlanOutput struct; unparsed -> strategy = raw text, complexity 'Unknown'."""
    t = _c(text)
    v = parse_response_json(t) if parsed is None else _c(parsed)
    ok = v.isNotNull()
    return F.struct(
        F.when(ok, _str_field(v, "algorithm_strategy", "")).otherwise(t).alias("algorithm_strategy"),
        F.when(ok, _str_field(v, "complexity_estimate", PLANNER_UNKNOWN_COMPLEXITY))
        .otherwise(F.lit(PLANNER_UNKNOWN_COMPLEXITY)).alias("complexity_estimate"),
        F.when(ok, F.coalesce(_get(v, "edge_cases", "array<string>"), F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>")).alias("edge_cases"),
        F.when(ok, _str_field(v, "key_observations", "")).otherwise(F.lit("")).alias("key_observations"),
    )


def debugger_output(text, parsed=None) -> Column:
    """(analysis struct, repaired_code); unparsed -> fallback analysis with the first
    500 characters and the response's code block as the repair."""
    t = _c(text)
    v = parse_response_json(t) if parsed is None else _c(parsed)
    ok = v.isNotNull()
    code = _str_field(v, "repaired_code", "")
    code = F.when(code.contains("```"), extract_code_block(code)).otherwise(code)
    analysis = F.when(ok, F.struct(
        _str_field(v, "root_cause", "").alias("root_cause"),
        _str_field(v, "error_category", "Unknown").alias("error_category"),
        _str_field(v, "detailed_explanation", "").alias("detailed_explanation"),
        _str_field(v, "suggested_fix_strategy", "").alias("suggested_fix_strategy"),
        _str_field(v, "relevant_code_section", "").alias("relevant_code_section"),
    )).otherwise(F.struct(
        F.lit(DEBUGGER_FALLBACK_ROOT_CAUSE).alias("root_cause"),
        F.lit("Unknown").alias("error_category"),
        F.substring(t, 1, 500).alias("detailed_explanation"),
        F.lit(DEBUGGER_FALLBACK_FIX).alias("suggested_fix_strategy"),
        F.lit("").alias("relevant_code_section"),
    ))
    return F.struct(analysis.alias("analysis"),
                    F.when(ok, code).otherwise(extract_code_block(t)).alias("repaired_code"))


def critic_output(text, parsed=None) -> Column:
    """Critic verdict; unparsed -> not valid, confidence 0, one issue."""
    t = _c(text)
    v = parse_response_json(t) if parsed is None else _c(parsed)
    ok = v.isNotNull()
    return F.when(ok, F.struct(
        F.coalesce(_get(v, "is_valid", "boolean"), F.lit(False)).alias("is_valid"),
        F.coalesce(_get(v, "confidence", "double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(_get(v, "issues_found", "array<string>"), F.array().cast("array<string>")).alias("issues_found"),
        _str_field(v, "reasoning", "").alias("reasoning"),
        _str_field(v, "suggested_improvements", "").alias("suggested_improvements"),
    )).otherwise(F.struct(
        F.lit(False).alias("is_valid"),
        F.lit(0.0).alias("confidence"),
        F.array(F.lit(CRITIC_FALLBACK_ISSUE)).alias("issues_found"),
        F.substring(t, 1, 500).alias("reasoning"),
        F.lit("").alias("suggested_improvements"),
    ))


def coder_output(text) -> Column:
    """Coder response -> code (first fenced block, else the whole text)."""
    return extract_code_block(_c(text))
