"""The transform rules: validated, chosen by source and table, compiled to columns.

Order within a rule: filters, renames and copies, casts with defaults,
requirements and validation, computed fields, masks, exclusions. Rules of lower
priority number go first. A column that the table doesn't have is a field that every
document lacks: filters see null, and other parts of a rule that name it are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import masks
from tidemark.functions.datetimes import parse_datetime
from tidemark.plans.expressions import ExpressionError, compile_expression

#: The rule language's type names.
TARGET_TYPES = {"int": "int", "long": "bigint", "keyword": "string", "text": "string", "float64": "double", "float32": "float", "bool": "boolean", "date": "timestamp"}
OPERATORS = ("eq", "ne", "in", "nin", "gt", "gte", "lt", "lte", "exists", "regex")
ERRORS = "_errors"


@dataclass
class RuleSet:
    rules: list[dict]
    templates: dict[str, dict] = field(default_factory=dict)
    null_strategy: str = "ignore"
    validation: bool = True
    computed: bool = True
    masking: bool = True

    @classmethod
    def from_config(cls, config: dict) -> RuleSet:
        g = config.get("global_settings", {})
        return cls(config.get("transform_rules", []), config.get("masking_templates", {}), g.get("default_null_strategy", "ignore"), g.get("enable_validation", True), g.get("enable_computed_fields", True), g.get("enable_masking", True))

    def chosen(self, table: str, source_id: str | None = None) -> list[dict]:
        """Enabled rules for a table, lowest priority number first; a rule without source is for all."""
        fits = [r for r in self.rules if r.get("enabled", True) and (source_id is None or r.get("source_id") in (None, "", source_id)) and any(fnmatchcase(table, p) for p in r.get("table_patterns", ["*"]))]
        return sorted(fits, key=lambda r: r.get("priority", 0))

    def problems(self) -> list[str]:
        """What is wrong with the rules, empty if nothing is."""
        found = []
        for n, r in enumerate(self.rules):
            name = r.get("id") or f"rule {n}"
            if not r.get("id"):
                found.append(f"{name}: no id")
            for m in r.get("field_mappings", []):
                if m.get("action") not in ("rename", "copy"):
                    found.append(f"{name}: unknown mapping action {m.get('action')!r}")
                if not m.get("source_field") or not m.get("target_field"):
                    found.append(f"{name}: a mapping needs source_field and target_field")
            for c in r.get("field_configs", []):
                if c.get("target_type") not in (None, *TARGET_TYPES):
                    found.append(f"{name}: unknown type {c['target_type']!r} of {c.get('field')}")
                if pattern := c.get("validation", {}).get("pattern"):
                    try:
                        re.compile(pattern)
                    except re.error as e:
                        found.append(f"{name}: bad pattern of {c.get('field')}: {e}")
            for m in r.get("masking_rules", []):
                if "template" in m and m["template"] not in self.templates:
                    found.append(f"{name}: unknown mask template {m['template']!r}")
                if "template" not in m and m.get("strategy") not in ("mask", "hash", "regex"):
                    found.append(f"{name}: unknown mask strategy {m.get('strategy')!r}")
            for c in r.get("computed_fields", []):
                try:
                    from tidemark.plans.expressions import tokens

                    tokens(c.get("expression", ""))
                except ExpressionError as e:
                    found.append(f"{name}: {e}")
            for f in r.get("filters", []):
                if f.get("operator") not in OPERATORS:
                    found.append(f"{name}: unknown operator {f.get('operator')!r}")
        return found


def predicate(value: Column, operator: str, operand) -> Column:
    """True, false and never null: a missing field differs from every value."""
    some = operand if isinstance(operand, list) else [operand]
    tests = {
        "eq": lambda: value.eqNullSafe(F.lit(operand)),
        "ne": lambda: ~value.eqNullSafe(F.lit(operand)),
        "in": lambda: F.coalesce(value.isin(some), F.lit(False)),
        "nin": lambda: ~F.coalesce(value.isin(some), F.lit(False)),
        "gt": lambda: F.coalesce(value > F.lit(operand), F.lit(False)),
        "gte": lambda: F.coalesce(value >= F.lit(operand), F.lit(False)),
        "lt": lambda: F.coalesce(value < F.lit(operand), F.lit(False)),
        "lte": lambda: F.coalesce(value <= F.lit(operand), F.lit(False)),
        "exists": lambda: value.isNotNull() == F.lit(bool(operand)),
        "regex": lambda: F.coalesce(value.cast("string").rlike(str(operand)), F.lit(False)),
    }
    return tests[operator]()


def cast_to(value: Column, target: str, source_type: str) -> Column:
    """A value that doesn't fit becomes null. Truth values read words and numbers; dates read all date formats."""
    if target == "bool" and source_type == "string":
        return F.when(F.lower(value).isin("1", "t", "true"), True).when(F.lower(value).isin("0", "f", "false"), False)
    if target == "date" and source_type == "string":
        return F.try_to_timestamp(parse_datetime(value))
    return value.try_cast(TARGET_TYPES[target])


def mask(value: Column, spec: dict) -> Column:
    p, text = spec.get("params", {}), value.cast("string")
    if spec["strategy"] == "mask":
        return masks.keep_ends(text, int(p.get("prefix", 0)), int(p.get("suffix", 0)), p.get("char", "*"))
    if spec["strategy"] == "hash":
        return masks.digest(text, p.get("algorithm", "sha256"))
    return masks.replace(text, p["pattern"], p["replace"])


def apply_rule(df: DataFrame, rule: dict, rules: RuleSet) -> DataFrame:
    """One rule over a table's rows; failures are collected in ``_errors``, an array of text."""
    has = lambda c: c in df.columns
    for f in rule.get("filters", []):
        keep = predicate(F.col(f["field"]) if has(f["field"]) else F.lit(None).cast("string"), f["operator"], f.get("value"))
        df = df.filter(~keep if f.get("action", "include") == "exclude" else keep)
    for m in rule.get("field_mappings", []):
        if m["source_field"] in df.columns:
            df = df.withColumnRenamed(m["source_field"], m["target_field"]) if m["action"] == "rename" else df.withColumn(m["target_field"], F.col(m["source_field"]))
    new, errors = {}, []
    for c in rule.get("field_configs", []):
        name = c["field"]
        if c.get("exclude"):
            continue
        if name not in df.columns:
            if c.get("default_value") is None:
                if c.get("required") and rules.validation:
                    errors.append(F.lit(f"{name}: required"))
                continue
            value = F.lit(c["default_value"])
            value = value.try_cast(TARGET_TYPES[c["target_type"]]) if c.get("target_type") else value
        else:
            kind = dict(df.dtypes)[name]
            value = cast_to(F.col(name), c["target_type"], kind) if c.get("target_type") else F.col(name)
            if c.get("default_value") is not None and c.get("null_strategy", "default") == "default":
                fallback = F.lit(c["default_value"])
                value = F.coalesce(value, fallback.try_cast(TARGET_TYPES[c["target_type"]]) if c.get("target_type") else fallback)
        new[name] = value
        if rules.validation:
            if c.get("required"):
                errors.append(F.when(value.isNull(), F.lit(f"{name}: required")))
            if check := c.get("validation"):
                errors.append(F.when(~value.cast("string").rlike(check["pattern"]), F.lit(f"{name}: {check.get('error_message', 'invalid')}")))
    old = [F.col(ERRORS)] if ERRORS in df.columns else []
    found = F.array_compact(F.concat(*old, F.array(*errors))) if errors else (old[0] if old else F.array().cast("array<string>"))
    df = df.withColumns({**new, ERRORS: found})
    if rules.computed:
        for c in rule.get("computed_fields", []):
            if all(d in df.columns for d in c.get("dependencies", [])):
                df = df.withColumn(c["field"], compile_expression(c["expression"]))
    if rules.masking:
        wanted = {m["field"]: mask(F.col(m["field"]), rules.templates[m["template"]] if "template" in m else m) for m in rule.get("masking_rules", []) if m["field"] in df.columns}
        df = df.withColumns(wanted) if wanted else df
    return df.drop(*[c["field"] for c in rule.get("field_configs", []) if c.get("exclude")])


def apply_rules(df: DataFrame, table: str, rules: RuleSet, source_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with ``_errors``); rows of a table without rules are all good."""
    for rule in rules.chosen(table, source_id):
        df = apply_rule(df, rule, rules)
    if ERRORS not in df.columns:
        return df, df.limit(0).withColumn(ERRORS, F.array().cast("array<string>"))
    return df.filter(F.size(ERRORS) == 0).drop(ERRORS), df.filter(F.size(ERRORS) > 0)
