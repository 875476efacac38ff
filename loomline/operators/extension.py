"""Extension points: filters from configuration, self-tests, source strategies, tiered parsers, reducers as functions."""

from __future__ import annotations

import hashlib
import tomllib
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import builtin
from ..functions import lines as L
from ..functions.lines import Rule

#: The keys of a filter in a configuration file and the fields of a rule that they set.
KEYS = {
    "match_command": "match_command", "strip_ansi": "strip_ansi", "replace": "replace", "match_output": "match_output",
    "strip_lines_matching": "strip", "keep_lines_matching": "keep", "truncate_lines_at": "truncate_at", "head_lines": "head",
    "tail_lines": "tail", "max_lines": "most", "on_empty": "on_empty",
}


class FilterError(ValueError):
    """A configuration that isn't one of filters."""


def load_filters(config: str) -> list[Rule]:
    """The rules of a configuration text, in its order. An unknown key, a missing pattern, or lines that are both kept
    and stripped are errors."""
    try:
        tables = tomllib.loads(config).get("filters", {})
    except tomllib.TOMLDecodeError as e:
        raise FilterError(str(e)) from e
    rules = []
    for name, given in tables.items():
        known = {KEYS[k]: v for k, v in given.items() if k in KEYS}
        if unknown := set(given) - set(KEYS) - {"description", "filter_stderr"}:
            raise FilterError(f"{name}: unknown {', '.join(sorted(unknown))}")
        if "match_command" not in known:
            raise FilterError(f"{name}: match_command is missing")
        known["replace"] = [(r["pattern"], r["replacement"]) for r in known.get("replace", [])]
        known["match_output"] = [(m["pattern"], m["message"], m.get("unless")) for m in known.get("match_output", [])]
        try:
            rules.append(Rule(name, **known))
        except ValueError as e:
            raise FilterError(str(e)) from e
    return rules


def trusted(config: str, digests: set[str]) -> bool:
    """Whether a configuration's bytes are those that were once approved, by SHA-256."""
    return hashlib.sha256(config.encode()).hexdigest() in digests


def registry(project: str | None, digests: set[str], user: str | None = None, own: list[Rule] = builtin.FILTERS) -> tuple[list[Rule], list[str]]:
    """Rules in the order in which they are looked up (project, user, built-in), and warnings. A project's rules count
    only if trusted; a tier that can't be read is left out."""
    rules, warnings = [], []
    for tier, config in (("project", project), ("user", user)):
        if config is None:
            continue
        if tier == "project" and not trusted(config, digests):
            warnings.append("project: not trusted")
            continue
        try:
            rules += [replace(r, name=f"{tier}:{r.name}") for r in load_filters(config)]
        except FilterError as e:
            warnings.append(f"{tier}: {e}")
    return rules + own, warnings


def self_tests(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Cases (filter, input, expected) with what the filter makes of the input, and whether it is what is expected.
    Line ends at either end don't count."""
    trim = lambda c: F.regexp_replace(c, r"^\n+|\n+$", "")
    got = F.lit(None).cast("string")
    for rule in rules:
        got = F.when(F.col("filter") == rule.name, L.reduced(F.col("input"), rule)).otherwise(got)
    return df.withColumn("got", got).withColumn("passed", F.coalesce(trim(F.col("got")) == trim(F.col("expected")), F.lit(False)))


def run_filtered(outputs: DataFrame, rules: list[Rule], skip_failures: bool = False) -> DataFrame:
    """Captured runs (command, stdout, stderr, exit_code) with `shown`: both streams joined, under the first rule that
    fits; the output of failed runs stays raw on request."""
    whole = F.concat_ws("\n", F.nullif(F.col("stdout"), F.lit("")), F.nullif(F.col("stderr"), F.lit("")))
    shown = L.reduce_outputs(F.col("command"), whole, rules)
    return outputs.withColumn("shown", F.when(F.lit(skip_failures) & (F.col("exit_code") != 0), whole).otherwise(shown))


def by_function(outputs: DataFrame, f: Callable[[str], str], column: str = "output") -> DataFrame:
    """The column under a plain function of one text, by Arrow batches. Nulls stay."""

    def applied(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return outputs.withColumn(column, F.pandas_udf(applied, "string")(F.col(column)))


#: How much of a source text is kept, by level.
STRATEGIES: dict[str, Callable[[Column, str], Column]] = {
    "none": lambda text, comment: text,
    "minimal": lambda text, comment: L.without_comments(L.to_lines(text), comment),
    "aggressive": lambda text, comment: L.joined(L.outline(L.to_lines(L.without_comments(L.to_lines(text), comment)))),
}


def by_strategy(text: Column, level: str, comment: str = "//") -> Column:
    return STRATEGIES[level](text, comment)


#: Characters of a raw text that a parser which gives up passes on.
RAW = 2000


def tiered(text: Column, full: Column, degraded: Column, warning: str, raw: int = RAW) -> Column:
    """Struct of tier, data, warnings and raw: 1 with the data of a full parse, 2 with partial data and a warning, 3
    with the beginning of the text as it is and no data. full and degraded are of one type, null where they fail."""
    tier = F.when(full.isNotNull(), 1).when(degraded.isNotNull(), 2).otherwise(3)
    none = F.array().cast("array<string>")
    cut = F.when(F.length(text) > raw, F.concat(F.substring(text, 1, raw), F.lit("\n[truncated]"))).otherwise(text)
    return F.struct(
        tier.alias("tier"),
        F.coalesce(full, degraded).alias("data"),
        F.when(tier == 1, none).when(tier == 2, F.array(F.lit(warning))).otherwise(F.array(F.lit("not parsed"))).alias("warnings"),
        F.when(tier == 3, cut).alias("raw"),
    )


def test_counts(text: Column) -> Column:
    """Tests passed, failed and skipped by tiers: from a JSON report, else from a summary line."""
    kind = "struct<passed:int,failed:int,skipped:int>"
    report = F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "numPassedTests int, numFailedTests int, numPendingTests int")
    full = F.when(report["numPassedTests"].isNotNull(), F.struct(report["numPassedTests"], report["numFailedTests"], F.coalesce(report["numPendingTests"], F.lit(0))).cast(kind))
    number = lambda word: F.coalesce(F.regexp_extract(text, rf"(\d+) {word}", 1).try_cast("int"), F.lit(0))
    seen = text.rlike(r"\d+ (?:passed|failed)")
    degraded = F.when(seen, F.struct(number("passed"), number("failed"), number("skipped")).cast(kind))
    return tiered(text, full, degraded, "counts of the summary line")
