"""Ordered line operations on arrays of lines: order is kept without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_ansi, truncate


def to_lines(text: Column) -> Column:
    """The lines of a text; a last line end makes no further line, and carriage returns before line ends go."""
    whole = F.regexp_replace(text, "\r\n", "\n")
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(whole, "\r?\n\\z", ""), "\n"))


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def strip_matching(lines: Column, patterns: list[str]) -> Column:
    return F.filter(lines, lambda l: ~l.rlike(_any(patterns))) if patterns else lines


def keep_matching(lines: Column, patterns: list[str]) -> Column:
    return F.filter(lines, lambda l: l.rlike(_any(patterns))) if patterns else lines


def _note(n: Column, what: str) -> Column:
    return F.array(F.concat(F.lit("... ("), n.cast("string"), F.lit(f" lines {what})")))


def head_tail(lines: Column, head: int | None = None, tail: int | None = None) -> Column:
    """The first and last lines, with a note of how many were left out."""
    if head is None and tail is None:
        return lines
    first = F.slice(lines, 1, head) if head else F.array().cast("array<string>")
    keep = (head or 0) + (tail or 0)
    last = F.slice(lines, -tail, tail) if tail else F.array().cast("array<string>")
    return F.when(F.size(lines) > keep, F.concat(first, _note(F.size(lines) - keep, "omitted"), last)).otherwise(lines)


def at_most(lines: Column, most: int) -> Column:
    return F.when(F.size(lines) > most, F.concat(F.slice(lines, 1, most), _note(F.size(lines) - most, "truncated"))).otherwise(lines)


def window(lines: Column, head: int | None = None, tail: int | None = None) -> Column:
    """The last `tail` lines, or the first `head`, without a note."""
    if tail is not None:
        return F.when(F.size(lines) > tail, F.slice(lines, -tail, tail) if tail else F.array().cast("array<string>")).otherwise(lines)
    return F.slice(lines, 1, head) if head is not None else lines


def numbered(lines: Column) -> Column:
    width = F.length(F.size(lines).cast("string"))
    return F.transform(lines, lambda l, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit(" │ "), l))


@dataclass(frozen=True)
class Rule:
    """A declarative filter; stages run in the order of the fields."""

    name: str
    match_command: str
    strip_ansi: bool = False
    replace: list[tuple[str, str]] = field(default_factory=list)
    match_output: list[tuple[str, str, str | None]] = field(default_factory=list)
    strip: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    truncate_at: int | None = None
    head: int | None = None
    tail: int | None = None
    most: int | None = None
    on_empty: str | None = None

    def __post_init__(self) -> None:
        if self.strip and self.keep:
            raise ValueError(f"{self.name}: strip and keep exclude each other")


def _replaced(lines: Column, pattern: str, by: str) -> Column:
    return F.transform(lines, lambda l: F.regexp_replace(l, pattern, by))


def reduced(text: Column, rule: Rule) -> Column:
    """The text after all stages of a rule. Patterns are Unicode-aware ((?U)) as far as they ask for classes."""
    lines = to_lines(text)
    if rule.strip_ansi:
        lines = F.transform(lines, strip_ansi)
    for pattern, by in rule.replace:
        lines = _replaced(lines, pattern, by)
    blob = joined(lines)
    kept = strip_matching(keep_matching(lines, rule.keep), rule.strip)
    if rule.truncate_at is not None:
        kept = F.transform(kept, lambda l: truncate(l, rule.truncate_at))
    kept = head_tail(kept, rule.head, rule.tail)
    if rule.most is not None:
        kept = at_most(kept, rule.most)
    out = joined(kept)
    if rule.on_empty is not None:
        out = F.when(F.trim(F.regexp_replace(out, r"\s", "")) == "", F.lit(rule.on_empty)).otherwise(out)
    for pattern, message, unless in reversed(rule.match_output):
        hit = blob.rlike(pattern) & (~blob.rlike(unless) if unless else F.lit(True))
        out = F.when(hit, F.lit(message)).otherwise(out)
    return out


def first_rule(command: Column, rules: list[Rule]) -> Column:
    """The name of the first rule whose pattern matches, in the order given; null for none."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        found = F.when(command.rlike(rule.match_command), F.lit(rule.name)).otherwise(found)
    return found


def reduce_outputs(command: Column, text: Column, rules: list[Rule]) -> Column:
    """The output under the first rule that fits its command, or as it is."""
    out = text
    for rule in reversed(rules):
        out = F.when(command.rlike(rule.match_command), reduced(text, rule)).otherwise(out)
    return out


def without_comments(lines: Column, line: str, start: str | None = None, end: str | None = None, doc: str | None = None) -> Column:
    """Source lines without line and block comments; documentation comments stay, blank lines shrink to one."""

    def step(state: Column, raw: Column) -> Column:
        t = F.trim(raw)
        opens = (state["inside"] | (t.contains(start) & (~t.startswith(doc) if doc else F.lit(True)))) if start else F.lit(False)
        closes = t.contains(end) if end else F.lit(False)
        skip = opens | (t.startswith(line) & (~t.startswith(doc) if doc else F.lit(True)))
        return F.struct((opens & ~closes).alias("inside"), F.when(skip, state["out"]).otherwise(F.concat(state["out"], F.array(F.when(t == "", "").otherwise(raw)))).alias("out"))

    state = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))
    text = F.aggregate(lines, state, step, lambda s: joined(s["out"]))
    return F.trim(F.regexp_replace(text, "\n{3,}", "\n\n"))


def error_blocks(lines: Column, pattern: str = r"(?i)^(error|fatal|panic|traceback|exception)|\berror\b[:\[]|\bFAILED\b") -> Column:
    """Lines that report errors, each with the indented lines that follow; two blank lines or other text end a block."""

    def step(state: Column, raw: Column) -> Column:
        hit, blank = raw.rlike(pattern), F.trim(raw) == ""
        blanks = F.when(blank, state["blanks"] + 1).otherwise(0)
        stays = state["open"] & ((blank & (blanks < 2)) | raw.rlike(r"^\s+\S"))
        keep = hit | stays
        return F.struct(keep.alias("open"), blanks.alias("blanks"), F.when(keep, F.concat(state["out"], F.array(raw))).otherwise(state["out"]).alias("out"))

    state = F.struct(F.lit(False).alias("open"), F.lit(0).alias("blanks"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(lines, state, step, lambda s: s["out"])


#: How imports, signatures and constants begin in an outline.
IMPORTS = r"^(use |import |from |require\(|#include)"
SIGNATURES = r"^(pub\s+)?(async\s+)?(fn|def|function|func|class|struct|enum|trait|interface|type)\s+\w+"
CONSTANTS = ("const ", "static ", "let ", "pub const ", "pub static ")
#: Our own pattern: lines that a shortened source keeps.
IMPORTANT = r"^\s*(use |import |from |pub |fn |def |class |struct |enum |trait |interface |export |func )|^[{}]"


def outline(lines: Column) -> Column:
    """Imports, signatures and outer constants of source lines. Of a signature's body only braces that open or close at
    its outer level stay; where it ends with other text than a brace, a note stands for it."""
    braces = lambda t, sign: F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit("")))

    def step(state: Column, line: Column) -> Column:
        t = F.trim(line)
        depth = state["depth"] + braces(t, "{") - braces(t, "}")
        edge = (depth <= 1) & (t.isin("{", "}") | t.endswith("{"))
        note = (depth <= 0) & ~t.isin("", "}")
        inner = F.concat(F.when(edge, F.array(line)).otherwise(F.array().cast("array<string>")), F.when(note, F.array(F.lit("    // ... implementation"))).otherwise(F.array().cast("array<string>")))
        constant = F.lit(False)
        for start in CONSTANTS:
            constant = constant | t.startswith(start)
        made = lambda inside, depth, more: F.struct(inside.alias("inside"), depth.alias("depth"), F.when(F.size(more) > 0, F.concat(state["out"], more)).otherwise(state["out"]).alias("out"))
        return (
            F.when(t.rlike(IMPORTS), made(state["inside"], state["depth"], F.array(line)))
            .when(t.rlike(SIGNATURES), made(F.lit(True), F.lit(0), F.array(line)))
            .when(state["inside"], made(depth > 0, depth, inner))
            .when(constant, made(state["inside"], state["depth"], F.array(line)))
            .otherwise(state)
        )

    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(lines, start, step, lambda s: s["out"])


def important(lines: Column, most: int) -> Column:
    """At most `most` lines: the first half of them, then only signatures, imports and braces, and a note of the rest."""

    def step(state: Column, line: Column) -> Column:
        take = (F.size(state) < most // 2) | line.rlike(IMPORTANT)
        return F.when(take & (F.size(state) < most - 1), F.concat(state, F.array(line))).otherwise(state)

    kept = F.aggregate(lines, F.array().cast("array<string>"), step)
    note = F.array(F.concat(F.lit("// ... "), (F.size(lines) - F.size(kept)).cast("string"), F.lit(" more lines")))
    return F.when(F.size(lines) <= most, lines).otherwise(F.concat(kept, note))
