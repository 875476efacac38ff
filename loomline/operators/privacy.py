"""Sensitive data: scan, overlap resolution, policy, obfuscation and restoration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of personal data and technical context, with the confidence of a match.
PATTERNS = {
    "EMAIL": (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", 0.95),
    "PHONE": (r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", 0.80),
    "URL": (r"""https?://[^\s<>"')}\]]+""", 0.90),
    "HOST": (r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]*[a-zA-Z0-9])?\.)+(?:internal|local|corp|intra|private|lan)\b", 0.85),
    "IP": (r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 0.85),
    "MONEY": (r"(?:\$|€|£|¥|USD|EUR|GBP|CAD|AUD)\s?[\d,]+(?:\.\d{1,2})?", 0.90),
}
#: Addresses that tell nothing. Fixed values.
LOCAL, LOCAL_PREFIX = ("127.0.0.1", "0.0.0.0"), "255."
#: Secrets, by our own patterns.
SECRETS = {
    "PRIVATE_KEY": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0.99),
    "DATABASE_URL": (r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s:/@]+:[^\s@]+@[^\s\"'<>]+", 0.95),
    "JWT": (r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]+", 0.95),
    "API_KEY": (r"\b(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_\-]{20,}|xox[abp]-[A-Za-z0-9\-]{10,})", 0.95),
    "PASSWORD": (r"(?i:password|passwd|secret|token|api_?key)[\"']?[ \t]*[:=][ \t]*[\"']?[^\s\"',;]{6,}", 0.85),
}
#: The label in a placeholder where it isn't the kind, ranks that decide overlaps, and severities.
LABELS = dict.fromkeys(SECRETS, "SECRET")
PRIORITY = {"PRIVATE_KEY": 10, "DATABASE_URL": 9, "PASSWORD": 8, "JWT": 7, "API_KEY": 7}
LEVELS = ("none", "low", "medium", "high", "critical")
SEVERITY = {
    "PRIVATE_KEY": "critical", "DATABASE_URL": "critical", "API_KEY": "high", "JWT": "high", "PASSWORD": "high",
    "EMAIL": "medium", "PHONE": "medium", "IP": "medium", "HOST": "medium", "URL": "low", "MONEY": "low",
}
#: Below this confidence a severity is one level lower.
SURE = 0.6
#: What each mode leaves as it is; all else gets a placeholder.
ALLOWED = {"observe": tuple(SEVERITY), "developer": ("URL",), "balanced": (), "strict": ()}


#: Elements that are added up one by one; longer arrays are cut into such parts.
_PART = 64


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def running(lengths: Column) -> Column:
    """The running sums of an array of numbers: of each part by itself, on top of the sums of the parts before."""

    def summed(numbers: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(numbers) / _PART) - 1, F.lit(0))), lambda c: F.slice(numbers, (c * _PART + 1).cast("int"), _PART))
        add = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
        heads = lambda p: F.aggregate(p, F.array(F.lit(0)), lambda a, part: F.concat(a, F.array(F.element_at(a, -1) + add(part))))
        inside = lambda p, h: F.transform(p, lambda part, c: F.transform(part, lambda x, j: F.get(h, c) + add(F.slice(part, 1, j + 1))))
        return _bound(parts, lambda p: _bound(heads(p), lambda h: F.flatten(inside(p, h))))

    return _bound(lengths, summed)


_PLACED = "array<struct<start:int,rank:int,long:int,number:int,kind:string,value:string,end:int,confidence:double>>"
#: What every match of a kind holds, so that texts without it aren't searched.
SIGNS = {
    "EMAIL": "@", "PHONE": "[0-9]{4}", "URL": "https?://", "HOST": r"\.(?:internal|local|corp|intra|private|lan)", "IP": r"[0-9]\.[0-9]", "MONEY": r"[$€£¥]|USD|EUR|GBP|CAD|AUD",
    "PRIVATE_KEY": "-----BEGIN ", "DATABASE_URL": "://", "JWT": "eyJ", "API_KEY": "AKIA|gh[pousr]_|sk-|xox[abp]-", "PASSWORD": "password|passwd|secret|token|api_?key",
}


#: Signs that are plain strings, which are found faster than patterns.
STRINGS = {
    "EMAIL": ("@",), "URL": ("http://", "https://"), "HOST": (".internal", ".local", ".corp", ".intra", ".private", ".lan"),
    "MONEY": ("$", "€", "£", "¥", "USD", "EUR", "GBP", "CAD", "AUD"),
}
#: Patterns with the same matches that try a run of an address's letters once, and not again from each of them.
QUICK = {"EMAIL": r"(?:\G|(?<![a-zA-Z0-9._%+\-]))[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"}


def _holds(text: Column, kind: str) -> Column:
    """Whether a text holds the sign of a kind."""
    if kind in STRINGS:
        return reduce(Column.__or__, [F.contains(text, F.lit(s)) for s in STRINGS[kind]])
    return F.lower(text).rlike(SIGNS[kind]) if kind == "PASSWORD" else text.rlike(SIGNS[kind])


def _matches(text: Column, number: int, kind: str, pattern: str, confidence: float) -> Column:
    """A kind's findings. Their places follow from the lengths of what lies between matches and of the matches."""
    gaps, values = F.transform(F.split(text, pattern, -1), F.length), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(found: Column, between: Column) -> Column:
        ends = running(F.transform(found, lambda v, i: F.length(v) + F.get(between, i)))
        one = lambda e: lambda v, i: F.struct(
            (F.get(e, i) - F.length(v)).alias("start"), F.lit(-PRIORITY.get(kind, 1)).alias("rank"), (-F.length(v)).alias("long"), F.lit(number).alias("number"),
            F.lit(kind).alias("kind"), v.alias("value"), F.get(e, i).alias("end"), F.lit(confidence).alias("confidence"),
        )
        return _bound(ends, lambda e: F.transform(found, one(e)))

    found = _bound(values, lambda v: F.when(F.size(v) > 0, _bound(gaps, lambda g: placed(v, g))))
    found = F.coalesce(F.when(_holds(text, kind), found), F.array().cast(_PLACED))
    return F.filter(found, lambda f: ~f["value"].isin(*LOCAL) & ~f["value"].startswith(LOCAL_PREFIX)) if kind == "IP" else found


def findings(text: Column | str) -> Column:
    """Findings of a text by start, rank and length; offsets are characters, ends are exclusive; overlaps are kept."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    each = [_matches(whole, n, kind, pattern, confidence) for n, (kind, (pattern, confidence)) in enumerate((PATTERNS | SECRETS).items())]
    in_order = F.array_sort(F.concat(*each))
    return F.transform(in_order, lambda f: F.struct(f["kind"].alias("kind"), f["value"].alias("value"), f["start"].alias("start"), f["end"].alias("end"), f["confidence"].alias("confidence")))


def counts(text: Column, kind: str) -> Column:
    """How often a pattern matches, without Python; texts without a kind's sign aren't searched."""
    pattern = QUICK.get(kind) or (PATTERNS | SECRETS)[kind][0]
    return F.when(~_holds(text, kind), 0).otherwise(F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def without_overlaps(found: Column) -> Column:
    """Findings in their order, without those that begin before the one kept last ends."""

    def step(kept: Column, f: Column) -> Column:
        free = (F.size(kept) == 0) | (f["start"] >= F.coalesce(F.get(kept, F.size(kept) - 1)["end"], F.lit(0)))
        return F.when(free, F.concat(kept, F.array(f))).otherwise(kept)

    return _bound(found, lambda f: F.aggregate(f, F.slice(f, 1, 0), step))


def _looked_up(kind: Column, table: dict, otherwise) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.element_at(pairs, kind), F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def severity(kind: Column, confidence: Column) -> Column:
    """The severity of a kind, one level lower where the confidence is low; other kinds are low."""
    rank = _looked_up(kind, {k: LEVELS.index(v) for k, v in SEVERITY.items()}, 1)
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.when(confidence < SURE, F.greatest(rank - 1, F.lit(0))).otherwise(rank) + 1)


def action(kind: Column, mode: str) -> Column:
    """What a mode does about a kind: allow, or placeholder. No mode stops the text."""
    allowed = ALLOWED[mode]
    return F.when(kind.isin(*allowed) if allowed else F.lit(False), "allow").otherwise("placeholder")


def obfuscated(text: Column, found: Column, mode: str = "balanced") -> Column:
    """Struct of text and entries (placeholder, value): the span of each finding that the mode doesn't allow becomes
    {{LOM_LABEL_nnn}}, numbered by label from right to left. Each label's findings are numbered by their place among
    them; the text is put together once, from what lies between spans and the placeholders."""
    labels = sorted({LABELS.get(kind, kind) for kind in SEVERITY})
    label = lambda f: _looked_up(f["kind"], LABELS, f["kind"])

    def numbered(own: Column, name: str) -> Column:
        def one(f: Column, i: Column) -> Column:
            n = F.size(own) - i
            number = F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))
            return F.struct(f["start"].alias("start"), f["end"].alias("end"), F.concat(F.lit(f"{{{{LOM_{name}_"), number, F.lit("}}")).alias("placeholder"), f["value"].alias("value"))

        return F.transform(own, one)

    def of_label(chosen: Column, name: str) -> Column:
        return _bound(F.filter(chosen, lambda f: label(f) == name), lambda own: numbered(own, name))

    def written(marks: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(marks, i - 1)["end"]).otherwise(0)
        parts = F.transform(marks, lambda m, i: F.concat(F.substr(text, before(i) + 1, m["start"] - before(i)), m["placeholder"]))
        rest = F.when(F.size(marks) > 0, F.substr(text, F.element_at(marks, -1)["end"] + 1)).otherwise(text)
        entries = F.transform(F.reverse(marks), lambda m: F.struct(m["placeholder"].alias("placeholder"), m["value"].alias("value")))
        return F.struct(F.concat(F.array_join(parts, ""), rest).alias("text"), entries.alias("entries"))

    chosen = F.filter(found, lambda f: action(f["kind"], mode) != "allow")
    marks = _bound(chosen, lambda c: F.array_sort(F.concat(*[of_label(c, name) for name in labels])))
    return _bound(marks, written)


def restored(text: Column, entries: Column) -> Column:
    return F.aggregate(entries, text, lambda t, e: F.replace(t, e["placeholder"], e["value"]))


def report(found: DataFrame) -> DataFrame:
    """Findings by kind and severity of rows (kind, confidence)."""
    return found.groupBy("kind", severity(F.col("kind"), F.col("confidence")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def overall(reported: DataFrame) -> DataFrame:
    """One row: the findings of a report, and the highest of its severities (none where it is empty)."""
    rank = F.coalesce(F.max(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("severity"))), F.lit(1)).cast("int")
    return reported.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.element_at(F.array(*map(F.lit, LEVELS)), rank).alias("severity"))


def obfuscate_table(df: DataFrame, text: str, mode: str = "balanced") -> DataFrame:
    """The table with a column obfuscated; the map of placeholders stays inside the query."""
    rows = df.withColumn("_f", without_overlaps(findings(F.col(text))))
    return rows.withColumn(text, obfuscated(F.col(text), F.col("_f"), mode)["text"]).drop("_f")
