"""Scalar functions over text, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns.
ANSI = "\x1b\\[[0-9;]*[a-zA-Z]"
STAMP = r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]?\d*\s*"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
HEX, LONG_NUMBER, PATH = r"0x[0-9a-fA-F]+", r"(?U)\b\d{4,}\b", r"(?U)/[\w./\-]+"


def estimate_tokens(text: Column) -> Column:
    """A token for every four bytes begun."""
    return F.ceil(F.octet_length(text) / 4.0).cast("long")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def truncate(text: Column, width: int) -> Column:
    """At most `width` characters, the last three of a longer text being dots."""
    short = F.lit("...") if width < 3 else F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    return F.when(F.length(text) <= width, text).otherwise(short)


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, n), " ")


def format_tokens(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def format_usd(x: Column) -> Column:
    return F.when((x > 0) & (x < 0.01), F.format_string("$%.4f", x)).otherwise(F.format_string("$%.2f", x))


def human_size(n: Column) -> Column:
    return F.when(n >= 1 << 20, F.format_string("%.1fM", n / float(1 << 20))).when(n >= 1024, F.format_string("%.1fK", n / 1024.0)).otherwise(F.concat(n.cast("string"), F.lit("B")))


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, F.format_string("%.1fs", ms / 1000.0)).otherwise(
        F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m"), F.floor(ms % 60_000 / 1000).cast("string"), F.lit("s"))
    )


def iso_date(stamp: Column) -> Column:
    return F.substring(stamp, 1, 10)


def epoch_ms(ms: Column) -> Column:
    """A time in UTC; years of five digits have no sign."""
    return F.regexp_replace(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'"), r"^\+", "")


def recency(stamp: Column, now: Column) -> Column:
    """1 within a day, 0.8 within a week, 0.5 within 30 days or where unknown, else 0.3."""
    days = F.datediff(now, stamp)
    return F.when(days.isNull(), 0.5).when(days <= 1, 1.0).when(days <= 7, 0.8).when(days <= 30, 0.5).otherwise(0.3)


def normalise_log(line: Column) -> Column:
    """A log line with its time cut off, and identifiers, numbers and paths replaced, in this order."""
    for pattern, mark in ((STAMP, ""), (UUID, "<UUID>"), (HEX, "<HEX>"), (LONG_NUMBER, "<NUM>"), (PATH, "<PATH>")):
        line = F.regexp_replace(line, pattern, mark)
    return F.trim(line)


def log_level(line: Column) -> Column:
    low = F.lower(line)
    return F.when(low.rlike("error|fatal|panic"), "error").when(low.contains("warn"), "warning").when(low.contains("info"), "info")


def identifier_tokens(text: Column) -> Column:
    """Lower-case words of identifiers and their camel-case parts of two bytes or more, without repeats, in order."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    parts = lambda w: F.split(w, r"(?<=[^\p{Lu}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
    both = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), parts(w))))
    return F.array_distinct(F.transform(F.filter(both, lambda w: F.octet_length(w) >= 2), lambda w: F.lower(w)))


def path_tokens(path: Column) -> Column:
    return identifier_tokens(F.regexp_replace(path, r"\.[^./]*$", ""))


def normalise_content(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def short_id(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, length)


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters; 1 for two empty texts."""
    sets = [F.array_distinct(F.filter(F.split(c, ""), lambda x: x != "")) for c in (a, b)]
    either = F.size(F.array_union(*sets))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(*sets)) / either)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a pattern of * and ?."""
    escaped = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and ord(c) < 128 else c for c in pattern)
    return f"(?s)^{escaped}$"


#: Languages by file extension.
LANGUAGES = {
    "rs": "rust", "py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "java": "java", "rb": "ruby", "sh": "shell", "bash": "shell", "zsh": "shell", "json": "data", "yaml": "data", "yml": "data", "toml": "data", "xml": "data", "csv": "data",
}


def language_of(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), extension), F.lit("unknown"))


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def top_module(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


#: Parts of the names of sensitive variables.
SENSITIVE = ("key", "secret", "password", "token", "credential", "auth", "private", "api_key", "access_key", "passwd", "jwt")


def masked(key: Column, value: Column) -> Column:
    """The value of a sensitive variable with all but two characters at either end hidden."""
    secret = F.lower(key).rlike("|".join(SENSITIVE))
    return F.when(secret & (F.length(value) <= 4), "****").when(secret, F.concat(F.left(value, F.lit(2)), F.lit("****"), F.right(value, F.lit(2)))).otherwise(value)


def client_id(text: Column) -> Column:
    clean = F.substring(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9_-]", ""), 1, 32)
    return F.when(F.coalesce(clean, F.lit("")) == "", "default").otherwise(clean)


#: Words that tell what an output is.
TEST_WORDS, BUILD_WORDS = ("passed", "failed", "ok"), ("compiling", "building", "finished")
LOG_WORDS = ("error:", "warn:", "info:", r"\[error\]", r"\[info\]")


def output_kind(text: Column) -> Column:
    """What an output looks like: tests, then a build, a log, JSON, a list, or anything."""
    low, first = F.lower(text), F.ltrim(text)
    return (
        F.when(low.contains("test") & low.rlike("|".join(TEST_WORDS)), "test")
        .when(low.rlike("|".join(BUILD_WORDS)), "build")
        .when(low.rlike("|".join(LOG_WORDS)), "log")
        .when(first.startswith("{") | first.startswith("["), "json")
        .when(F.forall(F.split(text, "\n"), lambda l: (F.length(l) < 200) & ~l.contains("\t")), "list")
        .otherwise("generic")
    )


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\{\{LOM_[A-Z0-9_]+\}\}"), F.lit(0))


#: Phrases that try to change an agent's instructions.
INJECTION = (r"ignore (all )?(previous|prior) instructions", r"disregard (the )?(system|previous)", "you are now", "system prompt")


def injection(text: Column) -> Column:
    """Whether a text tries to change an agent's instructions."""
    return text.rlike(f"(?i)({'|'.join(INJECTION)})")


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: how two versions compare, number by number; a leading v and what follows the numbers don't count,
    and a missing number is 0."""
    numbers = lambda c: F.transform(F.split(F.regexp_extract(c, r"^v?(\d+(?:\.\d+)*)", 1), r"\."), lambda x: F.coalesce(x.try_cast("long"), F.lit(0)))
    pairs = F.zip_with(numbers(a), numbers(b), lambda x, y: F.signum(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("int"))
    return F.coalesce(F.get(F.filter(pairs, lambda d: d != 0), F.lit(0)), F.lit(0))
