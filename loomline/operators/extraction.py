"""Symbols of source files with their spans, parents, documentation and bases, by lines and windows.

Lines are (file_path, line_no, line), numbered from 1. A definition is found by a pattern of its line; where its block
ends follows from a running depth of braces, from indentation, or from `end` lines, by language. Each line that closes
levels is a row a level, and a definition's end is the next such row of its own level: a window by file and level, and
no comparison of a definition with all the lines after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import _stretches, cut, shuffled

_PUB = r"^\s*(?:pub(?:\([^)]*\))?\s+)?"
_EXPORT = r"^\s*(?:export\s+)?(?:default\s+)?"
#: Our own patterns for definitions, by language: (kind, pattern with the name as group 1).
DEFINITIONS = {
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)\s*\("), ("class", r"^\s*class\s+(\w+)")],
    "rust": [
        ("function", _PUB + r"(?:const\s+)?(?:unsafe\s+)?(?:async\s+)?fn\s+(\w+)"), ("struct", _PUB + r"struct\s+(\w+)"), ("enum", _PUB + r"enum\s+(\w+)"), ("trait", _PUB + r"trait\s+(\w+)"),
        ("constant", _PUB + r"(?:const|static)\s+(?:mut\s+)?(\w+)\s*:"), ("type", _PUB + r"type\s+(\w+)"), ("module", _PUB + r"mod\s+(\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:]+(?:<[^>]*>)?\s+for\s+)?(\w+)"),
    ],
    "go": [("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("struct", r"^type\s+(\w+)\s+struct\b"), ("type", r"^type\s+(\w+)")],
    "javascript": [("function", _EXPORT + r"(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", _EXPORT + r"(?:abstract\s+)?class\s+(\w+)"), ("function", _EXPORT + r"(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>")],
    "ruby": [("function", r"^\s*def\s+(?:self\.)?(\w+[?!=]?)"), ("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)")],
    "java": [("class", r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|record)\s+(\w+)"), ("interface", r"^\s*(?:(?:public|private|protected|static)\s+)*interface\s+(\w+)"), ("enum", r"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+(\w+)")],
}
_METHOD = r"^\s+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?!(?:if|for|while|switch|catch|function|return|else|do|with)\b)(\w+)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::\s*[^{;=]+)?\{"
DEFINITIONS["javascript"].append(("method", _METHOD))
DEFINITIONS["typescript"] = [*DEFINITIONS["javascript"], ("interface", _EXPORT + r"interface\s+(\w+)"), ("type", _EXPORT + r"type\s+(\w+)"), ("enum", _EXPORT + r"(?:const\s+)?enum\s+(\w+)")]
INDENTED, ENDED = ("python",), ("ruby",)
#: What has no block of its own unless its line opens one.
PLAIN = ("constant", "type", "variable")
TYPES = ("class", "struct", "trait", "interface", "enum", "impl")
_TEXTS = "array<string>"


def _definition(language: Column, line: Column) -> Column:
    """struct(kind, name) of what a line defines, or null."""
    out: Column = F.lit(None).cast("struct<kind:string,name:string>")
    for name, patterns in DEFINITIONS.items():
        own: Column = F.lit(None).cast("struct<kind:string,name:string>")
        for kind, pattern in reversed(patterns):
            own = F.when(line.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, pattern, 1).alias("name"))).otherwise(own)
        out = F.when(language == name, own).otherwise(out)
    return out


def _bases(language: Column, line: Column) -> Column:
    """The names that a class line extends or implements."""
    python = F.regexp_extract(line, r"^\s*class\s+\w+\s*\(([^)]*)\)", 1)
    other = F.regexp_replace(F.regexp_extract(line, r"\b(?:extends|implements)\s+([^{]*)", 1), r"\b(?:extends|implements)\b", ",")
    ruby = F.regexp_extract(line, r"^\s*class\s+\w+\s*<\s*([\w:]+)", 1)
    rust = F.regexp_extract(line, r"^\s*impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s", 1)
    text = F.when(language == "python", python).when(language == "ruby", ruby).when(language == "rust", rust).otherwise(other)
    names = F.transform(F.split(text, ","), lambda n: F.regexp_extract(F.trim(n), r"^([\w.:]+)", 1))
    return F.filter(names, lambda n: ~n.isin("", "object") & ~n.rlike("^metaclass$"))


def _plain(line: Column) -> Column:
    """A line of a brace language without strings, characters and what follows a comment sign."""
    return F.regexp_replace(line, r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)'|`[^`]*`|//.*", "")


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def extract(lines: DataFrame) -> DataFrame:
    """id, name, kind, file_path, line_start, line_end, parent, signature, doc, bases of what files define.

    An id is file::name, with ~2, ~3 ... where a file defines a name again. parent is the id of the innermost definition
    around it; functions in a type are methods. doc is what /// lines before a definition say, or a docstring of one line
    after it. A definition whose block never ends reaches to the file's end. Files of other languages, empty ones and
    null lines define nothing.
    """
    language = X.language_of(F.col("file_path"))
    trimmed, code = F.regexp_replace("line", r"^\s+|\s+$", ""), _plain(F.col("line"))
    rows = lines.where(F.col("line").isNotNull()).select("file_path", "line_no", "line", language.alias("language"))
    # the windows' own shuffle, made before the patterns are tried
    rows = rows.where(F.col("language").isin(*DEFINITIONS)).repartition("file_path").withColumn("d", _definition(F.col("language"), F.col("line")))
    by_indent, by_end = F.col("language").isin(*INDENTED), F.col("language").isin(*ENDED)
    brace = ~by_indent & ~by_end
    rows = rows.withColumns({
        "t": trimmed, "blank": (trimmed == "") | by_indent & trimmed.rlike(r"^[#)\]}]"), "indent": F.length(F.regexp_extract(F.regexp_replace("line", "\t", "    "), "^( *)", 1)),
        "opens": F.when(brace, _count(code, "{")).otherwise(0), "net": F.when(brace, _count(code, "{") - _count(code, "}")).otherwise(0), "stops": brace & F.rtrim(code).endswith(";"),
    })
    file = Window.partitionBy("file_path").orderBy("line_no")
    ahead = file.rowsBetween(0, Window.unboundedFollowing)
    last = F.last(F.when(~F.col("blank"), F.struct("line_no", "indent")), True).over(file.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"after": F.sum("net").over(file), "before": last, "head": F.min(F.when((F.col("opens") > 0) | F.col("stops"), F.struct("line_no", "opens"))).over(ahead)})
    rows = rows.withColumn("final", F.max(F.when(~F.col("blank"), F.col("line_no"))).over(ahead)).withColumn("level", F.when(brace, F.col("after") - F.col("net")).otherwise(F.col("indent")))
    # levels that a line closes, and the last line of what is closed
    down, none = F.col("before.indent"), F.array().cast("array<bigint>")
    closes = F.when(brace & (F.col("net") < 0), F.sequence(F.col("after"), F.col("level") - 1)).when(by_indent & ~F.col("blank") & (F.col("indent") <= down), F.sequence(F.col("indent").cast("bigint"), down.cast("bigint")))
    closes = F.coalesce(closes.cast("array<bigint>"), F.when(by_end & F.col("t").rlike(r"^end\b"), F.array(F.col("indent").cast("bigint"))), none)
    closed = rows.select("file_path", "line_no", F.explode(closes).alias("level"), F.when(by_indent, F.col("before.line_no")).otherwise(F.col("line_no")).alias("close"))
    defined = rows.where("d is not null").select("file_path", "line_no", F.col("level").cast("bigint").alias("level"), F.lit(None).cast(rows.schema["line_no"].dataType).alias("close"), F.struct("d", "line", "t", "language", "head", "final", "opens", "net").alias("own"))
    both = defined.unionByName(closed.select("*", F.lit(None).cast(defined.schema["own"].dataType).alias("own")))
    following = Window.partitionBy("file_path", "level").orderBy("line_no", F.col("own").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    ends = both.withColumn("next", F.first("close", True).over(following)).where("own is not null")
    here, opened = F.col("line_no"), F.col("own.head.line_no")
    block = F.coalesce("next", "own.final", here)
    end = (
        F.when(F.col("own.language").isin(*INDENTED, *ENDED), F.greatest(block, here))
        .when(F.col("own.d.kind").isin(*PLAIN) & (F.col("own.opens") == 0) | opened.isNull(), here)
        .when(F.col("own.head.opens") == 0, opened)
        .when((opened == here) & (F.col("own.net") <= 0), here)
        .otherwise(block)
    )
    found = ends.select("file_path", here.alias("line_start"), end.alias("line_end"), F.col("own.d.kind").alias("kind"), F.col("own.d.name").alias("name"), F.regexp_replace(F.col("own.t"), r"\s*[{:;]\s*$", "").alias("signature"), _bases(F.col("own.language"), F.col("own.line")).alias("bases"))
    found = found.join(_documents(rows).transform(shuffled), ["file_path", "line_start"], "left")
    n = F.row_number().over(Window.partitionBy("file_path", "name").orderBy("line_start"))
    found = found.withColumn("n", n).withColumn("id", F.concat("file_path", F.lit("::"), "name", F.when(F.col("n") > 1, F.concat(F.lit("~"), "n")).otherwise(""))).drop("n").transform(cut)
    around = _stretches(found.select("file_path", F.col("line_start").alias("line_no"), F.col("id").alias("child")), found.select("file_path", "id", "line_start", "line_end")).where("_id is not null and _id <> child")
    parents = around.groupBy(F.col("child").alias("id")).agg(F.max_by("_id", F.struct("line_start", "_id")).alias("parent"))
    kinds = found.select(F.col("id").alias("parent"), F.col("kind").alias("parent_kind"))
    rows = found.join(shuffled(parents), "id", "left").join(shuffled(kinds), "parent", "left")
    kind = F.when((F.col("kind") == "function") & F.col("parent_kind").isin(*TYPES), "method").otherwise(F.col("kind"))
    return rows.select("id", "name", kind.alias("kind"), "file_path", "line_start", "line_end", "parent", "signature", F.coalesce("doc", F.lit("")).alias("doc"), "bases")


def _documents(rows: DataFrame) -> DataFrame:
    """file_path, line_start, doc of documented definitions. Lines of documentation, attributes and blank ones before a line
    of code count with it: they follow as many lines of code."""
    file = Window.partitionBy("file_path").orderBy("line_no")
    doc = (F.col("language") != "python") & F.col("t").rlike(r"^//[/!]")
    passed = doc | (F.col("t") == "") | F.col("t").startswith("#[")
    marked = rows.select("file_path", "line_no", "t", "language", F.col("d").isNotNull().alias("defines"), doc.alias("doc"), passed.alias("passed"), F.lead("t").over(file).alias("after"))
    group = F.coalesce(F.sum((~F.col("passed")).cast("int")).over(file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    said = F.struct("line_no", F.trim(F.regexp_replace("t", r"^//[/!]", "")).alias("text"))
    quoted = F.regexp_extract("after", r"^(?s)(\"\"\"|''')(.+)\1$", 2)
    one = F.when(F.col("language") == "python", F.trim(quoted))
    groups = marked.withColumn("group", group).where("defines or doc").groupBy("file_path", "group").agg(
        F.max(F.when(F.col("defines"), F.col("line_no"))).alias("line_start"), F.max(F.when(F.col("defines"), one)).alias("inner"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("doc"), said))), lambda s: s["text"]), " ").alias("outer"),
    )
    text = F.coalesce(F.nullif("inner", F.lit("")), F.trim("outer"))
    return groups.where("line_start is not null").select("file_path", "line_start", text.alias("doc"))
