"""Structured tool output: lint reports, test runs, JSON views, tables and listings."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from .graph import cut

RUFF = "array<struct<code:string,filename:string,message:string,location:struct<row:int,column:int>>>"
ESLINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int>>>>"
PYLINT = "array<struct<type:string,symbol:string,`message-id`:string,path:string,line:int,message:string>>"
GOLANGCI = "struct<Issues:array<struct<FromLinter:string,Text:string,Pos:struct<Filename:string,Line:int>>>>"


def lint(reports: DataFrame, tool: str) -> DataFrame:
    """file, line, rule, message of the diagnostics in JSON reports (id, report); reports that don't parse drop."""
    if tool == "ruff":
        rows = reports.select("id", F.explode(F.from_json("report", RUFF)).alias("d"))
        return rows.select("id", F.col("d.filename").alias("file"), F.col("d.location.row").alias("line"), F.col("d.code").alias("rule"), "d.message")
    if tool == "eslint":
        rows = reports.select("id", F.explode(F.from_json("report", ESLINT)).alias("f")).select("id", F.col("f.filePath").alias("file"), F.explode("f.messages").alias("d"))
        return rows.select("id", "file", "d.line", F.coalesce("d.ruleId", F.lit("unknown")).alias("rule"), "d.message")
    if tool == "pylint":
        rows = reports.select("id", F.explode(F.from_json("report", PYLINT)).alias("d"))
        return rows.select("id", F.col("d.path").alias("file"), "d.line", F.concat("d.symbol", F.lit(" ("), F.col("d.`message-id`"), F.lit(")")).alias("rule"), "d.message")
    rows = reports.select("id", F.explode(F.from_json("report", GOLANGCI)["Issues"]).alias("d"))
    return rows.select("id", F.col("d.Pos.Filename").alias("file"), F.col("d.Pos.Line").alias("line"), F.col("d.FromLinter").alias("rule"), F.col("d.Text").alias("message"))


#: Our own patterns for text reports: file, line, rule and message as groups 1 to 4.
TSC = r"^(.+?)\((\d+),\d+\): error (TS\d+): (.*)$"
MYPY = r"^(.+?):(\d+)(?::\d+)?: error: (.*?)\s+\[([\w-]+)\]$"


def noted(lines: DataFrame) -> DataFrame:
    """file, line, rule, message, notes of a type checker's report (id, line_no, line): notes belong to the error before them,
    if that is of the same file; others are left out."""
    order = Window.partitionBy("id").orderBy("line_no")
    note = r"^(.+?):(\d+)(?::\d+)?: note: (.*)$"
    rows = lines.withColumn("error", F.when(F.col("line").rlike(MYPY), F.struct(F.regexp_extract("line", MYPY, 1).alias("file"), F.col("line_no").alias("at")))).withColumn("before", F.last("error", True).over(order))
    notes = rows.where(F.col("line").rlike(note) & (F.regexp_extract("line", note, 1) == F.col("before.file"))).groupBy("id", F.col("before.at").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("line_no", F.regexp_extract("line", note, 3).alias("text")))).alias("n"))
    errors = rows.where("error is not null").select("id", "line_no", *[F.regexp_extract("line", MYPY, i).alias(c) for i, c in ((1, "file"), (2, "at"), (4, "rule"), (3, "message"))])
    said = F.coalesce(F.transform("n", lambda x: x["text"]), F.array().cast("array<string>"))
    return errors.join(notes, ["id", "line_no"], "left").select("id", "file", F.col("at").cast("int").alias("line"), "rule", "message", said.alias("notes"))


def by_errors(diagnostics: DataFrame) -> DataFrame:
    """file, n of all files with errors (file, rule), those with the most first."""
    return diagnostics.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file")


def grep_totals(lines: DataFrame, pattern: str, per_file: int = 25, most: int = 200) -> DataFrame:
    """file_path, matches, shown of each file with matching lines (file_path, line_no, line): of all its matches those are
    shown that are among its first and, in order of files, among the first of all."""
    counts = lines.where(F.col("line").rlike(pattern)).groupBy("file_path").agg(F.count(F.lit(1)).alias("matches"))
    able = F.least("matches", F.lit(per_file))
    # a file that can show something takes one of the places at least, so no more than `most` files show any
    first = counts.orderBy("file_path").limit(most).withColumn("_sum", F.sum(able).over(Window.partitionBy(F.lit(0)).orderBy("file_path")))
    shown = first.select("file_path", F.greatest(F.lit(0), F.least(able, F.lit(most) - F.col("_sum") + able)).cast("int").alias("shown"))
    return counts.join(F.broadcast(shown), "file_path", "left").select("file_path", "matches", F.coalesce("shown", F.lit(0)).alias("shown"))


def found_extensions(paths: DataFrame, most: int = 5) -> DataFrame:
    """extension, n: the most frequent endings of found paths; files without one, or with a leading dot alone, count as such."""
    ending = F.regexp_extract("path", r"[^/.]\.([^./]+)$", 1)
    return paths.groupBy(F.when(ending == "", "no ext").otherwise(ending).alias("extension")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "extension").limit(most)


def lint_lines(lines: DataFrame, tool: str) -> DataFrame:
    """The same of text reports by line (line_no, line)."""
    pattern, rule, message = (TSC, 3, 4) if tool == "tsc" else (MYPY, 4, 3)
    get = lambda i: F.regexp_extract("line", pattern, i)
    rows = lines.where(F.col("line").rlike(pattern))
    return rows.select("line_no", get(1).alias("file"), get(2).cast("int").alias("line"), get(rule).alias("rule"), get(message).alias("message"))


def top_rules(diagnostics: DataFrame, n: int = 10) -> DataFrame:
    return diagnostics.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule").limit(n)


def top_rules_by_file(diagnostics: DataFrame, files: int = 10, rules: int = 3) -> DataFrame:
    """The files with most diagnostics, and the most frequent rules of each."""
    counts = diagnostics.groupBy("file", "rule").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("file").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "file").limit(files)
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), "rule"))
    return counts.join(F.broadcast(total), "file").withColumn("rank", rank).where(F.col("rank") <= rules)


def offenses(diagnostics: DataFrame, severities: list[str], files: int = 10, each: int = 5) -> DataFrame:
    """Files by worst severity and then by path, and the first diagnostics of each by severity and line."""
    place = F.array_position(F.array(*[F.lit(s) for s in severities]), F.col("severity"))
    rows = diagnostics.withColumn("p", place)
    worst = rows.groupBy("file").agg(F.min("p").alias("worst")).orderBy("worst", "file").limit(files)
    rank = F.row_number().over(Window.partitionBy("file").orderBy("p", "line", "rule"))
    return rows.join(F.broadcast(worst), "file").withColumn("rank", rank).where(F.col("rank") <= each).drop("p")


def go_tests(events: DataFrame) -> DataFrame:
    """Passed, failed and skipped tests of each package, from NDJSON lines (line_no, line); other lines drop."""
    e = F.from_json("line", "Action string, Package string, Test string, Output string")
    rows = events.select("line_no", e.alias("e")).where("e.Package is not null").select("line_no", "e.*")
    count = lambda a: F.count_if((F.col("Action") == a) & F.col("Test").isNotNull()).alias(a)
    return rows.groupBy(F.col("Package").alias("package")).agg(count("pass"), count("fail"), count("skip"))


def go_failures(events: DataFrame) -> DataFrame:
    """The collected output of each failed test, in order."""
    e = F.from_json("line", "Action string, Package string, Test string, Output string")
    rows = events.select("line_no", e.alias("e")).where("e.Test is not null").select("line_no", "e.*")
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("Action") == "output", F.struct("line_no", "Output")))), lambda l: l["Output"])
    return rows.groupBy(F.col("Package").alias("package"), F.col("Test").alias("test")).agg(F.max((F.col("Action") == "fail").cast("int")).alias("failed"), F.array_join(lines, "").alias("output")).where("failed = 1").drop("failed")


RESULT = r"test result: (\w+)\. (\d+) passed; (\d+) failed; (\d+) ignored"


def merged_test_results(lines: DataFrame) -> DataFrame:
    """Suites and their tests added up, from 'test result' lines."""
    get = lambda i: F.regexp_extract("line", RESULT, i)
    rows = lines.where(F.col("line").rlike(RESULT)).select(get(1).alias("status"), *[get(i).cast("int").alias(n) for i, n in ((2, "passed"), (3, "failed"), (4, "ignored"))])
    return rows.agg(F.count(F.lit(1)).alias("suites"), F.count_if(F.col("status") != "ok").alias("failed_suites"), F.sum("passed").alias("passed"), F.sum("failed").alias("failed"), F.sum("ignored").alias("ignored"))


def trx(reports: DataFrame) -> DataFrame:
    """test, outcome of XML test reports (id, report)."""
    names = F.expr("xpath(report, \"//*[local-name()='UnitTestResult']/@testName\")")
    outcomes = F.expr("xpath(report, \"//*[local-name()='UnitTestResult']/@outcome\")")
    return reports.select("id", F.explode(F.arrays_zip(names.alias("test"), outcomes.alias("outcome"))).alias("r")).select("id", "r.test", "r.outcome")


def extensions(paths: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent file extensions of (path)."""
    e = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return paths.groupBy(F.when(e == "", "none").otherwise(F.lower(e)).alias("extension")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "extension").limit(n)


def grouped_paths(paths: DataFrame, most: int) -> DataFrame:
    """The files of each directory, in order, up to a number of files in all."""
    rows = paths.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"), "path").orderBy("directory", "path").limit(most)
    return rows.groupBy("directory").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("files"), F.count(F.lit(1)).alias("n"))


def compact(value, depth: int = 4):
    """A JSON value with long arrays, long strings, many keys and deep levels summed up; keys in order."""
    if isinstance(value, dict):
        if depth <= 0:
            return f"{{{len(value)} keys}}"
        keys = sorted(value)
        out = {k: compact(value[k], depth - 1) for k in keys[:20]}
        return out | ({"...": f"+{len(keys) - 20} keys"} if len(keys) > 20 else {})
    if isinstance(value, list):
        if depth <= 0 or len(value) > 5:
            return [*(compact(v, depth - 1) for v in value[:1] if depth > 0), f"... {len(value)} items"]
        return [compact(v, depth - 1) for v in value]
    return value[:77] + "..." if isinstance(value, str) and len(value) > 80 else value


def schema_of(value, depth: int = 5):
    """The types of a JSON value."""
    if isinstance(value, dict):
        return {k: schema_of(value[k], depth - 1) for k in sorted(value)[:15]} if depth > 0 else "object"
    if isinstance(value, list):
        return [schema_of(value[0], depth - 1)] if value and depth > 0 else "array"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, str):
        return "url" if value.startswith(("http://", "https://")) else "date?" if len(value) >= 10 and value[4:5] == "-" and value[:4].isdigit() else f"string[{len(value)}]" if len(value) > 50 else "string"
    return {int: "int", float: "float"}.get(type(value), "null")


def first_object(text: str | None) -> str | None:
    """The first balanced JSON object in a text."""
    text = text or ""
    at = text.find("{")
    while at >= 0:
        try:
            _, end = json.JSONDecoder().raw_decode(text, at)
            return text[at:end]
        except ValueError:
            at = text.find("{", at + 1)
    return None


def untyped(value, depth: int = 10):
    """A key-value store's typed JSON ({"S": ...}, {"N": ...}, ...) as plain JSON."""
    if isinstance(value, dict) and depth > 0:
        if len(value) == 1:
            (kind, inner), = value.items()
            if kind in ("S", "B", "BOOL", "SS", "BS"):
                return inner
            if kind == "NULL":
                return None
            if kind in ("N", "NS"):
                return [_number(v) for v in inner] if kind == "NS" else _number(inner)
            if kind == "L":
                return [untyped(v, depth - 1) for v in inner]
            if kind == "M":
                return {k: untyped(v, depth - 1) for k, v in inner.items()}
        return {k: untyped(v, depth - 1) for k, v in value.items()}
    return [untyped(v, depth - 1) for v in value] if isinstance(value, list) and depth > 0 else value


def _number(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except (ValueError, TypeError):
            continue
    return text


def json_view(text: Column | str, view: str) -> Column:
    """JSON text under a view: compact, schema, object or untyped. These recurse, so they run in Python by Arrow batch;
    text that isn't JSON gives null."""
    f = {"compact": compact, "schema": schema_of, "untyped": untyped}.get(view)

    def one(value: str | None) -> str | None:
        if f is None:
            return first_object(value)
        try:
            return json.dumps(f(json.loads(value)), sort_keys=True, ensure_ascii=False) if value is not None else None
        except ValueError:
            return None

    def applied(values: pd.Series) -> pd.Series:
        return values.map(one)

    return F.pandas_udf(applied, "string")(text)


def json_nodes(rows: DataFrame, key: str, text: str, depth: int = 8) -> DataFrame:
    """key, path, depth, kind, value, size: every value of JSON texts down to a depth, level by level in the JVM. Paths are
    $.name[0]; kind is object, array, string, number, boolean or null; value is that of scalars as text, size the number of
    what objects and arrays hold. Texts that don't parse have no nodes. The walk ends where a level has nothing below it;
    each level is a checkpoint, so that a deep text costs a pass a level and no longer plan."""
    spark = rows.sparkSession
    told = F.schema_of_variant("v")
    kind = F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "array").when(told == "STRING", "string").when(told == "BOOLEAN", "boolean").when(told == "VOID", "null").otherwise("number")
    level = rows.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.lit(0).alias("depth"), F.try_parse_json(text).alias("v")).where("v is not null").withColumn("kind", kind)
    every = None
    for step in range(depth + 1):
        level = level.transform(cut)
        inner = spark.sql(
            "SELECT t.key, concat(t.path, CASE WHEN t.kind = 'array' THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END) AS path, t.depth + 1 AS depth, e.value AS v FROM {t} t, LATERAL variant_explode(t.v) e WHERE t.kind IN ('object', 'array')", t=level
        ).withColumn("kind", kind)
        sizes = F.when(F.col("kind") == "object", F.size(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")))).when(F.col("kind") == "array", F.size(F.try_variant_get("v", "$", "array<variant>")))
        value = F.when(~F.col("kind").isin("object", "array", "null"), F.try_variant_get("v", "$", "string"))
        nodes = level.select(F.col("key").alias(key), "path", "depth", "kind", value.alias("value"), sizes.alias("size"))
        every = nodes if every is None else every.unionByName(nodes)
        if step == depth or level.where("kind in ('object', 'array')").isEmpty():
            break
        level = inner
    return every


def json_schema(nodes: DataFrame) -> DataFrame:
    """path, kind, n, most of many texts' nodes: what stands where, how often, and how long it is at most. Places in arrays
    count as one."""
    path = F.regexp_replace("path", r"\[\d+\]", "[]")
    return nodes.groupBy(path.alias("path"), "kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("size", F.length("value"), F.lit(0))).alias("most"))


def psql_rows(text: Column, most: int = 30) -> Column:
    """A console table as tab-separated rows, rulers and row counts left out."""
    rows = F.filter(L.to_lines(text), lambda l: ~l.rlike(r"^[-+\s]*$") & ~l.rlike(r"^\(\d+ rows?\)"))
    return L.at_most(F.transform(rows, lambda l: F.array_join(F.transform(F.split(l, r"\|"), lambda c: F.trim(c)), "\t")), most)


def word_counts(text: Column) -> Column:
    """'nL nW nB' of a text, as wc counts."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    words = F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+"))
    return F.concat(lines.cast("string"), F.lit("L "), words.cast("string"), F.lit("W "), F.octet_length(text).cast("string"), F.lit("B"))


def module_candidates(importer: Column, specifier: Column, endings: list[str]) -> Column:
    """Paths that a relative import can mean, in order of preference; none where it leaves the root."""
    base = F.filter(F.split(F.regexp_extract(importer, r"^(.*)/[^/]*$", 1), "/"), lambda p: p != "")
    parts = F.split(specifier, "/")

    def step(path: Column, part: Column) -> Column:
        return F.when(path.isNull() | ((part == "..") & (F.size(path) == 0)), F.lit(None).cast("array<string>")).when(part == "..", F.slice(path, 1, F.size(path) - 1)).when((part == ".") | (part == ""), path).otherwise(F.concat(path, F.array(part)))

    joined = F.array_join(F.aggregate(parts, base, step), "/")
    return F.filter(F.array(*[F.concat(joined, F.lit(e)) for e in endings]), lambda c: c.isNotNull())


def tool_events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool uses and results of session lines (session, line_no, line) in JSON. Lines without either are dropped by a
    substring test before anything is parsed; lines that don't parse are dropped too."""
    schema = "type string, message struct<content:array<struct<type:string,name:string,id:string,input:struct<command:string>,tool_use_id:string,content:string,is_error:boolean>>>"
    hot = lines.where(F.col("line").contains('"Bash"') | F.col("line").contains('"tool_result"'))
    items = hot.select("session", "line_no", F.explode(F.from_json("line", schema)["message"]["content"]).alias("c")).select("session", "line_no", "c.*")
    uses = items.where("type = 'tool_use' and name = 'Bash'").select("session", "id", F.col("input.command").alias("command"))
    results = items.where("type = 'tool_result'").select("session", F.col("tool_use_id").alias("id"), F.col("line_no").alias("seq"), F.col("content").alias("output"), F.coalesce("is_error", F.lit(False)).alias("is_error"))
    return uses, results
