"""Queries over structured tool output, shell lines and event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import shell as S
from ..operators import history as Y
from ..operators import parsers as P
from ..operators import usage as U
from ..sources import files as FS
from ..sources import tables as T
from .catalog import query

_DIAG = "SELECT 'f' || user_id % 13 || '.py' AS file, 'E' || json_extract_string(props, '$.k')::INT % 20 AS rule, (event_id % 300)::INT AS line FROM events"


def _events(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return T.table(spark, d, "events").select("event_id", "user_id", "event_type", F.concat(F.lit("f"), F.col("user_id") % 13, F.lit(".py")).alias("file"), F.concat(F.lit("E"), k % 20).alias("rule"), (F.col("event_id") % 300).cast("int").alias("line"))


def _ruff(spark, d):
    item = F.struct(F.col("rule").alias("code"), F.col("file").alias("filename"), F.lit("m").alias("message"), F.struct(F.col("line").alias("row"), F.lit(1).alias("column")).alias("location"))
    return _events(spark, d).groupBy(F.expr("event_id div 100").alias("id")).agg(F.to_json(F.collect_list(item)).alias("report"))


@query("E28_ruff_rules", f"SELECT rule, COUNT(*) AS n FROM ({_DIAG}) GROUP BY 1 ORDER BY n DESC, rule LIMIT 10")
def e28_ruff(spark, d):
    return P.top_rules(P.lint(_ruff(spark, d), "ruff"))


@query("E28_ruff_files", f"SELECT file, rule, n, total::BIGINT AS total, rank::INT AS rank FROM (SELECT *, SUM(n) OVER (PARTITION BY file) AS total, row_number() OVER (PARTITION BY file ORDER BY n DESC, rule) AS rank FROM (SELECT file, rule, COUNT(*) AS n FROM ({_DIAG}) GROUP BY 1, 2)) WHERE rank <= 3 AND file IN (SELECT file FROM ({_DIAG}) GROUP BY 1 ORDER BY COUNT(*) DESC, file LIMIT 10)")
def e28_files(spark, d):
    return P.top_rules_by_file(P.lint(_ruff(spark, d), "ruff"))


@query("E28_eslint", f"SELECT rule, COUNT(*) AS n FROM ({_DIAG}) GROUP BY 1 ORDER BY n DESC, rule LIMIT 10")
def e28_eslint(spark, d):
    message = F.struct(F.col("rule").alias("ruleId"), F.lit(2).alias("severity"), F.lit("m").alias("message"), "line")
    files = _events(spark, d).groupBy("file", F.expr("event_id div 100").alias("part")).agg(F.collect_list(message).alias("messages"))
    report = F.to_json(F.array(F.struct(F.col("file").alias("filePath"), "messages")))
    return P.top_rules(P.lint(files.select(F.col("file").alias("id"), report.alias("report")), "eslint"))


@query("E28_tsc", f"SELECT file, line, 'TS' || substr(rule, 2) AS rule, COUNT(*) AS n FROM ({_DIAG}) GROUP BY 1, 2, 3")
def e28_tsc(spark, d):
    line = F.concat("file", F.lit("("), "line", F.lit(",7): error TS"), F.substring("rule", 2, 9), F.lit(": wrong"))
    return P.lint_lines(_events(spark, d).select(F.col("event_id").alias("line_no"), line.alias("line")), "tsc").groupBy("file", "line", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("E28_mypy", f"SELECT file, line, rule, COUNT(*) AS n FROM ({_DIAG}) GROUP BY 1, 2, 3")
def e28_mypy(spark, d):
    line = F.concat("file", F.lit(":"), "line", F.lit(": error: wrong type  ["), "rule", F.lit("]"))
    return P.lint_lines(_events(spark, d).select(F.col("event_id").alias("line_no"), line.alias("line")), "mypy").groupBy("file", "line", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("E28_rubocop", f"SELECT file, severity, line, rule, worst::INT AS worst, rank::INT AS rank FROM (SELECT *, MIN(p) OVER (PARTITION BY file) AS worst, row_number() OVER (PARTITION BY file ORDER BY p, line, rule) AS rank FROM (SELECT DISTINCT file, line, rule, CASE line % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'convention' END AS severity, line % 3 + 1 AS p FROM ({_DIAG}))) WHERE rank <= 5 AND file IN (SELECT DISTINCT file FROM ({_DIAG}) ORDER BY file LIMIT 10)")
def e28_rubocop(spark, d):
    severity = F.when(F.col("line") % 3 == 0, "error").when(F.col("line") % 3 == 1, "warning").otherwise("convention")
    rows = _events(spark, d).select("file", "line", "rule", severity.alias("severity")).distinct()
    return P.offenses(rows, ["error", "warning", "convention"]).withColumn("worst", F.col("worst").cast("int"))


def _go(spark, d):
    action = F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "skip").when(F.col("event_type") == "click", "output").otherwise("pass")
    item = F.struct(action.alias("Action"), F.concat(F.lit("p"), F.col("user_id") % 9).alias("Package"), F.concat(F.lit("T"), "user_id").alias("Test"), F.concat(F.lit("o"), "event_id", F.lit("\n")).alias("Output"))
    return _events(spark, d).select(F.col("event_id").alias("line_no"), F.to_json(item).alias("line"))


@query("E29_go_tests", "SELECT 'p' || user_id % 9 AS package, COUNT(*) FILTER (event_type IN ('signup', 'purchase')) AS pass, COUNT(*) FILTER (event_type = 'error') AS fail, COUNT(*) FILTER (event_type = 'view') AS skip FROM events GROUP BY 1")
def e29(spark, d):
    return P.go_tests(_go(spark, d))


@query("E29_go_failures", "SELECT 'p' || user_id % 9 AS package, 'T' || user_id AS test, md5(COALESCE(string_agg('o' || event_id || chr(10), '' ORDER BY event_id) FILTER (event_type = 'click'), '')) AS output FROM events GROUP BY user_id HAVING COUNT(*) FILTER (event_type = 'error') > 0")
def e29_failures(spark, d):
    return P.go_failures(_go(spark, d)).withColumn("output", F.md5("output"))


@query("E30_cargo_tests", "SELECT COUNT(*) AS suites, COUNT(*) FILTER (event_type = 'error') AS failed_suites, SUM(event_id % 7)::BIGINT AS passed, SUM(user_id % 3)::BIGINT AS failed, SUM(event_id % 2)::BIGINT AS ignored FROM events")
def e30(spark, d):
    line = F.concat(F.lit("test result: "), F.when(F.col("event_type") == "error", "FAILED").otherwise("ok"), F.lit(". "), F.col("event_id") % 7, F.lit(" passed; "), F.col("user_id") % 3, F.lit(" failed; "), F.col("event_id") % 2, F.lit(" ignored; 0 measured"))
    return P.merged_test_results(_events(spark, d).select(line.alias("line")))


@query("A13_trx", "SELECT event_id AS id, 'T' || event_id AS test, CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Passed' END AS outcome FROM events UNION ALL SELECT event_id, 'U' || event_id, 'Passed' FROM events")
def a13(spark, d):
    one = lambda letter, outcome: F.concat(F.lit(f'<UnitTestResult testName="{letter}'), "event_id", F.lit('" outcome="'), outcome, F.lit('"/>'))
    xml = F.concat(F.lit("<TestRun><Results>"), one("T", F.when(F.col("event_type") == "error", "Failed").otherwise("Passed")), one("U", F.lit("Passed")), F.lit("</Results></TestRun>"))
    return P.trx(_events(spark, d).select(F.col("event_id").alias("id"), xml.alias("report")))


@query("A11_spend_reports", T.spend_sql("month").replace("SELECT ", "SELECT ", 1))
def a11(spark, d):
    rows = T.spend(spark, d, "month")
    item = F.struct(F.col("key").alias("month"), F.col("input").alias("inputTokens"), F.col("output").alias("outputTokens"), F.col("cache_create").alias("cacheCreationTokens"), F.col("cache_read").alias("cacheReadTokens"), F.col("cost").alias("totalCost"))
    return FS.spend_reports(rows.groupBy(F.substring("key", 1, 4)).agg(F.to_json(F.struct(F.collect_list(item).alias("monthly"))).alias("report")), "month")


@query("A5_session_scan", """SELECT conv_id AS session, conv_id || '-' || turn // 2 AS id, 'git log ' || turn AS command, (turn + 1)::DOUBLE AS output FROM conversations c WHERE role = 'user' AND (SELECT COUNT(*) FROM conversations r WHERE r.conv_id = c.conv_id AND r.turn // 2 = c.turn // 2 AND r.role = 'assistant') > 0""")
def a5(spark, d):
    t = T.table(spark, d, "conversations")
    key = F.concat_ws("-", "conv_id", F.expr("turn div 2"))
    use = F.struct(F.lit("tool_use").alias("type"), F.lit("Bash").alias("name"), key.alias("id"), F.struct(F.concat(F.lit("git log "), "turn").alias("command")).alias("input"))
    result = F.struct(F.lit("tool_result").alias("type"), key.alias("tool_use_id"), F.expr("cast(turn div 2 * 2 + 1 as string)").alias("content"))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(use).alias("content")).alias("message")))
    answer = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(result).alias("content")).alias("message")))
    lines = t.where("role <> 'system'").select(F.col("conv_id").alias("session"), F.col("turn").alias("line_no"), F.when(F.col("role") == "user", line).otherwise(answer).alias("line"))
    noise = t.select(F.col("conv_id").alias("session"), F.col("turn").alias("line_no"), F.lit('{"tool_result" broken').alias("line"))
    uses, results = P.tool_events(lines.unionByName(noise))
    return Y.with_results(uses, results).where("output is not null").select("session", "id", "command", (F.regexp_extract("command", r"(\d+)$", 1).cast("double") + 1).alias("output"))


@query("E32_extensions", "SELECT CASE event_type WHEN 'view' THEN 'py' WHEN 'click' THEN 'rs' WHEN 'error' THEN 'none' ELSE 'md' END AS extension, COUNT(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def e32(spark, d):
    path = F.when(F.col("event_type") == "view", "a/b.PY").when(F.col("event_type") == "click", "c.rs").when(F.col("event_type") == "error", "Makefile").otherwise("x/README.md")
    return P.extensions(_events(spark, d).select(path.alias("path")))


@query("E31_find_groups", "SELECT directory, array_to_string(list_sort(list(path)), ',') AS files, COUNT(*) AS n FROM (SELECT 'd' || p_size AS directory, 'd' || p_size || '/' || p_partkey AS path FROM part ORDER BY 1, 2 LIMIT 200) GROUP BY 1")
def e31(spark, d):
    return P.grouped_paths(T.table(spark, d, "part").select(F.concat(F.lit("d"), "p_size", F.lit("/"), "p_partkey").alias("path")), 200)


@query("H34_psql", "SELECT p_partkey, 'id' || chr(9) || 'name' || chr(10) || p_partkey || chr(9) || p_name AS rows FROM part")
def h34(spark, d):
    text = F.concat(F.lit(" id | name \n----+------\n  "), "p_partkey", F.lit(" | "), "p_name", F.lit(" \n(1 row)\n"))
    return T.table(spark, d, "part").select("p_partkey", F.array_join(P.psql_rows(text), "\n").alias("rows"))


@query("H42_wc", r"SELECT doc_id, (length(text) - length(replace(text, chr(10), ''))) || 'L ' || len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) || 'W ' || octet_length(encode(text)) || 'B' AS counts FROM documents")
def h42(spark, d):
    return T.table(spark, d, "documents").select("doc_id", P.word_counts(F.col("text")).alias("counts"))


@query("H39_module_candidates", "SELECT p_partkey, 'src/lib/' || replace(p_name, ' ', '_') || '.ts,src/lib/' || replace(p_name, ' ', '_') || '/index.ts' AS candidates FROM part")
def h39(spark, d):
    spec = F.concat(F.lit("../lib/./"), F.regexp_replace("p_name", " ", "_"))
    return T.table(spark, d, "part").select("p_partkey", F.array_join(P.module_candidates(F.lit("src/app/main.ts"), spec, [".ts", "/index.ts"]), ",").alias("candidates"))


@query("H29_json_compact", "SELECT event_id, props AS view FROM events")
def h29(spark, d):
    return T.table(spark, d, "events").select("event_id", P.json_view("props", "compact").alias("view"))


@query("H30_json_schema", """SELECT event_id, '{"k": "int"}' AS view FROM events""")
def h30(spark, d):
    return T.table(spark, d, "events").select("event_id", P.json_view("props", "schema").alias("view"))


@query("H31_first_object", "SELECT event_id, props AS view FROM events")
def h31(spark, d):
    return T.table(spark, d, "events").select("event_id", P.json_view(F.concat(F.lit("warn {x} "), "props", F.lit(" } tail")), "object").alias("view"))


@query("H33_untyped", """SELECT event_id, '{"a": ' || event_id || ', "b": ["' || event_type || '", null]}' AS view FROM events""")
def h33(spark, d):
    text = F.concat(F.lit('{"a": {"N": "'), "event_id", F.lit('"}, "b": {"L": [{"S": "'), "event_type", F.lit('"}, {"NULL": true}]}}'))
    return T.table(spark, d, "events").select("event_id", P.json_view(text, "untyped").alias("view"))


@query("H32_json_path", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def h32(spark, d):
    return T.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _shell(spark, d):
    line = F.concat(F.lit("git log -n "), "user_id", F.lit(" && echo 'a b' > out"), F.col("event_id") % 3, F.lit(" | wc"))
    return T.table(spark, d, "events").select("event_id", line.alias("line"))


@query("H15_lexer", "SELECT event_id, 'Arg:git,Arg:log,Arg:-n,Arg:' || user_id || ',Operator:&&,Arg:echo,Arg:''a b'',Redirect:>,Arg:out' || event_id % 3 || ',Pipe:|,Arg:wc' AS tokens FROM events")
def h15(spark, d):
    spelled = F.transform(S.lex("line"), lambda t: F.concat_ws(":", t["kind"], t["value"]))
    return _shell(spark, d).select("event_id", F.array_join(spelled, ",").alias("tokens"))


@query("H16_words", "SELECT event_id, 'git,log,-n,' || user_id || ',&&,echo,a b,>,out' || event_id % 3 || ',|,wc' AS words FROM events")
def h16(spark, d):
    return _shell(spark, d).select("event_id", F.array_join(S.split_words("line"), ",").alias("words"))


@query("H17_chain", "SELECT event_id, 'git log -n ' || user_id AS command FROM events UNION ALL SELECT event_id, 'echo ''a b'' > out' || event_id % 3 FROM events")
def h17(spark, d):
    return _shell(spark, d).select("event_id", F.explode(S.split_chain("line")).alias("command"))


@query("H19_rewrite", "SELECT event_id, 'lom git log -n ' || user_id || ' && echo ''a b'' > out' || event_id % 3 || ' | wc' AS line FROM events")
def h19(spark, d):
    return _shell(spark, d).select("event_id", S.rewrite("line", {"git": "lom git", "wc": "lom wc"}).alias("line"))


#: Commands and what becomes of each by itself; a line is one of them, an operator, and another.
_KNOWN = [("git log -n 1", "lom git log -n 1"), ("sudo cargo test --all 2>&1", "sudo lom cargo test --all 2>&1"), ("head -5 a.txt", "lom read a.txt --max-lines 5"), ("nothing known", "nothing known"), ("cat -v x", "cat -v x"), ("A=1 rg -n x src > out", "A=1 lom grep -n x src > out"), ("LOM_DISABLED=1 git diff", "LOM_DISABLED=1 git diff")]
_JOINS = [" && ", " || ", "; ", " | "]
_ROWS = lambda rows: ", ".join("(" + ", ".join([str(i), *[f"'{x}'" for x in r]]) + ")" for i, r in enumerate(rows))


@query("H19_rules", f"""SELECT event_id, line, CASE WHEN new = line THEN NULL ELSE new END AS new FROM (SELECT event_id, a.c || j.c || b.c AS line, a.r || j.c || CASE WHEN j.c = ' | ' THEN b.c ELSE b.r END AS new FROM events
 JOIN (VALUES {_ROWS(_KNOWN)}) a(i, c, r) ON a.i = event_id % {len(_KNOWN)} JOIN (VALUES {_ROWS([(j,) for j in _JOINS])}) j(i, c) ON j.i = user_id % {len(_JOINS)} JOIN (VALUES {_ROWS(_KNOWN)}) b(i, c, r) ON b.i = (event_id // 7 + user_id) % {len(_KNOWN)})""")
def h19_rules(spark, d):
    pick = lambda i, values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.expr(i) + 1).cast("int"))
    names = [c for c, _ in _KNOWN]
    line = F.concat(pick(f"event_id % {len(_KNOWN)}", names), pick(f"user_id % {len(_JOINS)}", _JOINS), pick(f"(event_id div 7 + user_id) % {len(_KNOWN)}", names))
    return T.table(spark, d, "events").select("event_id", line.alias("line")).withColumn("new", Y.rewritten(F.col("line")))


@query("H20_base_command", "SELECT event_id, 'git log' AS base FROM events")
def h20(spark, d):
    return _shell(spark, d).select("event_id", Y.base_command(F.concat(F.lit("DEBUG=* "), "line")).alias("base"))


@query("I8_windows", T.with_views("SELECT date_trunc('day', timestamp) AS start, COUNT(*) AS commands, SUM(saved_tokens)::BIGINT AS saved FROM commands GROUP BY 1", "commands"))
def i8(spark, d):
    rows = T.commands(spark, d).groupBy(F.window("timestamp", "1 day")).agg(F.count(F.lit(1)).alias("commands"), F.sum("saved_tokens").alias("saved"))
    return rows.select(F.col("window.start").alias("start"), "commands", "saved")


@query("B4_export_json", T.with_views("SELECT lom_cmd, COUNT(*) AS n FROM commands GROUP BY 1", "commands"))
def b4(spark, d):
    rows = U.by_command(T.commands(spark, d)).select(F.to_json(F.struct("lom_cmd", "n")).alias("j"))
    return rows.select(F.from_json("j", "lom_cmd string, n long").alias("r")).select("r.*")


_REPORT = """SELECT event_id // 50 AS id, event_id AS line_no, 'm' || user_id % 3 || '.py' AS file, event_type, user_id FROM events"""


@query("E28_mypy_notes", f"""SELECT id, file, line::INT AS line, rule, notes FROM (SELECT e.id, e.line_no, e.file, e.user_id AS line, 'r' || e.user_id % 5 AS rule, COALESCE(string_agg('see ' || n.line_no, ',' ORDER BY n.line_no), '') AS notes FROM ({_REPORT}) e
 LEFT JOIN ({_REPORT}) n ON n.id = e.id AND n.event_type = 'view' AND n.file = e.file AND n.line_no > e.line_no AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.event_id // 50 = e.id AND x.event_id > e.line_no AND x.event_id < n.line_no) WHERE e.event_type = 'error' GROUP BY 1, 2, 3, 4, 5)""")
def e28_mypy_notes(spark, d):
    events = T.table(spark, d, "events")
    place = F.concat(F.lit("m"), F.col("user_id") % 3, F.lit(".py:"), "user_id")
    line = F.when(F.col("event_type") == "error", F.concat(place, F.lit(": error: bad  [r"), F.col("user_id") % 5, F.lit("]"))).when(F.col("event_type") == "view", F.concat(place, F.lit(": note: see "), "event_id")).otherwise("other")
    found = P.noted(events.select(F.expr("event_id div 50").alias("id"), F.col("event_id").alias("line_no"), line.alias("line")))
    return found.select("id", "file", "line", "rule", F.array_join("notes", ",").alias("notes"))


@query("E28_tsc_codes", f"SELECT rule, COUNT(*) AS n FROM (SELECT 'TS' || 2000 + user_id % 9 AS rule FROM events WHERE event_type = 'error') GROUP BY 1 ORDER BY n DESC, rule LIMIT 5")
def e28_tsc_codes(spark, d):
    return P.top_rules(_tsc(spark, d), 5)


@query("E28_tsc_files", "SELECT 'a' || user_id % 11 || '.ts' AS file, COUNT(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def e28_tsc_files(spark, d):
    return P.by_errors(_tsc(spark, d))


def _tsc(spark, d):
    line = F.concat(F.lit("a"), F.col("user_id") % 11, F.lit(".ts("), "event_id", F.lit(",1): error TS"), (F.col("user_id") % 9 + 2000).cast("string"), F.lit(": no"))
    return P.lint_lines(T.table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("line_no"), line.alias("line")), "tsc")


@query("E31_grep_totals", """SELECT file_path, matches, greatest(0, least(able, 200 - (s - able)))::INT AS shown FROM (SELECT *, SUM(able) OVER (ORDER BY file_path) AS s FROM (SELECT file_path, COUNT(*) AS matches, least(COUNT(*), 3) AS able FROM (
 SELECT doc_id::VARCHAR AS file_path, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, 'the') GROUP BY 1))""")
def e31_grep_totals(spark, d):
    lines = T.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return P.grep_totals(lines, "the", 3, 200)


@query("E31_extensions", "SELECT extension, COUNT(*) AS n FROM (SELECT CASE p_size % 7 WHEN 0 THEN 'rs' WHEN 1 THEN 'py' WHEN 2 THEN 'no ext' WHEN 3 THEN 'gz' WHEN 4 THEN 'no ext' WHEN 5 THEN 'x' ELSE 'md' END AS extension FROM part) GROUP BY 1 ORDER BY n DESC, extension LIMIT 5")
def e31_extensions(spark, d):
    names = F.array(*[F.lit(x) for x in ("a.rs", "b.py", "Makefile", "c.tar.gz", ".env", "d/e.x", "f.g/h.md")])
    return P.found_extensions(T.table(spark, d, "part").select(F.concat(F.lit("d/"), F.get(names, F.expr("p_size % 7"))).alias("path")))


_JSON = """'{"k": ' || event_id || ', "t": [' || user_id % 3 || ', {"b": "' || event_type || '", "e": {}}, [true, null]], "u": ' || CASE WHEN user_id % 2 = 0 THEN 'null' ELSE '1.5' END || '}'"""
_TREE = f"""SELECT event_id, fullkey AS path, len(regexp_extract_all(fullkey, '[.]|\\[')) AS depth, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' WHEN type = 'VARCHAR' THEN 'string' ELSE lower(type) END AS kind, CASE WHEN type IN ('OBJECT', 'ARRAY', 'NULL') THEN NULL ELSE atom ->> '$' END AS value,
 CASE type WHEN 'OBJECT' THEN len(json_keys(value)) WHEN 'ARRAY' THEN json_array_length(value) END::INT AS size FROM (SELECT event_id, t.* FROM (SELECT event_id, ({_JSON})::JSON AS j FROM events), json_tree(j) t)"""


def _json(spark, d):
    u = F.col("user_id")
    text = F.concat(F.lit('{"k": '), "event_id", F.lit(', "t": ['), u % 3, F.lit(', {"b": "'), "event_type", F.lit('", "e": {}}, [true, null]], "u": '), F.when(u % 2 == 0, "null").otherwise("1.5"), F.lit("}"))
    return P.json_nodes(T.table(spark, d, "events").select("event_id", text.alias("text")), "event_id", "text")


@query("H29_json_nodes", _TREE)
def h29_json_nodes(spark, d):
    return _json(spark, d)


@query("H30_json_paths", f"SELECT regexp_replace(path, '\\[[0-9]+\\]', '[]', 'g') AS path, kind, COUNT(*) AS n, MAX(COALESCE(size, length(value), 0))::INT AS most FROM ({_TREE}) GROUP BY 1, 2")
def h30_json_paths(spark, d):
    return P.json_schema(_json(spark, d))
