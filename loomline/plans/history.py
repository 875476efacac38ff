"""Queries over session history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as Y
from ..sources import tables as T
from .catalog import query


def _calls(spark, d):
    t = T.table(spark, d, "conversations")
    key = F.concat_ws("-", "conv_id", F.expr("turn div 2"))
    uses = t.where("role = 'user'").select(F.col("conv_id").alias("session"), key.alias("id"), F.col("text").alias("command"))
    results = t.where("role = 'assistant'").select(F.col("conv_id").alias("session"), key.alias("id"), F.col("turn").alias("seq"), F.length("text").alias("output"), (F.col("turn") % 3 == 0).alias("is_error"))
    return uses, results


@query("D1_tool_results", """SELECT u.session, u.id, u.command, r.output::DOUBLE AS output, r.is_error FROM (SELECT conv_id AS session, conv_id || '-' || turn // 2 AS id, text AS command FROM conversations WHERE role = 'user') u
 LEFT JOIN (SELECT conv_id AS session, conv_id || '-' || turn // 2 AS id, arg_max(length(text), turn) AS output, arg_max(turn % 3 = 0, turn) AS is_error FROM conversations WHERE role = 'assistant' GROUP BY 1, 2) r ON u.session = r.session AND u.id = r.id""")
def d1(spark, d):
    return Y.with_results(*_calls(spark, d)).withColumn("output", F.col("output").cast("double"))


_CLASS = "'lom git'"
_PCT = "CASE WHEN command LIKE 'git diff%' THEN 80.0 ELSE 70.0 END"


@query("D11_classify", T.with_views(f"SELECT command, {_CLASS} AS target, {_PCT}::DOUBLE AS pct, COUNT(*) AS n FROM executions GROUP BY 1, 2, 3", "executions"))
def d11(spark, d):
    c = Y.classified(F.col("command"))
    return T.executions(spark, d).groupBy("command", c["target"].alias("target"), c["pct"].alias("pct")).agg(F.count(F.lit(1)).alias("n"))


#: Commands of many tools, with the target and share that the rules give them.
_TOOLS = [
    ("git -C /x diff --stat", "lom git", 80.0), ("sudo git push origin main", "lom git", 70.0), ("git bisect start", None, None), ("cat a.txt", "lom read", 60.0), ("cat a > b", None, None),
    ("bat a.rs", "lom read", 60.0), ("rg -n x src", "lom grep", 75.0), ("grep -r y .", "lom grep", 75.0), ("npx eslint src", "lom lint", 84.0), ("biome check", "lom biome", 84.0), ("fd x", "lom fd", 70.0),
    ("cargo test --all", "lom cargo", 90.0), ("cargo fmt", "lom cargo", 80.0), ("/usr/bin/python -m pytest", "lom pytest", 90.0), ("python -m pytest -q", "lom pytest", 90.0), ("pip3 list", "lom pip", 75.0), ("uv pip install x", "lom uv", 65.0),
    ("go vet ./...", "lom go", 75.0), ("docker compose logs web", "lom docker", 85.0), ("aws ec2 describe-instances", "lom aws", 80.0), ("swift test", "lom swift", 90.0), ("tofu plan", "lom tofu", 70.0), ("java -jar app.jar", "lom spring-boot", 70.0),
    ("stat x", "lom stat", 60.0), ("task build", "lom task", 70.0), ("mise run x", "lom mise", 65.0), ("xcodebuild -scheme x", "lom xcodebuild", 70.0), ("skopeo inspect x", "lom skopeo", 65.0), ("hadolint Dockerfile", "lom hadolint", 65.0),
    ("echo x", None, None), ("printf x", None, None), ("while true", None, None), ("python3 -c 1", None, None), ("unknown thing", None, None),
]
_TOOL_ROWS = ", ".join(f"({i}, '{c}', {'NULL' if t is None else repr(t)}, {'NULL' if p is None else p}::DOUBLE)" for i, (c, t, p) in enumerate(_TOOLS))


@query("D11_tools", f"SELECT event_id, target, pct FROM events JOIN (VALUES {_TOOL_ROWS}) v(i, command, target, pct) ON i = event_id % {len(_TOOLS)}")
def d11_tools(spark, d):
    command = F.element_at(F.array(*[F.lit(c) for c, _, _ in _TOOLS]), (F.col("event_id") % len(_TOOLS) + 1).cast("int"))
    rows = T.table(spark, d, "events").select("event_id", Y.classified(command).alias("c"))
    return rows.select("event_id", "c.target", "c.pct")


@query("E11_tools", f"SELECT target, COUNT(*) AS n, SUM(floor((event_id % 500 * 40 // 4) * pct / 100))::BIGINT AS saved FROM events JOIN (VALUES {_TOOL_ROWS}) v(i, command, target, pct) ON i = event_id % {len(_TOOLS)} WHERE target IS NOT NULL GROUP BY 1")
def e11_tools(spark, d):
    command = F.element_at(F.array(*[F.lit(c) for c, _, _ in _TOOLS]), (F.col("event_id") % len(_TOOLS) + 1).cast("int"))
    return Y.discover(T.table(spark, d, "events").select(command.alias("command"), (F.col("event_id") % 500 * 40).alias("output_bytes"))).select("target", "n", "saved")


_BORING = ["cd /tmp", "pwd", "git status", "echo", "echoes", "wait", "sh", "shellcheck x", "chown a b", "awk 1", "node -e 1", "then ls", "for i in x", "ruby x", "done", "lom git log"]
_BORING_SQL = "(" + ", ".join(str(_BORING.index(c)) for c in ("git status", "echoes", "shellcheck x", "ruby x")) + ")"


@query("C12_ignored", f"SELECT event_id, event_id % {len(_BORING)} NOT IN {_BORING_SQL} AS ignored FROM events")
def c12(spark, d):
    command = F.element_at(F.array(*map(F.lit, _BORING)), (F.col("event_id") % len(_BORING) + 1).cast("int"))
    return T.table(spark, d, "events").select("event_id", Y.ignored(command).alias("ignored"))


@query("E11_discover", T.with_views(f"SELECT target, SUM(n)::BIGINT AS n, SUM(saved)::BIGINT AS saved, arg_min(shown, {{'k': -n, 's': shown}}) AS most_common FROM (SELECT {_CLASS} AS target, split_part(command, ' ', 1) || ' ' || split_part(command, ' ', 2) AS shown, COUNT(*) AS n, SUM(floor((length(output) * 40 // 4) * {_PCT} / 100))::BIGINT AS saved FROM executions GROUP BY 1, 2) GROUP BY 1", "executions"))
def e11(spark, d):
    return Y.discover(T.executions(spark, d).select("command", (F.length("output") * 40).alias("output_bytes")))


@query("E12_estimated_savings", T.with_views(f"SELECT session, seq, floor((length(output) * 40 // 4) * {_PCT} / 100)::BIGINT AS saved FROM executions", "executions"))
def e12(spark, d):
    saved = F.floor(F.expr("(length(output) * 40) div 4") * Y.classified(F.col("command"))["pct"] / 100).cast("long")
    return T.executions(spark, d).select("session", "seq", saved.alias("saved"))


@query("E13_adoption", T.with_views("SELECT session, COUNT(*) AS commands, COUNT(*) FILTER (command LIKE '%--json%') AS covered, 100.0::DOUBLE * COUNT(*) FILTER (command LIKE '%--json%') / COUNT(*) AS pct FROM executions GROUP BY 1", "executions"))
def e13(spark, d):
    return Y.adoption(T.executions(spark, d), F.col("command").contains("--json"))


_FAILED = "(is_error AND NOT regexp_matches(output, '(?i)(user (declined|rejected|cancelled))') AND regexp_matches(lower(output), 'error|failed|unknown|invalid|not found|permission denied|cannot'))"
_KIND = "CASE WHEN contains(output, 'unexpected argument') THEN 'Unknown Flag' WHEN contains(output, 'command not found') THEN 'Command Not Found' WHEN contains(output, 'requires a value') THEN 'Missing Argument' WHEN output ILIKE '%permission denied%' THEN 'Permission Denied' WHEN contains(output, 'No such file') THEN 'Wrong Path' ELSE 'General Error' END"


@query("H21_error_kinds", T.with_views(f"SELECT {_KIND} AS kind, {_FAILED} AS failed, COUNT(*) AS n FROM executions GROUP BY 1, 2", "executions"))
def h21(spark, d):
    return T.executions(spark, d).groupBy(Y.error_kind(F.col("output")).alias("kind"), Y.failed(F.col("is_error"), F.col("output")).alias("failed")).agg(F.count(F.lit(1)).alias("n"))


_BASE = "(split_part({0}, ' ', 1) || ' ' || split_part({0}, ' ', 2))"
_SIM = f"(CASE WHEN {_BASE.format('x.command')} <> {_BASE.format('y.command')} THEN 0 ELSE 0.5 + 0.5 * len(list_intersect(string_split(x.command, ' ')[3:], string_split(y.command, ' ')[3:]))::DOUBLE / len(list_distinct(list_concat(string_split(x.command, ' ')[3:], string_split(y.command, ' ')[3:]))) END)"
_PAIRS = f"""SELECT session, seq, wrong, arg_min("right", k) AS "right", arg_min(confidence, k) AS confidence, any_value(kind) AS kind FROM (
 SELECT x.session, x.seq, x.command AS wrong, y.command AS "right", y.seq AS k, x.kind, CASE WHEN y.failed THEN sim ELSE least(sim + 0.2, 1.0) END AS confidence FROM (
 SELECT x, y, {_SIM} AS sim FROM (SELECT *, {_FAILED} AS failed, {_KIND} AS kind FROM executions) x JOIN (SELECT *, {_FAILED} AS failed FROM executions) y ON x.session = y.session AND y.seq BETWEEN x.seq + 1 AND x.seq + 3 WHERE x.failed AND x.command <> y.command)
 WHERE sim >= 0.5 AND NOT (sim > 0.9 AND sim < 1)) WHERE confidence >= 0.6 GROUP BY 1, 2, 3"""


@query("D17_corrections", T.with_views(_PAIRS, "executions"))
def d17(spark, d):
    return Y.corrections(T.executions(spark, d))


_DIFF = """CASE WHEN len(g) > 0 AND len(w) > 0 THEN list_min(g) || ' → ' || list_min(w) WHEN len(g) > 0 THEN 'removed ' || list_min(g) WHEN len(w) > 0 THEN 'added ' || list_min(w) ELSE 'unknown' END"""


@query("E14_correction_rules", T.with_views(f"""SELECT base, kind, diff, COUNT(*) AS n, MAX(confidence) AS confidence, arg_min(wrong, {{'k': -confidence, 'a': wrong, 'b': "right"}}) AS wrong, arg_min("right", {{'k': -confidence, 'a': wrong, 'b': "right"}}) AS "right" FROM (
 SELECT {_BASE.format('wrong')} AS base, kind, {_DIFF} AS diff, wrong, "right", confidence FROM (SELECT *, list_filter(string_split(wrong, ' '), lambda a: NOT list_contains(string_split("right", ' '), a)) AS g, list_filter(string_split("right", ' '), lambda a: NOT list_contains(string_split(wrong, ' '), a)) AS w FROM ({_PAIRS}))) GROUP BY 1, 2, 3""", "executions"))
def e14(spark, d):
    return Y.correction_rules(Y.corrections(T.executions(spark, d)))


@query("H22_similarity", T.with_views(f"SELECT DISTINCT x.command AS a, y.command AS b, CASE WHEN x.command = y.command THEN 1.0 ELSE {_SIM} END::DOUBLE AS similarity FROM executions x JOIN executions y ON x.session = y.session AND y.seq = x.seq + 1", "executions"))
def h22(spark, d):
    from pyspark.sql import Window

    rows = T.executions(spark, d).withColumn("b", F.lead("command").over(Window.partitionBy("session").orderBy("seq"))).where("b is not null")
    return rows.select(F.col("command").alias("a"), "b", Y.similarity(F.col("command"), F.col("b")).alias("similarity")).distinct()


#: Rules of each verdict; in SQL the same as prefixes at a word boundary and as patterns of * for any characters.
_RULES = [("git log", "allow"), ("git diff:*", "allow"), ("git * --json", "ask"), ("* -v", "ask"), ("rm *", "deny"), ("git diff * -v", "deny"), ("*--fast*-v*", "deny")]
_PREFIXES = {"allow": ["git log", "git diff"], "ask": [], "deny": ["rm"]}
_GLOBS = {"allow": [], "ask": ["git * --json", "* -v"], "deny": ["git diff * -v", "*--fast*-v*"]}
_HIT = {v: " OR ".join([f"s = '{p}' OR starts_with(s, '{p} ')" for p in _PREFIXES[v]] + [f"s GLOB '{g}'" for g in _GLOBS[v]]) for v in _PREFIXES}
_COMPOUND = """SELECT x.session, x.seq, x.command || (CASE x.seq % 6 WHEN 0 THEN ' && ' WHEN 1 THEN '|' WHEN 2 THEN '; ' WHEN 3 THEN ' || ' WHEN 4 THEN ' | rm -rf ' ELSE ';;' END) || COALESCE(y.command, '') AS command
 FROM executions x LEFT JOIN executions y ON x.session = y.session AND y.seq = x.seq + 1"""


def _compounds(spark, d):
    """Every command of a session with the next one, joined in six ways."""
    from pyspark.sql import Window

    join = F.element_at(F.array(*[F.lit(x) for x in (" && ", "|", "; ", " || ", " | rm -rf ", ";;")]), (F.col("seq") % 6 + 1).cast("int"))
    after = F.coalesce(F.lead("command").over(Window.partitionBy("session").orderBy("seq")), F.lit(""))
    return T.executions(spark, d).select("session", "seq", F.concat("command", join, after).alias("command"))


_PARTS = "SELECT session, seq, command, unnest(string_split(replace(replace(replace(command, '&&', ';'), '||', ';'), '|', ';'), ';')) AS part FROM (" + _COMPOUND + ")"


@query("C13_permissions", T.with_views(f"""SELECT session, seq, command, CASE WHEN bool_or({_HIT['deny']}) THEN 'deny' WHEN bool_or({_HIT['ask']}) THEN 'ask' WHEN bool_or({_HIT['allow']}) THEN 'allow' ELSE 'default' END AS verdict
 FROM (SELECT *, trim(part) AS s FROM ({_PARTS})) GROUP BY 1, 2, 3""", "executions"))
def c13(spark, d):
    return _compounds(spark, d).withColumn("verdict", Y.permission(F.col("command"), _RULES))


@query("C13_settings", """SELECT event_id, CASE event_type WHEN 'click' THEN 'rm *' WHEN 'view' THEN '* -v' WHEN 'error' THEN NULL ELSE 'git log ' || k END AS pattern, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 1 WHEN 'error' THEN 0 ELSE 1 END AS n
 FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""")
def c13_settings(spark, d):
    """Rules read from settings files, one an event, of which some aren't JSON."""
    of = F.when(F.col("event_type") == "click", "Bash(rm *)").when(F.col("event_type") == "view", "Bash(* -v)").otherwise(F.concat(F.lit("Bash(git log "), F.get_json_object("props", "$.k"), F.lit(")")))
    text = F.when(F.col("event_type") == "error", "not {json").otherwise(F.concat(F.lit('{"permissions": {"deny": ["Read(x)", "'), of, F.lit('"]}, "other": 1}')))
    found = Y.bash_patterns(text, "deny")
    return T.table(spark, d, "events").select("event_id", F.get(found, 0).alias("pattern"), F.size(found).alias("n"))


@query("A17_transcript_tail", "SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS user_text, arg_max(text, turn) FILTER (role = 'assistant') AS assistant_text FROM conversations WHERE text <> '' GROUP BY 1")
def a17(spark, d):
    last = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    return T.table(spark, d, "conversations").where("text <> ''").groupBy("conv_id").agg(last("user").alias("user_text"), last("assistant").alias("assistant_text"))
