"""Further queries: sources and sinks round trips, line views, scopes, streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import machines as MA
from ..functions import text as X
from ..operators import history as Y
from ..operators import retrieval as R
from ..operators import usage as U
from ..operators.graph import cut
from ..sources import files as FS
from ..sources import tables as T
from ..streaming import machines as SM
from ..streaming import streams as ST
from .catalog import query


def _folder(spark, name: str) -> str:
    """A fresh folder where all executors can write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loomline-')}"
    return f"{base.rstrip('/')}/loomline-{name}-{uuid.uuid4().hex}"


@query("B1_append_usage", T.with_views("SELECT strftime(timestamp, '%Y-%m-%d') AS day, COUNT(*) * 2 AS n, SUM(saved_tokens)::BIGINT * 2 AS saved FROM commands WHERE timestamp >= TIMESTAMP '2024-01-20' GROUP BY 1", "commands"))
def b1(spark, d):
    folder = _folder(spark, "usage")
    for _ in range(2):
        FS.append_usage(T.commands(spark, d), folder)
    rows = FS.read_usage(spark, folder, "2024-01-20")
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("saved_tokens").alias("saved"))


@query("B2_append_failures", T.with_views("SELECT raw_command, COUNT(*) AS n FROM parse_failures GROUP BY 1", "parse_failures"))
def b2(spark, d):
    folder = _folder(spark, "failures")
    T.parse_failures(spark, d).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).groupBy("raw_command").agg(F.count(F.lit(1)).alias("n"))


@query("B3_delete_project", T.with_views("SELECT project_path, COUNT(*) AS n FROM commands WHERE NOT (project_path = '/p/2' OR starts_with(project_path, '/p/2/')) GROUP BY 1", "commands"))
def b3(spark, d):
    folder = _folder(spark, "usage")
    T.commands(spark, d).write.parquet(folder)
    FS.delete_rows(spark, folder, U.in_scope(F.col("project_path"), "/p/2"))
    return spark.read.parquet(folder).groupBy("project_path").agg(F.count(F.lit(1)).alias("n"))


@query("B4_export_csv", T.with_views("SELECT lom_cmd, COUNT(*) AS n FROM commands GROUP BY 1", "commands"))
def b4(spark, d):
    folder = _folder(spark, "csv")
    FS.export(U.by_command(T.commands(spark, d)).select("lom_cmd", "n"), folder, "csv")
    return spark.read.option("header", True).schema("lom_cmd string, n long").csv(folder)


@query("A2_passthrough", T.with_views("SELECT SUM(input_tokens)::BIGINT AS input_tokens, 100.0::DOUBLE * SUM(saved_tokens) / SUM(input_tokens) AS savings_pct, COUNT(*) * 2 AS commands FROM commands", "commands"))
def a2(spark, d):
    rows = T.commands(spark, d)
    passed = rows.withColumns({c: F.lit(0).cast("long") for c in ("input_tokens", "output_tokens", "saved_tokens")})
    return U.summary(rows.unionByName(passed)).select("input_tokens", "savings_pct", "commands")


@query("A18_federation", "SELECT repo, COUNT(*) AS n FROM (SELECT 'a' AS repo, p_partkey FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'b', p_partkey FROM part WHERE p_partkey % 3 = 0) GROUP BY 1")
def a18(spark, d):
    folder, part = _folder(spark, "repos"), T.table(spark, d, "part")
    for name, rows in (("a", part.where("p_partkey % 2 = 0")), ("b", part.where("p_partkey % 3 = 0").drop("p_size"))):
        rows.write.parquet(f"{folder}/repo={name}")
    return FS.federated(spark, folder).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query("H2_savings_pct", T.with_views("SELECT id, saved_tokens, savings_pct FROM commands", "commands"))
def h2(spark, d):
    return T.commands(spark, d).select("id", "saved_tokens", U.savings_pct(F.col("input_tokens"), F.col("saved_tokens")).alias("savings_pct"))


@query("H8_period_keys", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(ts, '%Y-%m') AS month FROM events")
def h8(spark, d):
    return T.table(spark, d, "events").select("event_id", *[T.period_key(F.col("ts"), u).alias(u) for u in ("day", "week", "month")])


@query("H12_log_levels", "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' WHEN 'view' THEN 'info' ELSE 'none' END AS level FROM events")
def h12(spark, d):
    line = F.when(F.col("event_type") == "error", "PANIC: info lost").when(F.col("event_type") == "click", "Warning info").when(F.col("event_type") == "view", "INFO ok").otherwise("debug")
    return T.table(spark, d, "events").select("event_id", F.coalesce(X.log_level(line), F.lit("none")).alias("level"))


@query("H18_classify_prefixed", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'none' ELSE 'lom pytest' END AS target FROM events")
def h18(spark, d):
    command = F.when(F.col("event_type") == "view", "cd x").when(F.col("event_type") == "error", "A=1 B=2 pytest -q").otherwise("/usr/local/bin/pytest tests")
    return T.table(spark, d, "events").select("event_id", F.coalesce(Y.classified(command)["target"], F.lit("none")).alias("target"))


@query("H23_unpiped", "SELECT event_id, 'git log ' || user_id AS command FROM events")
def h23(spark, d):
    tail = F.element_at(F.array(*[F.lit(t) for t in (" | head -5", " 2>&1 | tail", " > out.txt", "")]), (F.col("event_id") % 4 + 1).cast("int"))
    return T.table(spark, d, "events").select("event_id", Y._unpiped(F.concat(F.lit("git log "), "user_id", tail)).alias("command"))


@query("H24_difference", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '-a → -b' WHEN 1 THEN 'removed -a' ELSE 'added -c' END AS diff FROM events")
def h24(spark, d):
    pair = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % 3 + 1).cast("int"))
    return T.table(spark, d, "events").select("event_id", Y.difference(pair(("git x -a", "git x -a", "git x")), pair(("git x -b", "git x", "git x -c"))).alias("diff"))


@query("H35_output_kind", "SELECT event_id, (['test', 'build', 'log', 'json', 'list', 'generic'])[(event_id % 6 + 1)::INT] AS kind FROM events")
def h35(spark, d):
    texts = ("3 tests passed", "Compiling x", "warn: y", ' {"a": 1}', "a\nb", "x\ty")
    return T.table(spark, d, "events").select("event_id", X.output_kind(F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 6 + 1).cast("int"))).alias("kind"))


@query("H41_modules", "SELECT p_partkey, p_brand AS module FROM part")
def h41(spark, d):
    return T.table(spark, d, "part").select("p_partkey", X.top_module(F.concat_ws("/", "p_brand", "p_type", "p_name")).alias("module"))


_SOURCE = "'import os' || chr(10) || text || chr(10) || 'pub fn f' || doc_id || '(x) {' || chr(10) || '    x' || chr(10) || '}' || chr(10) || 'const K' || doc_id || ' = 1;'"


def _source():
    """A document between lines of code."""
    return F.concat(F.lit("import os\n"), "text", F.lit("\npub fn f"), "doc_id", F.lit("(x) {\n    x\n}\nconst K"), "doc_id", F.lit(" = 1;"))


#: Documents as code: by a line's number a signature, nested braces, a constant, or the text's own line.
_CODE = ["pub fn f(x) {", "  if x {", "  let y = 1;", "  }", "}", "const K = 2;", "import os"]


def _coded(spark, d):
    lines = F.posexplode(F.split("text", "\n"))
    rows = T.table(spark, d, "documents").select("doc_id", lines.alias("n", "line"))
    kinds = F.array(*[F.lit(c) for c in _CODE])
    k = F.expr("(doc_id + n) % 9").cast("int")
    return rows.select("doc_id", "n", F.when(k < len(_CODE), F.get(kinds, k)).otherwise(F.col("line")).alias("line")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))


#: Line after line in SQL: depth and whether a body is open, and what each line leaves.
OUTLINED = """(WITH RECURSIVE coded AS ({coded}),
 marked AS (SELECT *, trim(line, ' ') AS t, CASE WHEN regexp_matches(trim(line, ' '), '^(use |import |from |require\\(|#include)') THEN 'import' WHEN regexp_matches(trim(line, ' '), '^(pub\\s+)?(async\\s+)?(fn|def|function|func|class|struct|enum|trait|interface|type)\\s+\\w+') THEN 'signature'
  WHEN regexp_matches(trim(line, ' '), '^(pub )?(const |static )|^let ') THEN 'constant' ELSE '' END AS what, length(line) - length(replace(line, '{{', '')) - length(line) + length(replace(line, '}}', '')) AS net FROM coded),
 r AS (SELECT doc_id, -1::BIGINT AS n, FALSE AS inside, 0::BIGINT AS depth, []::VARCHAR[] AS kept FROM (SELECT DISTINCT doc_id FROM marked) UNION ALL
  SELECT m.doc_id, m.n, CASE WHEN what = 'import' THEN inside WHEN what = 'signature' THEN TRUE WHEN inside THEN depth + net > 0 ELSE inside END, CASE WHEN what = 'import' THEN depth WHEN what = 'signature' THEN 0 WHEN inside THEN depth + net ELSE depth END,
  CASE WHEN what IN ('import', 'signature') OR (what = 'constant' AND NOT inside) THEN [line] WHEN inside THEN list_concat(CASE WHEN depth + net <= 1 AND (t IN ('{{', '}}') OR t LIKE '%{{') THEN [line] ELSE [] END, CASE WHEN depth + net <= 0 AND t NOT IN ('', '}}') THEN ['    // ... implementation'] ELSE [] END) ELSE [] END
  FROM r JOIN marked m ON m.doc_id = r.doc_id AND m.n = r.n + 1) SELECT doc_id, array_to_string(flatten(list(kept ORDER BY n)), chr(10)) AS outline FROM r GROUP BY 1)"""
_NUMBERED = "(SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


_CODED = f"SELECT doc_id, n, CASE WHEN (doc_id + n) % 9 < {len(_CODE)} THEN {_CODE}[(doc_id + n) % 9 + 1] ELSE line END AS line FROM {_NUMBERED}"


@query("C5_outline", f"SELECT doc_id, md5(outline) AS outline FROM {OUTLINED.format(coded=_CODED)}")
def c5(spark, d):
    return _coded(spark, d).select("doc_id", F.md5(L.joined(L.outline(F.col("lines")))).alias("outline"))


@query("C6_smart_truncate", f"""SELECT doc_id, md5(array_to_string(CASE WHEN len(l) <= 6 THEN l ELSE list_concat(k, ['// ... ' || (len(l) - len(k)) || ' more lines']) END, chr(10))) AS short
 FROM (SELECT doc_id, l, list_concat(l[1:3], list_filter(l[4:], lambda x: regexp_matches(x, '{L.IMPORTANT}')))[1:5] AS k FROM (SELECT doc_id, string_split({_SOURCE}, chr(10)) AS l FROM documents))""")
def c6(spark, d):
    return T.table(spark, d, "documents").select("doc_id", F.md5(L.joined(L.important(L.to_lines(_source()), 6))).alias("short"))


@query("C11_under_prefix", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#1'")
def c11(spark, d):
    return T.table(spark, d, "part").where(U.in_scope(F.concat_ws("/", "p_brand", "p_name"), "Brand#1")).select("p_partkey")


@query("F2_lookahead", T.with_views("SELECT session, seq, COUNT(*) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM executions", "executions"))
def f2(spark, d):
    return T.executions(spark, d).select("session", "seq", F.count(F.lit(1)).over(Window.partitionBy("session").orderBy("seq").rowsBetween(1, 3)).alias("ahead"))


@query("F3_carry_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS header FROM events")
def f3(spark, d):
    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), True).over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return T.table(spark, d, "events").select("event_id", last.cast("double").alias("header"))


@query("F5_type_caps", T.with_views("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY type ORDER BY confidence DESC, id) AS r FROM memories) WHERE r <= 7", "memories"))
def f5(spark, d):
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("confidence"), "id"))
    return T.memories(spark, d).withColumn("r", rank).where("r <= 7").select("id")


@query("K7_participation", "SELECT scope FROM (SELECT p_brand AS scope, SUM(p_size) / 5000.0::DOUBLE AS share, COUNT(*) / 200.0::DOUBLE AS coverage, MAX(p_retailprice) AS best FROM part GROUP BY 1) WHERE (share >= 0.1 OR coverage >= 0.5) AND best >= 0.25 * (SELECT MAX(b) FROM (SELECT MAX(p_retailprice) AS b, SUM(p_size) / 5000.0::DOUBLE AS share, COUNT(*) / 200.0::DOUBLE AS coverage FROM part GROUP BY p_brand) WHERE share >= 0.1 OR coverage >= 0.5)")
def k7(spark, d):
    scopes = T.table(spark, d, "part").groupBy(F.col("p_brand").alias("scope")).agg((F.sum("p_size") / 5000.0).alias("share"), (F.count(F.lit(1)) / 200.0).alias("coverage"), F.max("p_retailprice").alias("best"))
    return R.participating(scopes).select("scope")


@query("K12_skeleton", T.with_views("SELECT file_path, md5(string_agg(CASE WHEN m > 0 THEN '  ' ELSE '' END || name, chr(10) ORDER BY line_start, id)) AS outline FROM (SELECT s.*, (SELECT COUNT(*) FROM symbols o WHERE o.file_path = s.file_path AND s.line_start > o.line_start AND s.line_end <= o.line_end) AS m FROM symbols s) GROUP BY 1", "symbols"))
def k12(spark, d):
    return R.skeleton(T.symbols(spark, d)).withColumn("outline", F.md5("outline"))


@query("L11_packages", T.with_views("SELECT array_to_string(l[1:least(len(l) - 1, 3)], '/') AS package, COUNT(*) AS n FROM (SELECT string_split(lower(replace(name, ' ', '/')) || '/' || file_path, '/') AS l FROM symbols) GROUP BY 1", "symbols"))
def l11(spark, d):
    path = F.concat(F.lower(F.regexp_replace("name", " ", "/")), F.lit("/"), "file_path")
    package = F.array_join(F.slice(F.split(X.directory_of(path), "/"), 1, 3), "/")
    return T.symbols(spark, d).groupBy(package.alias("package")).agg(F.count(F.lit(1)).alias("n"))


_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def _event_stream(spark, d):
    return spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)


@query("I1_captured_stream", "SELECT event_type, COUNT(*) AS n, SUM(least(length(props), 8))::BIGINT AS chars, COUNT(*) FILTER (length(props) > 8) AS cut FROM events GROUP BY 1")
def i1(spark, d):
    rows = ST.captured(_event_stream(spark, d).withColumnRenamed("props", "value_text"), "value_text", 8).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value_text")).alias("chars"), F.count_if("cut").alias("cut"))
    return ST.run_once(rows, "complete", _folder(spark, "stream"))


@query("I8_windows_stream", "SELECT date_trunc('day', ts) AS start, COUNT(*) AS commands, SUM(floor(value))::BIGINT AS saved FROM events GROUP BY 1")
def i8(spark, d):
    facts = _event_stream(spark, d).select(F.col("ts").alias("timestamp"), F.floor("value").alias("saved_tokens"))
    return ST.run_once(ST.windowed_usage(facts), "complete", _folder(spark, "stream"))


@query("I3_extraction_stream", "SELECT user_id, COUNT(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'error')) GROUP BY 1")
def i3(spark, d):
    turns = _event_stream(spark, d).select("user_id", "ts", F.when(F.col("event_type") == "view", "always use tabs").when(F.col("event_type") == "error", "never  use TABS").otherwise("hello").alias("user"))
    rows = ST.extracted_once(turns, "ts", "100 days").select("user_id", "normal")
    return ST.run_once(rows, "append", _folder(spark, "stream")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


#: Events as lines of test runs, one a user: an error opens a failure, other events are lines under it; a closing line ends the run.
_RUN_ITEMS = """SELECT run, k - 1 AS n, string_agg(text, chr(10) ORDER BY seq) AS text FROM (SELECT *, SUM(opens) OVER (PARTITION BY run ORDER BY seq) AS k FROM (
 SELECT 'u' || user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, (event_type = 'error')::INT AS opens, CASE WHEN event_type = 'error' THEN '___ test_' || event_id || ' ___' ELSE 'E ' || event_type || ' ' || event_id END AS text FROM events)) WHERE k > 0 GROUP BY 1, 2"""


def _run_lines(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    id_ = F.col("event_id").cast("string")
    text = F.when(F.col("event_type") == "error", F.concat(F.lit("___ test_"), id_, F.lit(" ___"))).otherwise(F.concat(F.lit("  E "), "event_type", F.lit(" "), id_))
    events = T.table(spark, d, "events")
    rows = events.select(F.concat(F.lit("u"), "user_id").alias("run"), F.row_number().over(order).cast("long").alias("seq"), text.alias("line"))
    first = events.where("event_type = 'error'").select(F.concat(F.lit("u"), "user_id").alias("run")).distinct()
    ends = first.select("run", F.lit(1 << 60).alias("seq"), F.lit("=== some failed ===").alias("line"))
    starts = events.select(F.concat(F.lit("u"), "user_id").alias("run")).distinct().select("run", F.lit(0).cast("long").alias("seq"), F.lit("=== FAILURES ===").alias("line"))
    quiet = rows.join(first, "run", "left_semi")
    before = quiet.withColumn("_k", F.sum(F.col("line").startswith("___").cast("int")).over(Window.partitionBy("run").orderBy("seq"))).where("_k > 0").drop("_k")
    return before.unionByName(ends).unionByName(starts.join(first, "run", "left_semi"))


@query("I5_machine_fold", _RUN_ITEMS)
def i5_fold(spark, d):
    runs = _run_lines(spark, d).groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]).alias("lines"))
    return runs.select("run", F.posexplode(MA.run(F.col("lines"), MA.MACHINES["pytest"])["items"]).alias("n", "text")).withColumn("n", F.col("n").cast("long"))


@query("I5_machine_stream", _RUN_ITEMS)
def i5_stream(spark, d):
    """The same from a stream: what comes first and what comes later of each run are in files of their own, and each makes a
    batch or two. Batches don't grow in number with the tables, since each one opens and saves all of the state's parts."""
    folder, lines = _folder(spark, "lines"), _run_lines(spark, d).transform(cut)
    late, files = lines.select("run", "seq", "line", (F.col("seq") > 40).alias("late")), int(spark.conf.get("spark.sql.shuffle.partitions"))
    for part in (False, True):
        late.where(F.col("late") == part).select("run", "seq", "line").repartition(files, "run").write.mode("append").parquet(folder)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = ST.table_stream(spark, folder, "run string, seq long, line string", files)
        found = ST.run_once(SM.machine_stream(stream, MA.MACHINES["pytest"]), "append", _folder(spark, "stream"))
    finally:
        spark.conf.set(key, before)
    return found.where("kind = 'item'").select("run", "n", "text")


#: Commands with what they print and what is left of it, @ being the event; lines are joined by |.
_PRINTED = [
    ("ruff check", "a.py:@:1: E5 long|noise|Found 1 error.", "Found 1 error.|a.py:@:1: E5 long"), ("cargo build", "   Compiling x|error[E1]: bad @| --> b.rs:2|error: could not compile x", "error: could not compile x|error[E1]: bad @|--> b.rs:2"),
    ("git diff HEAD", "diff --git a/x b/x|index 1|@@ -1 +1 @@|-a@|+b| c", "diff --git a/x b/x|@@ -1 +1 @@|-a@|+b"), ("unknown @", "as it is @| kept", "as it is @| kept"), ("npx eslint .", "/a.ts|  1:2  error  e@|  3:4  warning  w|✖ 2 problems", "✖ 2 problems|/a.ts|1:2  error  e@|3:4  warning  w"),
]
_LEFT = ", ".join(f"({i}, '{left}')" for i, (_, _, left) in enumerate(_PRINTED))


@query("C18_machines", f"SELECT event_id, replace(left_, '|', chr(10)) AS output FROM (SELECT event_id, replace(replace(l, '@@', chr(1)), '@', event_id::VARCHAR) AS l0, replace(l0, chr(1), '@@') AS l1, l1 AS left_ FROM events JOIN (VALUES {_LEFT}) v(i, l) ON i = event_id % {len(_PRINTED)})")
def c18_machines(spark, d):
    def filled(column: int):
        parts = F.element_at(F.array(*[F.lit(p[column].replace("|", "\n").replace("@@", "\x01")) for p in _PRINTED]), (F.col("event_id") % len(_PRINTED) + 1).cast("int"))
        return F.replace(F.replace(parts, F.lit("@"), F.col("event_id").cast("string")), F.lit("\x01"), F.lit("@@"))

    return T.table(spark, d, "events").select("event_id", MA.reduced(filled(0), filled(1)).alias("output"))
