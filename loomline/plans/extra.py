"""Queries of extension points, rendered texts, reducers, file round trips and the workspace's tools."""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import json
import os
import sqlite3
import struct

import pandas as pd
from pyspark.sql import functions as F

from ..api import Workspace, serve
from ..functions import lines as L
from ..functions import text as X
from ..operators import extension as E
from ..operators import graph as G
from ..operators import memory as M
from ..operators import reducers, render
from ..sources import buildlog as BL
from ..sources import files as FS
from ..sources import tables as T
from .catalog import query
from .more import _SOURCE, OUTLINED, _folder, _source


def _pick(column: str, values: list[str]):
    """One of some values, by a number's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(column) % len(values) + 1).cast("int"))


def _pick_sql(column: str, values: list[str]) -> str:
    spelled = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{spelled}])[({column} % {len(values)} + 1)::INT]"


_WHOLE = "text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'oops' ELSE '' END"


@query("A1_captured", f"SELECT doc_id, doc_id % 3 AS exit_code, md5(CASE WHEN doc_id % 3 <> 0 OR doc_id % 2 = 1 THEN {_WHOLE} WHEN contains({_WHOLE}, 'oops') THEN 'failed' ELSE array_to_string(list_filter(string_split({_WHOLE}, chr(10)), lambda l: NOT contains(l, 'the')), chr(10)) END) AS shown FROM documents")
def a1(spark, d):
    rules = [L.Rule("run", "^run", match_output=[("oops", "failed", None)], strip=["the"])]
    docs = T.table(spark, d, "documents")
    outputs = docs.select("doc_id", _pick("doc_id", ["run x", "see x"]).alias("command"), F.col("text").alias("stdout"), F.when(F.col("doc_id") % 5 == 0, "oops").otherwise("").alias("stderr"), (F.col("doc_id") % 3).alias("exit_code"))
    return E.run_filtered(outputs, rules, skip_failures=True).select("doc_id", "exit_code", F.md5("shown").alias("shown"))


@query("A4_session_files", "SELECT conv_id % 3 AS project, COUNT(*) AS n, MAX(length(text)) AS longest FROM conversations WHERE conv_id % 3 = 1 GROUP BY 1")
def a4(spark, d):
    folder = _folder(spark, "sessions")
    rows = T.table(spark, d, "conversations").select((F.col("conv_id") % 3).alias("project"), F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value"))
    rows.write.partitionBy("project").text(folder)
    _rename(spark, folder, lambda path: path.removesuffix(".txt") + ".jsonl")
    entry = F.from_json("line", "conv_id long, text string")
    return FS.session_lines(spark, folder, project="project=1").select(entry.alias("e")).groupBy((F.col("e.conv_id") % 3).alias("project")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("e.text")).alias("longest"))


def _rename(spark, folder: str, named) -> None:
    """Gives the text files below a folder other names."""
    path, fs = FS._path(spark, folder)
    files = fs.listFiles(path, True)
    while files.hasNext():
        file = files.next().getPath()
        if file.getName().endswith(".txt"):
            fs.rename(file, spark._jvm.org.apache.hadoop.fs.Path(named(file.toString())))


def _nations(spark, d, name: str) -> str:
    folder = _folder(spark, name)
    T.table(spark, d, "nation").select("n_regionkey", "n_name").write.partitionBy("n_regionkey").text(folder)
    return folder


@query("A7_walk", "SELECT n_regionkey AS region, SUM(length(n_name) + 1)::BIGINT AS chars FROM nation WHERE n_regionkey NOT IN (1, 3) GROUP BY 1")
def a7(spark, d):
    folder = _nations(spark, d, "walk")
    files = FS.without_ignored(FS.source_tree(spark, folder), folder.removeprefix("file://"), {"": "*.crc\n_*\nn_regionkey=1/\n", "n_regionkey=3": "*.txt\n"})
    return files.groupBy(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("long").alias("region")).agg(F.sum(F.length("content")).alias("chars"))


@query("A15_read", "SELECT n_regionkey AS region, CASE n_regionkey % 3 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' ELSE 'unknown' END AS language, SUM(length(n_name) + 1)::BIGINT AS chars FROM nation GROUP BY 1, 2")
def a15(spark, d):
    """Files named by their region: of Rust, of Python, or of nothing known."""
    folder = _nations(spark, d, "read")
    _rename(spark, folder, lambda path: path.removesuffix(".txt") + {"0": ".rs", "1": ".py", "2": ".q"}[str(int(path.split("n_regionkey=")[1].split("/")[0]) % 3)])
    files = FS.whole_files(spark, folder, "*.{rs,py,q}")
    return files.groupBy(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("long").alias("region"), "language").agg(F.sum(F.length("text")).alias("chars"))


@query("B5_replaced", "SELECT kind, COUNT(*) AS n FROM (SELECT lower(p_type) AS kind FROM part) GROUP BY 1")
def b5(spark, d):
    folder = _folder(spark, "graph")
    symbols = T.symbols(spark, d)
    for rows in (symbols.limit(3), symbols):
        FS.replace_table(rows, folder)
    return spark.read.parquet(folder).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("B11_tee", """SELECT doc_id || '_run-' || doc_id % 3 || '.log' AS file, md5(CASE WHEN octet_length(encode(t)) > 40 THEN substr(t, 1, 40) || chr(10) || chr(10) || '--- truncated at 40 bytes ---' ELSE t END) AS content
 FROM (SELECT doc_id, 'x' || repeat('y', n_chars % 90) AS t FROM documents) WHERE doc_id % 2 = 1 AND octet_length(encode(t)) >= 10 ORDER BY doc_id DESC LIMIT 20""")
def b11(spark, d):
    raw = F.concat(F.lit("x"), F.expr("repeat('y', cast(n_chars % 90 as int))"))
    outputs = T.table(spark, d, "documents").select(F.concat(F.lit("Run "), F.col("doc_id") % 3).alias("slug"), F.col("doc_id").alias("epoch"), (F.col("doc_id") % 2).alias("exit_code"), raw.alias("raw"))
    return FS.teed(outputs, 10, 40, 20).withColumn("content", F.md5("content"))


_CARD = "'# ' || file_path || chr(10) || chr(10) || symbols || chr(10) || chr(10) || 'used by ' || COALESCE(n, 0) || ' files'"
_NOTED = f"'intro' || chr(10) || '{render.START}' || chr(10) || 'old' || chr(10) || '{render.END}' || chr(10) || 'my notes'"
_FILES = "SELECT DISTINCT a.file_path AS source_file, b.file_path AS target_file FROM edges e JOIN symbols a ON a.id = e.source JOIN symbols b ON b.id = e.target WHERE a.file_path <> b.file_path"


@query("B9_cards", T.with_views(f"""SELECT file_path, status, md5(card) AS card FROM (SELECT file_path, CASE WHEN file_path LIKE 'Brand1/%' THEN 'written' WHEN file_path LIKE 'Brand2/%' THEN 'skipped' ELSE 'written' END AS status,
 CASE WHEN file_path LIKE 'Brand1/%' THEN 'intro' || chr(10) || w || chr(10) || 'my notes' WHEN file_path LIKE 'Brand2/%' THEN '{render.START} cut' ELSE w || chr(10) || chr(10) || '## Notes' || chr(10) END AS card FROM (
 SELECT file_path, '{render.START}' || chr(10) || {_CARD} || chr(10) || '{render.END}' AS w FROM (SELECT file_path, string_agg('- ' || kind || ' ' || name, chr(10) ORDER BY line_start, id) AS symbols FROM symbols GROUP BY 1)
 LEFT JOIN (SELECT target_file AS file_path, COUNT(*) AS n FROM ({_FILES}) GROUP BY 1) USING (file_path)))""", "symbols", "edges"))
def b9(spark, d):
    symbols, edges = T.symbols(spark, d), T.calls(spark, d)
    noted = F.lit(f"intro\n{render.START}\nold\n{render.END}\nmy notes")
    old = symbols.select("file_path").distinct().withColumn("card", F.when(F.col("file_path").startswith("Brand1/"), noted).when(F.col("file_path").startswith("Brand2/"), f"{render.START} cut")).where("card is not null")
    made = render.cards(symbols, G.file_edges(edges, symbols), old)
    return made.select("file_path", "status", F.md5("card").alias("card"))


@query("B12_learned", """SELECT base, md5('## ' || upper(substr(base, 1, 1)) || substr(base, 2) || chr(10) || string_agg(line, chr(10) ORDER BY n DESC, line) || chr(10)) AS section FROM (
 SELECT 'git ' || p_size % 5 AS base, p_size AS n, '- Use `' || p_type || '` not `' || p_name || '`' || CASE WHEN p_size > 1 THEN ' (seen ' || p_size || 'x)' ELSE '' END AS line FROM part) GROUP BY base""")
def b12(spark, d):
    rules = T.table(spark, d, "part").select(F.concat(F.lit("git "), F.col("p_size") % 5).alias("base"), F.col("p_name").alias("wrong"), F.col("p_type").alias("right"), F.col("p_size").alias("n"))
    return render.learned(rules).withColumn("section", F.md5("section"))


def _block(comment: str, text: str) -> str:
    return f"'{comment} {render.HEADER}' || chr(10) || '{comment} ' || {text} || chr(10) || '{comment} {render.HEADER_END}' || chr(10)"


@query("L12_headers", f"""SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN '#!/bin/sh' || chr(10) || {_block('#', "'doc ' || doc_id")} || text WHEN 1 THEN 'a' || chr(10) || {_block('#', "'doc ' || doc_id")} || text ELSE {_block('#', "'doc ' || doc_id")} || text END) AS source,
 CASE WHEN doc_id % 3 = 1 THEN 'old' END AS before FROM documents""")
def l12(spark, d):
    old = f"a\n# {render.HEADER}\n# old\n# {render.HEADER_END}\n"
    source = F.concat(F.when(F.col("doc_id") % 3 == 0, "#!/bin/sh\n").when(F.col("doc_id") % 3 == 1, old).otherwise(""), "text")
    return T.table(spark, d, "documents").select("doc_id", F.md5(render.with_header(source, F.concat(F.lit("doc "), "doc_id"), F.lit("#"))).alias("source"), render.header(source).alias("before"))


@query("H40_versions", "SELECT p_partkey, sign((p_size - 25) * 1000000 + (p_partkey % 4 - 1))::INT AS \"order\" FROM part")
def h40(spark, d):
    version = F.concat(F.lit("v"), "p_size", F.lit("."), F.col("p_partkey") % 4, F.lit("-rc1"))
    return T.table(spark, d, "part").select("p_partkey", X.version_order(version, F.lit("25.1.0")).alias("order"))


_PROJECT = '[filters.deploy]\nmatch_command = "^deploy"\nmax_lines = 3\n'
_USER = '[filters.make]\nmatch_command = "^make"\nstrip_lines_matching = ["^x"]\n[filters.broken]\nmatch_command = "^deploy"\n'
_RUN = ["deploy all", "make x", "df -h", "nothing", "jq ."]


@query("J1_lookup", f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'project:deploy' WHEN 1 THEN 'user:make' WHEN 2 THEN 'df' WHEN 4 THEN 'jq' END AS filter, CASE event_id % 5 WHEN 0 THEN 'user:broken' WHEN 1 THEN 'user:make' WHEN 2 THEN 'df' WHEN 4 THEN 'jq' END AS untrusted FROM events")
def j1(spark, d):
    digest = hashlib.sha256(_PROJECT.encode()).hexdigest()
    command = _pick("event_id", _RUN)
    found = lambda digests: L.first_rule(command, E.registry(_PROJECT, digests, _USER)[0])
    return T.table(spark, d, "events").select("event_id", found({digest}).alias("filter"), found(set()).alias("untrusted"))


_PLAIN_LINES = f"SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split({_SOURCE}, chr(10)) AS l FROM documents)"


@query("J2_strategies", f"SELECT doc_id, md5({_SOURCE}) AS none, md5(outline) AS aggressive FROM documents JOIN {OUTLINED.format(coded=_PLAIN_LINES)} o USING (doc_id)")
def j2(spark, d):
    source = F.concat(F.lit("// note\n"), _source())
    rows = T.table(spark, d, "documents").select("doc_id", _source().alias("plain"), source.alias("source"))
    return rows.select("doc_id", F.md5(E.by_strategy(F.col("plain"), "none")).alias("none"), F.md5(E.by_strategy(F.col("source"), "aggressive")).alias("aggressive"))


@query("J3_tiers", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS tier, CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN user_id END::INT AS passed, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS failed,
 CASE event_id % 3 WHEN 0 THEN 0 ELSE 1 END AS warnings, CASE WHEN event_id % 3 = 2 THEN 'noise ' || user_id END AS raw FROM events""")
def j3(spark, d):
    report = F.concat(F.lit("run\n"), F.to_json(F.struct(F.col("user_id").alias("numPassedTests"), F.lit(2).alias("numFailedTests"))))
    text = F.when(F.col("event_id") % 3 == 0, report).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Tests: "), "user_id", F.lit(" passed"))).otherwise(F.concat(F.lit("noise "), "user_id"))
    rows = T.table(spark, d, "events").select("event_id", E.test_counts(text).alias("t"))
    return rows.select("event_id", "t.tier", "t.data.passed", "t.data.failed", F.size("t.warnings").alias("warnings"), "t.raw")


@query("J7_function", "SELECT doc_id, md5(replace(text, 'the', '*')) AS output FROM documents")
def j7(spark, d):
    docs = T.table(spark, d, "documents").select("doc_id", F.col("text").alias("output"))
    return E.by_function(docs, lambda t: t.replace("the", "*")).withColumn("output", F.md5("output"))


_PYTEST = "=== test session starts ===\ncollected 3 items\n\na.py .F.  [100%]\n=== FAILURES ===\n___ test_ID ___\n\n    def test_ID():\n>       assert ID == 0\nE       assert ID == 0\n\na.py:2: AssertionError\n=== short test summary info ===\nFAILED a.py::test_ID\n=== 1 failed, 2 passed in 0.10s ==="
_DIFF = "diff --git a/x/ID.py b/x/ID.py\nindex 1..2\n--- a/x/ID.py\n+++ b/x/ID.py\n@@ -1,2 +1,3 @@ def f\n a\n-ID\n+b\n+c\n d"
_STATUS = "## main...origin/main\n M ID.py\n?? new\nA  add.py\n?? other"
_CARGO = "   Compiling x v0.1\nwarning: unused ID\n --> src/a.rs:1:2\n\nerror[E0308]: mismatched types\n --> src/b.rs:ID:1\n  |\n1 | x\n\nerror: could not compile `x`"
_REDUCED = [
    ("pytest -q", _PYTEST, "pytest: 2 passed, 1 failed\ntest_ID\n  >       assert ID == 0\n  E       assert ID == 0"),
    ("git diff", _DIFF, "x/ID.py\n  @@ -1,2 +1,3 @@ def f\n  -ID\n  +b\n  +c\n   d\n  +2 -1"),
    ("git status --short", _STATUS, "* main\nadded: 1\n  add.py\nmodified: 1\n  ID.py\nuntracked: 2\n  new\n  other"),
    ("cargo build", _CARGO, "cargo: 1 errors, 1 warnings\nerror[E0308]: mismatched types\n --> src/b.rs:ID:1\n  |\n1 | x\nwarning: unused ID\n --> src/a.rs:1:2"),
    ("other", "ID", "ID"),
]


@query("C18_reducers", f"SELECT event_id, replace({_pick_sql('event_id', [r for _, _, r in _REDUCED])}, 'ID', event_id::VARCHAR) AS shown FROM events")
def c18(spark, d):
    text = F.replace(_pick("event_id", [t for _, t, _ in _REDUCED]), F.lit("ID"), F.col("event_id").cast("string"))
    return T.table(spark, d, "events").select("event_id", reducers.reduce_by_tool(_pick("event_id", [c for c, _, _ in _REDUCED]), text).alias("shown"))


@query("N5_search", T.with_views(r"""SELECT id, type, round(least(s, 1.0), 9) AS score FROM (SELECT id, SUM(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len * n / words))) AS s FROM (
 SELECT i.id, i.tf, l.len, (SELECT COUNT(*) FROM memories) AS n, (SELECT SUM(tf) FROM i) AS words, COUNT(*) OVER (PARTITION BY i.term) AS df FROM i JOIN (SELECT id, SUM(tf) AS len FROM i GROUP BY 1) l USING (id) WHERE term IN ('please', 'the', 'explain')) GROUP BY id)
 JOIN memories USING (id) WHERE user_id = 'u1' AND status = 'active' AND (project_id IS NULL OR project_id = 'proj1') ORDER BY score DESC, id LIMIT 25""", "memories", i=r"SELECT id, term, COUNT(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')) AS term FROM memories) GROUP BY 1, 2"))
def n5(spark, d):
    return M.searched(T.memories(spark, d), "Please explain the?", "u1", 25, project="proj1")


@query("N10_scope", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'u' || c_custkey ELSE 'local' END AS \"user\", CASE WHEN c_custkey % 2 = 0 THEN 'repo' || c_nationkey ELSE 'work' END AS project, CASE WHEN c_custkey % 5 = 0 THEN 's1' END AS session, CAST(NULL AS VARCHAR) AS agent, '/home/work' AS workspace FROM customer")
def n10(spark, d):
    env = F.create_map(F.lit("MEMORY_USER_ID"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("u"), "c_custkey")).otherwise(""), F.lit("SESSION_ID"), F.lit(""), F.lit("MEMORY_SESSION_ID"), F.when(F.col("c_custkey") % 5 == 0, "s1"))
    root = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("/src/repo"), "c_nationkey", F.lit("/")))
    return T.table(spark, d, "customer").select("c_custkey", M.scope(env, F.lit("local"), root, F.lit("/home/work")).alias("s")).select("c_custkey", "s.*")


@query("N11_events", "SELECT event_id AS id, event_type, ts AS created_at FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id LIMIT 15")
def n11(spark, d):
    log = T.table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("user_id"))
    return M.events(log, "7", 15).drop("user_id")


@query("B13_export", T.with_views("SELECT id, md5('## ' || id || ' (' || type || ')' || chr(10) || chr(10) || content || chr(10)) AS text FROM memories WHERE user_id = 'u1' AND status = 'active' ORDER BY priority DESC, updated_at DESC, id LIMIT 10000", "memories"))
def b13(spark, d):
    return M.exported(T.memories(spark, d), "u1", "markdown").withColumn("text", F.md5("text"))


@query("A16_import", T.with_views("""SELECT id, user_id, source, md5(content) AS content FROM (SELECT *, 'u2' AS own, 'user' AS source, row_number() OVER (PARTITION BY k ORDER BY id) AS r FROM (SELECT id, content, lower(regexp_replace(trim(content, ' '), '\\s+', ' ', 'g')) AS k FROM memories WHERE user_id = 'u1' AND status = 'active')) JOIN (SELECT 'u2' AS user_id) ON true
 WHERE r = 1 AND k NOT IN (SELECT lower(regexp_replace(trim(content, ' '), '\\s+', ' ', 'g')) FROM memories WHERE user_id = 'u2' AND status = 'active')""", "memories"))
def a16(spark, d):
    store = T.memories(spark, d)
    lines = M.exported(store, "u1", "json", most=None).select("text").unionByName(spark.createDataFrame([("not json",)], "text string"))
    return M.imported(store, lines, "u2").select("id", "user_id", "source", F.md5("content").alias("content"))


@query("J5_store", T.with_views("SELECT status, COUNT(*) AS n FROM (SELECT CASE WHEN user_id = 'u3' THEN 'archived' ELSE status END AS status FROM memories WHERE priority <> 1) GROUP BY 1", "memories"))
def j5(spark, d):
    store = M.MemoryStore(T.memories(spark, d)).forget(F.col("priority") == 1).delete_all("u3")
    return store.rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("I4_refresh", "SELECT page_id::VARCHAR AS file_path, CASE WHEN page_id % 5 = 0 OR page_id % 7 = 3 THEN length(html) ELSE -1 END::BIGINT AS n FROM pages WHERE page_id % 7 <> 0")
def i4(spark, d):
    files = T.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.length("html").alias("size"), F.lit(1).alias("mtime"), F.md5("html").alias("hash"), "html", "page_id")
    prints = files.where("page_id % 7 <> 3").withColumn("mtime", F.when(F.col("page_id") % 5 == 0, 0).otherwise(1)).withColumn("hash", F.when(F.col("page_id") % 5 == 0, "old").otherwise(F.col("hash")))
    old = prints.select(F.col("path").alias("file_path"), F.lit(-1).cast("long").alias("n"))
    return FS.refreshed(old, prints, files.where("page_id % 7 <> 0"), lambda todo: todo.select(F.col("path").alias("file_path"), F.length("html").cast("long").alias("n")))


def _workspace(spark, d) -> Workspace:
    symbols = T.symbols(spark, d)
    files = symbols.select("file_path", (F.col("line_start") * 10).alias("line_no"), F.col("name").alias("line")).groupBy("file_path", "line_no").agg(F.min("line").alias("line"))
    return Workspace(symbols, T.edges(spark, d), files)


@query("J9_relations", T.with_views("SELECT e.target AS \"of\", e.source AS id, e.type, s.name FROM edges e JOIN symbols s ON s.id = e.source JOIN symbols t ON t.id = e.target WHERE t.name = 'red widget' AND e.type = 'CALLS'", "symbols", "edges"))
def j9_relations(spark, d):
    return _workspace(spark, d).relations("red widget", "in", ["CALLS"]).select("of", "id", "type", "name")


@query("J9_map", T.with_views("""SELECT * FROM (SELECT 'directory' AS what, split_part(file_path, '/', 1) AS name, COUNT(*) AS n FROM symbols GROUP BY 2)
 UNION ALL SELECT * FROM (SELECT 'hub' AS what, target AS name, COUNT(*) AS n FROM edges GROUP BY 2 ORDER BY n DESC, name LIMIT 10)""", "symbols", "edges"))
def j9_map(spark, d):
    return _workspace(spark, d).map()


@query("J9_check", T.with_views("SELECT DISTINCT file_path, 'missing' AS state FROM symbols", "symbols"))
def j9_check(spark, d):
    return _workspace(spark, d).check()


@query("I2_protocol", T.with_views("SELECT * FROM (VALUES (1, 6), (2, 5), (4, 0), (5, 0)) UNION ALL SELECT 3, COUNT(*)::INT FROM symbols WHERE file_path = 'none' HAVING COUNT(*) >= 0", "symbols").replace("SELECT * FROM (VALUES", "SELECT id, rows FROM (VALUES").replace("(5, 0)) UNION", "(5, 0)) v(id, rows) UNION"))
def i2(spark, d):
    call = lambda number, name, **given: json.dumps({"id": number, "method": "tools/call", "params": {"name": name, "arguments": given}})
    asked = ['{"id": 1, "method": "tools/list"}', "", call(2, "ask", question="red widget", n=5), call(3, "skeleton", path="none"), '{"method": "note"}', call(4, "nothing"), '{"id": 5, "method": "exit"}', call(6, "map")]
    answers = [json.loads(line) for line in serve(asked, _workspace(spark, d).tools())]
    rows = [(a["id"], len(a.get("result", {}).get("rows", a.get("result", {}).get("tools", [])))) for a in answers]
    return spark.createDataFrame(rows, "id int, rows int")


@query("A6_sqlite", "SELECT s_nationkey, COUNT(*) AS n, MAX(s_name) AS last FROM supplier GROUP BY 1")
def a6(spark, d):
    folder = _folder(spark, "sqlite").removeprefix("file://")
    os.makedirs(folder)
    with contextlib.closing(sqlite3.connect(f"{folder}/facts.db")) as con, con:
        con.execute("CREATE TABLE supplier (name TEXT, nation INTEGER)")
        con.executemany("INSERT INTO supplier VALUES (?, ?)", T.table(spark, d, "supplier").select("s_name", "s_nationkey").toLocalIterator())
    rows = FS.sqlite_table(spark, f"{folder}/facts.db", "supplier", "name string, nation int")
    return rows.groupBy(F.col("nation").alias("s_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("last"))


def _seven(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def build_log(events: list[tuple[str, str, str, int]], version: int = 18) -> bytes:
    """A small build log of (kind, code, file, line) events."""
    strings: dict[str, int] = {}
    out = [struct.pack("<ii", version, version)]

    def text(value: str | None) -> bytes:
        if value is None:
            return _seven(0)
        if value not in strings:
            strings[value] = BL.FIRST_STRING + len(strings)
            data = value.encode()
            out.append(_seven(BL.STRING) + _seven(len(data)) + data)
        return _seven(strings[value])

    numbers = {name: kind for kind, name in BL.KINDS.items()}
    for kind, code, file, line in events:
        head = _seven(BL.MESSAGE | BL.CONTEXT | BL.TIMESTAMP) + text(f"wrong {code}") + bytes(7) + (BL.EPOCH + line * 10_000).to_bytes(8, "little") + _seven(1)
        rest = b"" if kind in ("started", "finished") else text(None) + text(code) + text(file) + text("p.csproj") + _seven(line) + _seven(7) + _seven(line) + _seven(7)
        out.append(_seven(BL.NAMES) + _seven(2) + b"xx" + _seven(numbers[kind]) + _seven(len(head + rest)) + head + rest)
    return gzip.compress(b"".join([*out, _seven(BL.END)]))


@query("A14_build_log", """SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS kind, 'CS' || user_id % 90 AS code, 'f' || user_id % 13 || '.cs' AS file, (event_id % 300)::INT AS line, 'wrong CS' || user_id % 90 AS message, COUNT(*) AS n, MAX(event_id % 300)::BIGINT AS at FROM events GROUP BY 1, 2, 3, 4, 5""")
def a14(spark, d):
    kind = F.when(F.col("event_type") == "error", "error").otherwise("warning")
    item = F.struct(kind, F.concat(F.lit("CS"), F.col("user_id") % 90), F.concat(F.lit("f"), F.col("user_id") % 13, F.lit(".cs")), (F.col("event_id") % 300).cast("int"))
    lists = T.table(spark, d, "events").groupBy(F.expr("event_id div 100").cast("string").alias("path")).agg(F.collect_list(item).alias("events"))

    def encoded(values: pd.Series) -> pd.Series:
        return values.map(lambda own: build_log([("started", "-", "-", 1), *(tuple(e.values()) if isinstance(e, dict) else tuple(e) for e in own), ("finished", "-", "-", 2)]))

    logs = lists.select("path", F.pandas_udf(encoded, "binary")("events").alias("content"))
    found = BL.build_events(logs).where("code is not null")
    return found.groupBy("kind", "code", "file", "line", "message").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))
