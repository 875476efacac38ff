"""Filters from configuration, all built-in filters against a plain reading of them, reducers, cards, files, protocol."""

import hashlib
import json
import re
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from loomline.api import Workspace, serve
from loomline.functions import builtin
from loomline.functions import lines as L
from loomline.functions import text as X
from loomline.operators import extension as E
from loomline.operators import memory as M
from loomline.operators import reducers, render
from loomline.plans.extra import build_log
from loomline.sources import buildlog
from loomline.sources import files as FS
from loomline.sources import sessions


def plain(rule, text):
    """The stages of a filter, one after the other."""
    lines = [l.removesuffix("\r") for l in text.split("\n")]
    lines = lines[:-1] if lines[-1] == "" else lines
    if rule.strip_ansi:
        lines = [re.sub(r"\x1b\[[0-9;]*[a-zA-Z]", "", l) for l in lines]
    for pattern, by in rule.replace:
        lines = [re.sub(pattern, by, l) for l in lines]
    whole = "\n".join(lines)
    for pattern, message, unless in rule.match_output:
        if re.search(pattern, whole) and not (unless and re.search(unless, whole)):
            return message
    if rule.keep:
        lines = [l for l in lines if any(re.search(p, l) for p in rule.keep)]
    lines = [l for l in lines if not any(re.search(p, l) for p in rule.strip)]
    if rule.truncate_at is not None:
        lines = [l if len(l) <= rule.truncate_at else l[: rule.truncate_at - 3] + "..." for l in lines]
    if rule.tail is not None and len(lines) > rule.tail:
        lines = [f"... ({len(lines) - rule.tail} lines omitted)", *lines[-rule.tail :]]
    if rule.most is not None and len(lines) > rule.most:
        lines = [*lines[: rule.most], f"... ({len(lines) - rule.most} lines truncated)"]
    out = "\n".join(lines)
    return rule.on_empty if rule.on_empty is not None and not out.strip() else out


def examples(rule):
    """Outputs that reach each stage of a filter: its own patterns as lines, many lines, long lines, colours, nothing."""
    words = [re.sub(r"\\[sdwb][+*?]?|[\^$\\]|\(\?:|\[\^?[^\]]*\][+*]?|[*+?]", lambda m: {"\\s": " ", "\\d": "7", "\\w": "w"}.get(m[0][:2], ""), p) for p in rule.strip + rule.keep]
    words = [w.replace(".", "x").split("|")[0].strip("()") for w in words]
    many = [f"line {i} of the output" for i in range(250)]
    wide = ["w" * 300, "é" * 200, "short"]
    hits = [re.sub(r"\\d\+?", "7", re.sub(r"\\([().])", r"\1", m[0].split("|")[0])).replace("\\n\\s+", "\n    ") for m in rule.match_output]
    return ["", "\n\n", "\n".join(words), "\n".join([*words, "kept", *words]), "\n".join(many), "\n".join(wide) + "\n", "\x1b[31mred\x1b[0m\n\x1b[1m", "\r\n".join(["a", "", "b"])] + [f"before\n{h}\nafter" for h in hits] + [f"{h}\nerror: failed warning: x" for h in hits]


def test_all_built_in_filters(spark):
    cases = [(r.name, text, plain(r, text)) for r in builtin.FILTERS for text in examples(r)]
    assert len({c[0] for c in cases}) == 66
    df = spark.createDataFrame(cases, "filter string, input string, expected string")
    for at in range(0, len(builtin.FILTERS), 11):
        rules = builtin.FILTERS[at : at + 11]
        rows = E.self_tests(df.where(F.col("filter").isin([r.name for r in rules])), rules).where(~F.col("got").eqNullSafe(F.col("expected"))).collect()
        assert not rows, rows[0]


CONFIG = """
[filters.one]
description = "x"
match_command = "^one"
strip_ansi = true
replace = [{ pattern = "a(b)", replacement = "$1" }]
match_output = [{ pattern = "done", message = "ok", unless = "error" }]
keep_lines_matching = ["b"]
max_lines = 2
"""


def test_filters_from_configuration(spark):
    (rule,) = E.load_filters(CONFIG)
    assert (rule.name, rule.most, rule.match_output) == ("one", 2, [("done", "ok", "error")])
    for bad in ("[filters.x]\nmax_lines = 1", "not toml [", '[filters.x]\nmatch_command = "a"\nwhat = 1', '[filters.x]\nmatch_command = "a"\nkeep_lines_matching = ["a"]\nstrip_lines_matching = ["b"]'):
        with pytest.raises(E.FilterError):
            E.load_filters(bad)
    digest = hashlib.sha256(CONFIG.encode()).hexdigest()
    assert [r.name for r in E.registry(CONFIG, {digest}, None, [])[0]] == ["project:one"] and E.registry(CONFIG + " ", {digest}, "bad [", []) == ([], ["project: not trusted", E.registry(None, set(), "bad [", [])[1][0]])
    cases = spark.createDataFrame([("one", "ab\nab\nab\nx", "\nb\nb\n... (1 lines truncated)\n"), ("one", "b done", "ok"), ("two", "a", "a")], "filter string, input string, expected string")
    assert [r.passed for r in E.self_tests(cases, [rule]).collect()] == [True, True, False]


def test_reducers():
    assert reducers.reduced_output("pytest", "=== test session starts ===\n=== 3 passed, 1 skipped in 1s ===") == "pytest: 3 passed, 1 skipped"
    assert reducers.reduced_output("pytest", "") == "pytest: no tests" and reducers.reduced_output(None, "x") == "x" and reducers.reduced_output("x", None) is None
    assert reducers.reduced_output("git status", "On branch dev\n\tmodified:   a.py\n\tnew file:   b.py\n") == "* dev\nadded: 1\n  b.py\nmodified: 1\n  a.py"
    assert reducers.reduced_output("git status -s", "") == "clean"
    log = "commit 0123456789abcdef0123\nAuthor: A B <a@b.c>\nDate:   Mon\n\n    subject\n\n    body\ncommit fedcba9876543210\nAuthor: C\n\n    two"
    assert reducers.reduced_output("git log -2", log) == "0123456 Mon A B subject\nfedcba9 C two"
    assert reducers.reduced_output("cargo test", "---- a::b stdout ----\npanicked at x\n\nfailures:\n    a::b\n\ntest result: FAILED. 1 passed; 1 failed; 0 ignored\ntest result: ok. 2 passed; 0 failed; 1 ignored") == "cargo test: 3 passed, 1 failed, 1 ignored\na::b\n  panicked at x\n  "[:-3]
    assert reducers.reduced_output("rspec", "  1) A does\n     Failure/Error: x\n       expected 1\nFinished in 1 s\n2 examples, 1 failure") == "rspec: 2 examples, 1 failure\nA does\n  Failure/Error: x\n  expected 1"
    assert reducers.reduced_output("pip list", "Package Version\n------- ---\na  1.0\nb  2.0") == "2 packages\na 1.0\nb 2.0"
    hunk = "diff --git a/f b/f\n@@ -1 +1 @@\n" + "\n".join("+x" for _ in range(130))
    assert reducers.diff(hunk).endswith("  ... (30 lines cut)\n  +130 -0")


def value(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("v")).first()["v"]


def test_cards_keep_what_was_written_by_hand(spark):
    card = lambda old: value(spark, render.merged(F.col("o"), F.lit("new")), o=old)
    block = f"{render.START}\nnew\n{render.END}"
    assert card(None) == card("  ") == f"{block}\n\n## Notes\n" and card(f"a\n{render.START}\nold\n{render.END}\nmine") == f"a\n{block}\nmine"
    assert card("\nplain") == f"{block}\n\nplain" and card(f"{render.START} x") is None and card(f"{render.END} {render.START}") is None
    again = card(f"{block}\nx {render.START} y {render.END}")
    assert again == f"{block}\nx {render.START} y {render.END}" and card(f"x {render.END}") == f"{block}\n\nx {render.END}"
    source = value(spark, render.with_header(F.col("s"), F.lit("one"), F.lit("//")), s="code")
    assert value(spark, render.header(F.col("s")), s=source) == "one" and value(spark, render.with_header(F.col("s"), F.lit("one"), F.lit("//")), s=source) == source
    old = spark.createDataFrame([("gone", block + "\n\n## Notes\n"), ("noted", block + "\n\n## Notes\nmine"), ("here", "x")], "file_path string, card string")
    assert {r.file_path: r.deletable for r in render.orphans(old, old.where("file_path = 'here'")).collect()} == {"gone": True, "noted": False}


def test_versions(spark):
    for a, b, want in (("1.2.3", "1.2.4", -1), ("v2", "1.9.9", 1), ("1.2", "1.2.0", 0), ("1.10", "1.9", 1), ("1.0-rc1", "1.0", 0), ("x", "0", 0)):
        assert value(spark, X.version_order(F.col("a"), F.col("b")), a=a, b=b) == want


def test_ignored_files(spark):
    rules = "*.log\n!keep.log\n/top\nlib/\n# note\na/**/z\n"
    paths = {"x.log": 1, "d/x.log": 1, "keep.log": 0, "top": 1, "d/top": 0, "lib/a": 1, "d/lib/b/c": 1, "lib": 0, "a/z": 1, "a/b/c/z": 1, "a/zz": 0, "sub/one.txt": 1, "other/one.txt": 0}
    df = spark.createDataFrame([(f"file:/r/{p}",) for p in paths], "path string")
    left = {r.path.removeprefix("file:/r/") for r in FS.without_ignored(df, "/r", {"": rules, "sub": "*.txt"}).collect()}
    assert left == {p for p, gone in paths.items() if not gone}


def test_sqlite_tables_and_sessions(spark, tmp_path):
    with sqlite3.connect(tmp_path / "f.db") as con:
        con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, x REAL)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i * 3, f"n{i}" if i % 4 else None, i / 2) for i in range(1, 1001)])
        con.execute("CREATE TABLE empty (id INTEGER)")
    rows = FS.sqlite_table(spark, str(tmp_path / "f.db"), "t", "name string, x double")
    assert rows.count() == 1000 and rows.where("name is null").count() == 250 and rows.agg(F.sum("x")).first()[0] == sum(i / 2 for i in range(1, 1001))
    assert FS.sqlite_table(spark, str(tmp_path / "f.db"), "empty", "id long").count() == 0
    (tmp_path / "s" / "p").mkdir(parents=True)
    (tmp_path / "s" / "p" / "a.jsonl").write_text('{"type": "user"}\nbroken\n[1]\n{"x": 1}\n')
    sessions.register(spark)
    assert sorted((r.line_no, r.type) for r in spark.read.format("session_log").load(str(tmp_path / "s")).collect()) == [(0, "user"), (3, None)]


def test_tables_are_replaced_under_a_lock(spark, tmp_path):
    folder = f"file://{tmp_path}/g"
    for n in (2, 5):
        FS.replace_table(spark.range(n), folder)
        assert spark.read.parquet(folder).count() == n
    assert sorted(p.name for p in tmp_path.iterdir()) == ["g"]
    with FS.refresh_lock(spark, folder) as mine, FS.refresh_lock(spark, folder, wait=0.2) as other:
        assert mine and not other
    with FS.refresh_lock(spark, folder, wait=0.2) as again:
        assert again
        began = time.monotonic()
        with FS.refresh_lock(spark, folder, wait=5, stale=-1) as taken:
            assert taken and time.monotonic() - began < 4


def test_memory_store_and_protocol(spark):
    rows = [("m1", "u1", None, "rule", "use tabs always", "active", 0.9, 5), ("m2", "u1", "p", "fact", "tabs are wide tabs", "active", 0.8, 1), ("m3", "u2", None, "fact", "tabs", "active", 0.8, 1), ("m4", "u1", None, "fact", "nothing", "archived", 0.8, 1)]
    store = M.MemoryStore(spark.createDataFrame(rows, "id string, user_id string, project_id string, type string, content string, status string, confidence double, priority int"))
    assert [r.id for r in store.search("TABS?", "u1").collect()] == ["m2", "m1"] and [r.id for r in store.search("tabs", "u1", project="q").collect()] == ["m1"]
    new = spark.createDataFrame([("n1", "u1", "Use  tabs always"), ("n2", "u1", "fresh")], "id string, user_id string, content string").withColumn("status", F.lit("active"))
    assert sorted(r.id for r in store.add(new).rows.collect()) == ["m1", "m2", "m3", "m4", "n2"]
    assert store.delete_all("u1", "forget").rows.count() == 1
    symbols = spark.createDataFrame([("a", "alpha", "function", "f.py", 1, 3), ("b", "beta", "class", "g.py", 1, 2)], "id string, name string, kind string, file_path string, line_start int, line_end int")
    edges = spark.createDataFrame([("a", "b", "CALLS")], "source string, target string, type string")
    lines = spark.createDataFrame([("f.py", 2, "x = alpha()"), ("g.py", 9, "alpha")], "file_path string, line_no int, line string")
    tools = Workspace(symbols, edges, lines).tools()
    call = lambda n, name, **given: json.dumps({"id": n, "method": "tools/call", "params": {"name": name, "arguments": given}})
    asked = ["", "broken", call(1, "grep", pattern="alpha"), call(2, "ask", question="beta"), call(3, "ask", wrong=1), '{"method": "tools/list"}', '{"id": 4, "method": "nope"}', '{"id": 5, "method": "shutdown"}', call(6, "map")]
    answers = [json.loads(a) for a in serve(asked, tools)]
    assert [a["id"] for a in answers] == [None, 1, 2, 3, 4, 5] and [r["symbol"] for r in answers[1]["result"]["rows"]] == ["a", None] and answers[2]["result"]["rows"][0]["id"] == "b"
    assert "error" in answers[0] and "error" in answers[3] and "error" in answers[4]


def test_whole_stages_by_name(spark):
    code = "// note\nfn a() {\n  x\n}\n"
    assert value(spark, E.by_strategy(F.col("t"), "aggressive"), t=code) == "fn a() {\n    // ... implementation" and value(spark, E.by_strategy(F.col("t"), "none"), t=code) == code
    assert tuple(value(spark, E.tiered(F.col("t"), F.lit(None).cast("int"), F.lit(None).cast("int"), "w", 3), t="abcdef")) == (3, None, ["not parsed"], "abc\n[truncated]")
    assert L.Rule("a", "x").most is None


def test_build_logs(spark):
    events = [("started", "-", "-", 1), ("error", "CS1", "é.cs", 300), ("warning", "CS2", "b.cs", 2), ("finished", "-", "-", 90_000)]
    whole = build_log(events)
    rows = list(buildlog.parse(whole))
    assert [r[0] for r in rows] == ["started", "error", "warning", "finished"] and rows[1] == ("error", "CS1", "é.cs", 300, 7, "p.csproj", "wrong CS1", 300) and rows[3][-1] == 90_000
    logs = [("ok", whole), ("old", build_log(events, 17)), ("cut", whole[: len(whole) // 2]), ("none", b""), ("null", None), ("text", b"x" * 40)]
    got = buildlog.build_events(spark.createDataFrame(logs, "path string, content binary")).collect()
    assert {r.path for r in got if r.problem} == {"old", "cut", "none", "null", "text"} and sum(r.path == "ok" for r in got) == 4
