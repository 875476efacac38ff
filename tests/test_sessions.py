"""Session files as a stream: lines that grow in parts, restarts; ignore files by their folders; lazy fingerprints."""

import tempfile

from pyspark.sql import functions as F

from loomline.operators import graph as G
from loomline.sources import files as FS
from loomline.sources import sessions


def test_growing_files_give_each_line_once(spark):
    sessions.register(spark)
    folder, state, seen = tempfile.mkdtemp(), tempfile.mkdtemp(), []

    def add(name, data):
        with open(f"{folder}/{name}.jsonl", "ab") as file:
            file.write(data)

    def run():
        before = len(seen)
        stream = spark.readStream.format("session_log").load(folder)
        query = stream.writeStream.option("checkpointLocation", state).foreachBatch(lambda df, k: seen.extend(map(tuple, df.collect()))).start()
        query.processAllAvailable()
        query.stop()
        return [(r[0].rsplit("/", 1)[1], r[1], r[2]) for r in sorted(seen[before:])]

    add("a", b'{"type": "user"}\nnot json\n{"type": "assis')
    assert run() == [("a.jsonl", 0, "user")]
    add("a", b'tant"}\n[1]\n')
    add("b", '{"type": "é"}\r\n{"type": "x"}'.encode())
    assert run() == [("a.jsonl", 26, "assistant"), ("b.jsonl", 0, "é")]
    assert run() == []
    add("b", b"\n")
    assert run() == [("b.jsonl", 16, "x")]


def test_line_starts(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"ab\n" + b"c" * 100 + b"\nd")
    with open(path, "rb") as file:
        for at, want in ((0, 0), (1, 0), (3, 3), (4, 3), (50, 3), (104, 104), (105, 104)):
            assert sessions._line_start(file, at, step=7) == want


def test_ignore_files(spark):
    ignores = [
        ("r", "", "# note\n*.log\n!keep.log\n/build/\ndocs/*.txt\n**/tmp\na/**/z\nq?.c\n[!x]y.d\n\\#odd\nlast \n"), ("r", "sub", "*.md\n!keep.md\n/only\n"), ("r", "build", "!x.c\n"), ("s", "", "*\n!*.py\n"),
    ]
    gone = ["x.log", "sub/x.log", "build/x.c", "build/d/y", "docs/a.txt", "tmp", "u/tmp", "u/tmp/f", "a/z", "a/b/c/z", "q1.c", "ay.d", "#odd", "last", "sub/x.md", "sub/only", "sub/d/x.md"]
    kept = ["keep.log", "sub/keep.log", "u/build/x.c", "docs/d/a.txt", "tmp2", "q12.c", "xy.d", "x.md", "sub/keep.md", "sub/d/only", "other/only", "a.c"]
    files = spark.createDataFrame([("r", p, 1) for p in gone + kept] + [("s", "a.py", 1), ("s", "b.c", 1), ("s", "d/a.py", 1), ("t", "x.log", 1)], "repo string, path string, n int")
    got = {(r.repo, r.path) for r in FS.not_ignored(files, spark.createDataFrame(ignores, "repo string, folder string, text string")).collect()}
    assert got == {("r", p) for p in kept} | {("s", "a.py"), ("t", "x.log")}


def test_only_what_differs_is_hashed(spark):
    sha = lambda t: spark.range(1).select(F.sha2(F.lit(t), 256).alias("h")).first()["h"]
    before = spark.createDataFrame([("same", 1, 1, "kept"), ("touched", 1, 1, sha("t")), ("edited", 1, 1, "x"), ("gone", 1, 1, "x"), ("unread", 1, 1, "x")], "path string, size int, mtime int, hash string")
    now = spark.createDataFrame([("same", 1, 1, "never read"), ("touched", 1, 2, "t"), ("edited", 2, 1, "e"), ("new", 1, 1, "n"), ("unread", 1, 2, None)], "path string, size int, mtime int, content string")
    got = {r.path: (r.status, r.hash) for r in G.probed(now, before, now).collect()}
    assert got == {"same": ("unchanged", "kept"), "touched": ("unchanged", sha("t")), "edited": ("changed", sha("e")), "new": ("added", sha("n")), "unread": ("changed", None), "gone": ("removed", None)}
    assert {r.path: r.status for r in G.probed(now, before, now, strict=True).collect()}["same"] == "changed"
