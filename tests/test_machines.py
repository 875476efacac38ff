"""Line machines: outputs of tools as literal cases, streams equal to the fold, restarts and timers."""

import tempfile
import time

import pytest
from pyspark.sql import functions as F

from loomline.functions import machines as M
from loomline.streaming import machines as SM

CASES = {
    "pytest": ("=== test session starts ===\nplatform x\ncollected 3 items\ntests/a.py .F. [100%]\n=== FAILURES ===\n___ test_b ___\n  def test_b():\n\nE  assert 1\n___ test_c ___\nE no\n=== short test summary info ===\nFAILED tests/a.py::test_b - x\n=== 2 failed, 1 passed in 0.1s ===", ["___ test_b ___\ndef test_b():\nE  assert 1", "___ test_c ___\nE no", "FAILED tests/a.py::test_b - x"], "=== 2 failed, 1 passed in 0.1s ==="),
    "cargo test": ("running 2 tests\ntest a ... ok\ntest b ... FAILED\n\nfailures:\n\n---- b stdout ----\nthread 'b' panicked\nnote: run with `RUST_BACKTRACE=1`\n\nfailures:\n    b\n\ntest result: FAILED. 1 passed; 1 failed", ["test b ... FAILED", "---- b stdout ----\nthread 'b' panicked", "b"], "test result: FAILED. 1 passed; 1 failed"),
    "cargo build": ("   Compiling x\nwarning: unused\n --> a.rs:1\nerror[E0308]: mismatched\n --> b.rs:2:3\n  |\nerror: could not compile `x`", ["error[E0308]: mismatched\n--> b.rs:2:3\n|"], "error: could not compile `x`"),
    "rspec": ("..F\n\nFailures:\n\n  1) A does\n     Failure/Error: x\n     # ./a.rb:1\n\nFinished in 0.1 seconds\n3 examples, 1 failure\n\nFailed examples:\n\nrspec ./a.rb:2 # A", ["1) A does\nFailure/Error: x", "rspec ./a.rb:2 # A"], "3 examples, 1 failure"),
    "go test": ("=== RUN TestA\n--- PASS: TestA (0.0s)\n=== RUN TestB\n--- FAIL: TestB (0.0s)\n    a_test.go:3: no\nFAIL\nFAIL\tm\t0.01s", ["--- FAIL: TestB (0.0s)\na_test.go:3: no"], "FAIL\tm\t0.01s"),
    "jest": ("PASS a.test.js\nFAIL b.test.js\n  ● b › works\n\n    expect(1)\n      at x (node_modules/y)\n\nTests:       1 failed, 2 passed", ["● b › works\nexpect(1)"], "Tests:       1 failed, 2 passed"),
    "git diff": ("diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n c\ndiff --git a/y b/y\nnew mode 1", ["diff --git a/x b/x\n@@ -1 +1 @@\n-a\n+b", "diff --git a/y b/y"], None),
    "tsc": ("a.ts(1,2): error TS1: x\n  more\nb.ts(3,4): error TS2: y\nFound 2 errors", ["a.ts(1,2): error TS1: x\nmore", "b.ts(3,4): error TS2: y"], "Found 2 errors"),
    "mypy": ("a.py:1: error: x  [e]\na.py:1: note: see\nb.py:2: note: alone\nFound 1 error in 1 file", ["a.py:1: error: x  [e]\na.py:1: note: see\nb.py:2: note: alone"], "Found 1 error in 1 file"),
    "terraform plan": ("Refreshing\n  # aws_x.y will be created\n  + resource \"a\" \"b\" {\n      + id = 1\n    }\n\nPlan: 1 to add", ["# aws_x.y will be created\n+ resource \"a\" \"b\" {\n+ id = 1"], "Plan: 1 to add"),
    "make": ("cc a.c\na.c:1:2: warning: w\na.c:3:4: error: e\n 3 | x\n   | ^\nmake: *** [a.o] Error 1", ["a.c:3:4: error: e\n3 | x\n| ^"], "make: *** [a.o] Error 1"),
    "eslint": ("\n/a/b.ts\n  1:2  error  no  rule\n  3:4  warning  w  r2\n\n/c.js\n  5:6  error  x  r\n\n✖ 3 problems (2 errors, 1 warning)", ["/a/b.ts\n1:2  error  no  rule\n3:4  warning  w  r2", "/c.js\n5:6  error  x  r"], "✖ 3 problems (2 errors, 1 warning)"),
    "ruff": ("a.py:1:2: E501 long\n  |\nFound 1 error.", ["a.py:1:2: E501 long"], "Found 1 error."),
    "pylint": ("*** Module a\na.py:1:0: C0114: Missing (x)\n---\nYour code has been rated at 5/10", ["a.py:1:0: C0114: Missing (x)"], "Your code has been rated at 5/10"),
    "rubocop": ("Inspecting 2 files\n.C\na.rb:1:2: C: Style/X: no\n  x\n2 files inspected, 1 offense", ["a.rb:1:2: C: Style/X: no"], "2 files inspected, 1 offense"),
    "golangci-lint": ("a.go:1:2: not used (unused)\n\tfunc x() {}\n\t     ^\nb.go:3:4: y (z)\n2 issues:", ["a.go:1:2: not used (unused)\nfunc x() {}", "b.go:3:4: y (z)"], "2 issues:"),
    "cargo clippy": ("    Checking x\nwarning: needless\n  --> a.rs:1\n   |\nerror[E1]: bad\n  --> b.rs:2\nwarning: `x` generated 1 warning", ["warning: needless\n--> a.rs:1", "error[E1]: bad\n--> b.rs:2"], "warning: `x` generated 1 warning"),
    "docker build": ("#1 [internal] load\n#2 ERROR: exit 1\n------\n > RUN x\n#3 [2/2] y\nERROR: failed to solve", ["#2 ERROR: exit 1\n> RUN x"], "ERROR: failed to solve"),
    "pip install": ("Collecting x\nWARNING: old pip\nSuccessfully installed x-1", ["WARNING: old pip"], "Successfully installed x-1"),
    "gradle": ("> Task :a\n> Task :b FAILED\n\n* What went wrong:\nExecution failed\n\n* Try:\n> Run\nBUILD FAILED in 1s", ["> Task :b FAILED", "* What went wrong:\nExecution failed"], "BUILD FAILED in 1s"),
    "maven": ("[INFO] x\n[ERROR] A.java:[1,2] bad\n[ERROR] Tests run: 2, Failures: 1\n[INFO] BUILD FAILURE", ["[ERROR] A.java:[1,2] bad", "[ERROR] Tests run: 2, Failures: 1"], "[INFO] BUILD FAILURE"),
    "dotnet build": ("a.cs(1,2): error CS1: x [p]\nBuild FAILED.\na.cs(1,2): error CS1: x [p]", ["a.cs(1,2): error CS1: x [p]"], "Build FAILED."),
    "dotnet test": ("  Failed A.B [1 ms]\n  Error Message:\n   no\n  Stack Trace:\n   at x\nFailed!  - Failed: 1", ["Failed A.B [1 ms]\nno"], "Failed!  - Failed: 1"),
    "phpunit": ("..F\n\n1) A::b\nFailed\n\na.php:1\n\nFAILURES!\nTests: 3, Failures: 1.", ["1) A::b\nFailed\na.php:1"], "Tests: 3, Failures: 1."),
    "mocha": ("  ✓ a\n\n  1 passing\n  1 failing\n\n  1) b works:\n     Error: no\n      at x.js:1", ["1) b works:\nError: no"], "1 failing"),
    "vitest": (" FAIL  a.test.ts > b\nAssertionError: x\n ❯ a.test.ts:1\n Tests  1 failed | 2 passed", ["FAIL  a.test.ts > b\nAssertionError: x"], "Tests  1 failed | 2 passed"),
    "playwright": ("  1) [chromium] › a.spec.ts:1\n    Error: no\n      3 | x\n    at y\n  1 failed", ["1) [chromium] › a.spec.ts:1\nError: no"], "1 failed"),
    "mix test": ("..\n  1) test a (B)\n     test/a.exs:1\n     no\n\nFinished in 0.1\n3 tests, 1 failure", ["1) test a (B)\ntest/a.exs:1\nno"], "3 tests, 1 failure"),
    "shellcheck": ("In a.sh line 3:\necho $x\n     ^-- SC2086\n\nFor more information:", ["In a.sh line 3:\necho $x\n^-- SC2086"], "For more information:"),
    "hadolint": ("Dockerfile:1 DL3006 warning: tag\nother", ["Dockerfile:1 DL3006 warning: tag"], None),
    "ninja": ("[1/2] cc a\nFAILED: a.o\ncc a.c\nerror\n[2/2] cc b\nninja: build stopped: x", ["FAILED: a.o\ncc a.c\nerror"], "ninja: build stopped: x"),
    "cmake": ("-- Found x\nCMake Error at a:1 (y):\n  bad\n\n-- Configuring incomplete, errors", ["CMake Error at a:1 (y):\nbad"], "-- Configuring incomplete, errors"),
    "ansible-playbook": ("TASK [x]\nok: [h]\nfatal: [g]: FAILED!\nPLAY RECAP ***\nh   : ok=1 changed=0", ["fatal: [g]: FAILED!", "h   : ok=1 changed=0"], None),
    "git push": ("Enumerating objects: 3\nTo github.com:a/b\n   1a2b..3c4d  main -> main\n ! [rejected] x -> x", ["To github.com:a/b", "1a2b..3c4d  main -> main", "! [rejected] x -> x"], None),
    "xcodebuild": ("CompileSwift x\n/a.swift:1:2: error: bad\n** BUILD FAILED **", ["/a.swift:1:2: error: bad"], "** BUILD FAILED **"),
    "swift test": ("Test Case 'a' started\n/a.swift:1: error: A.b : no\nExecuted 2 tests, with 1 failure", ["/a.swift:1: error: A.b : no"], "Executed 2 tests, with 1 failure"),
    "prettier": ("Checking\n[warn] a.ts\n[warn] Code style issues found", ["[warn] a.ts"], "[warn] Code style issues found"),
    "black": ("would reformat a.py\nOh no!\n1 file would be reformatted", ["would reformat a.py"], "1 file would be reformatted"),
    "webpack": ("asset a.js 1 KiB\nERROR in ./a.ts\nModule not found\n\nwebpack 5 compiled with 1 error", ["ERROR in ./a.ts\nModule not found"], "webpack 5 compiled with 1 error"),
    "npm": ("npm ERR! code E404\nnpm ERR! 404 Not Found\n3 vulnerabilities\nadded 5 packages", ["3 vulnerabilities", "npm ERR! code E404\nnpm ERR! 404 Not Found"], "added 5 packages"),
}


def test_machines(spark):
    df = spark.createDataFrame([(n, t) for n, (t, _, _) in CASES.items()], "name string, t string")
    lines = F.split("t", "\n")
    found = df.select("name", *[M.run(lines, steps).alias(name) for name, steps in M.MACHINES.items()]).collect()
    for r in found:
        _, items, note = CASES[r.name]
        assert (r[r.name]["items"], r[r.name]["note"]) == (items, note), r.name
    assert set(CASES) == set(M.MACHINES)


def test_outputs_by_command(spark):
    assert set(M.COMMANDS) == set(M.MACHINES)
    rows = [("cargo test --all", CASES["cargo test"][0]), ("git status", "as it is"), ("ruff check", "nothing here"), ("python -m pytest -q", "\n".join(["=== short test summary"] + [f"FAILED t{i}" for i in range(60)]))]
    got = [r.v for r in spark.createDataFrame(rows, "c string, t string").select(M.reduced(F.col("c"), F.col("t")).alias("v")).collect()]
    assert got[0] == CASES["cargo test"][2] + "\n" + "\n".join(CASES["cargo test"][1]) and got[1:3] == ["as it is", "nothing here"]
    assert got[3].splitlines()[0] == "FAILED t0" and got[3].splitlines()[50:] == ["... 10 more"]


def test_actions_are_checked():
    with pytest.raises(ValueError):
        M.Step("", "x", "", "jump")


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


SCHEMA = "run string, seq long, line string"


def test_stream_is_the_fold_and_goes_on_after_a_restart(rocks):
    """The lines of two runs come in three files; the query is stopped and started again after the first."""
    folder, state = tempfile.mkdtemp(), tempfile.mkdtemp()
    text = CASES["pytest"][0].split("\n")
    rows = [(run, i, line) for run in ("a", "b") for i, line in enumerate(text)]
    seen = []

    def run_now():
        stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        SM.machine_stream(stream, M.MACHINES["pytest"]).writeStream.option("checkpointLocation", state).foreachBatch(lambda df, k: seen.extend(map(tuple, df.collect()))).trigger(availableNow=True).start().awaitTermination()

    for low, high in ((0, 7), (7, 10), (10, 99)):
        rocks.createDataFrame([r for r in rows if low <= r[1] < high][::-1], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        run_now()
    for run in ("a", "b"):
        mine = sorted((r[1:] for r in seen if r[0] == run), key=lambda r: (r[0], r[1]))
        assert [t for n, k, t in mine if k == "item"] == CASES["pytest"][1] and [t for n, k, t in mine if k == "note"] == [CASES["pytest"][2]]


def test_an_open_block_leaves_after_a_while(rocks):
    folder, state = tempfile.mkdtemp(), tempfile.mkdtemp()
    rocks.createDataFrame([("a", i, x) for i, x in enumerate(["=== FAILURES ===", "___ t ___", "E x"])], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    seen = []
    query = SM.machine_stream(rocks.readStream.schema(SCHEMA).parquet(folder), M.MACHINES["pytest"], wait_ms=500).writeStream.option("checkpointLocation", state).foreachBatch(lambda df, k: seen.extend(map(tuple, df.collect()))).trigger(processingTime="1 second").start()
    until = time.time() + 60
    while time.time() < until and not any(r[2] == "cut" for r in seen):
        time.sleep(1)
    query.stop()
    assert ("a", 0, "cut", "___ t ___\nE x") in seen


def test_long_blocks_stay_whole(rocks):
    """Blocks of more lines than any that were held, within a batch and over four; a run's next block is its own."""
    folder, state, seen = tempfile.mkdtemp(), tempfile.mkdtemp(), []
    lines = ["=== FAILURES ===", "___ t ___", *(f"E {i}" for i in range(25_000)), "___ u ___", "E x", "=== 1 failed ==="]
    for part in ([("a", i, x) for i, x in enumerate(lines)], *([("b", i, x) for i, x in enumerate(lines)][k : k + 9_000] for k in range(0, len(lines), 9_000))):
        rocks.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        SM.machine_stream(stream, M.MACHINES["pytest"]).writeStream.option("checkpointLocation", state).foreachBatch(lambda df, k: seen.extend(map(tuple, df.collect()))).trigger(availableNow=True).start().awaitTermination()
    whole = "\n".join(lines[1:25_002])
    assert sorted(r for r in seen if r[2] == "item") == [(run, n, "item", text) for run in ("a", "b") for n, text in enumerate([whole, "___ u ___\nE x"])]


def test_a_long_block_leaves_whole_after_a_while(rocks):
    folder, state, seen = tempfile.mkdtemp(), tempfile.mkdtemp(), []
    lines = ["=== FAILURES ===", "___ t ___", *(f"E {i}" for i in range(12_000))]
    rocks.createDataFrame([("a", i, x) for i, x in enumerate(lines)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    query = SM.machine_stream(rocks.readStream.schema(SCHEMA).parquet(folder), M.MACHINES["pytest"], wait_ms=500).writeStream.option("checkpointLocation", state).foreachBatch(lambda df, k: seen.extend(map(tuple, df.collect()))).trigger(processingTime="1 second").start()
    until = time.time() + 60
    while time.time() < until and not any(r[2] == "cut" for r in seen):
        time.sleep(1)
    query.stop()
    assert ("a", 0, "cut", "\n".join(lines[1:])) in seen
