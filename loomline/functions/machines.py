"""State machines over lines as tables: a tool's output is described by rows, which one fold runs in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a step can do with its line: nothing; make it an item; close the open block, which makes it an item, and begin one;
#: add it to the block; close the block; close it and keep the line as the note that ends a run.
ACTIONS = ("skip", "keep", "open", "add", "close", "end")


@dataclass(frozen=True)
class Step:
    """A row: in a mode (none: any), lines (trimmed) that hold a pattern lead to another mode (none: the same)."""

    mode: str
    pattern: str
    to: str
    do: str

    def __post_init__(self):
        if self.do not in ACTIONS:
            raise ValueError(f"{self.do} is none of {', '.join(ACTIONS)}")


#: Our own tables. The first step that fits a line is taken; a line that none fits changes nothing.
MACHINES: dict[str, list[Step]] = {
    "pytest": [
        Step("", r"^===.*test session starts", "header", "skip"), Step("", r"^===.*FAILURES", "failures", "skip"), Step("", r"^===.*short test summary", "summary", "close"), Step("", r"^===.*(passed|failed)", "done", "end"),
        Step("header", r"^collected", "progress", "skip"), Step("failures", r"^___", "", "open"), Step("failures", r"^(?!===).+", "", "add"), Step("summary", r"^(FAILED|ERROR)", "", "keep"),
    ],
    "cargo test": [
        Step("", r"^failures:$", "failures", "close"), Step("", r"^test result:", "done", "end"), Step("", r"^running \d+ tests?$", "running", "skip"), Step("failures", r"^---- .* stdout ----$", "", "open"),
        Step("failures", r"^(?!note: run with).+", "", "add"), Step("running", r"^test .* \.\.\. FAILED$", "", "keep"),
    ],
    "cargo build": [
        Step("", r"^(error|warning): .*(could not compile|generated \d+ warning|aborting due)", "done", "end"), Step("", r"^error(\[E\d+\])?:", "error", "open"), Step("", r"^warning:", "warning", "close"), Step("", r"^Finished ", "done", "end"), Step("error", r".", "", "add"),
    ],
    "rspec": [
        Step("", r"^Failures:$", "failures", "skip"), Step("", r"^\d+ examples?, ", "done", "end"), Step("", r"^Failed examples:$", "examples", "close"), Step("failures", r"^\d+\) ", "", "open"), Step("failures", r"^Finished in ", "finished", "close"),
        Step("failures", r"^(?!# ).+", "", "add"), Step("examples", r"^rspec ", "", "keep"),
    ],
    "go test": [Step("", r"^(FAIL|ok)\s+\S+\s+[\d.]+s|^(FAIL|PASS)$", "done", "end"), Step("", r"^--- FAIL: ", "failed", "open"), Step("", r"^(--- (PASS|SKIP)|=== )", "", "close"), Step("failed", r".", "", "add")],
    "jest": [Step("", r"^Tests: ", "done", "end"), Step("", r"^(FAIL|PASS) ", "file", "close"), Step("file", r"^● ", "failed", "open"), Step("failed", r"^● ", "", "open"), Step("failed", r"^(at .*node_modules|Test Suites:)", "", "skip"), Step("failed", r".", "", "add")],
    "git diff": [Step("", r"^diff --git ", "file", "open"), Step("file", r"^(index|---|\+\+\+|similarity|old mode|new mode)", "", "skip"), Step("file", r"^@@", "hunk", "add"), Step("hunk", r"^@@", "", "add"), Step("hunk", r"^[-+]", "", "add")],
    "tsc": [Step("", r"^Found \d+ errors?", "done", "end"), Step("", r"^\S+\(\d+,\d+\): error TS\d+", "error", "open"), Step("error", r"^(?!.*: error TS).+", "", "add")],
    "mypy": [Step("", r"^(Found \d+ errors?|Success:)", "done", "end"), Step("", r": error: ", "error", "open"), Step("error", r": note: ", "", "add")],
    "terraform plan": [Step("", r"^Plan: |^No changes", "done", "end"), Step("", r"^# \S+ (will|must) be", "resource", "open"), Step("resource", r"^[-+~] ", "", "add"), Step("resource", r"^\}$", "after", "close")],
    "make": [Step("", r"^make(\[\d+\])?: \*\*\*", "done", "end"), Step("", r"(^|: )(fatal )?error: ", "error", "open"), Step("", r": warning: ", "warning", "close"), Step("error", r"^\d+ \||^\^|^\|", "", "add")],
    "eslint": [Step("", r"^✖ \d+ problems?", "done", "end"), Step("", r"^\S+\.(js|jsx|ts|tsx|mjs|cjs|vue)$", "file", "open"), Step("file", r"^\d+:\d+\s+(error|warning)", "", "add")],
    "ruff": [Step("", r"^(Found \d+ errors?|All checks passed)", "done", "end"), Step("", r"^\S+:\d+:\d+: [A-Z]+\d+ ", "", "keep")],
    "pylint": [Step("", r"^Your code has been rated", "done", "end"), Step("", r"^\S+:\d+:\d+: [CEFRW]\d{4}: ", "", "keep")],
    "rubocop": [Step("", r"^\d+ files? inspected", "done", "end"), Step("", r"^\S+:\d+:\d+: [CEFW]: ", "", "keep")],
    "golangci-lint": [Step("", r"^\d+ issues?[.:]", "done", "end"), Step("", r"^\S+:\d+:\d+: .*\(\w+\)$", "issue", "open"), Step("issue", r"^\^", "start", "close"), Step("issue", r".", "", "add")],
    "cargo clippy": [Step("", r"^(error|warning): .*(could not compile|generated \d+ warning|aborting due)", "done", "end"), Step("", r"^(error|warning)(\[.*\])?: ", "lint", "open"), Step("lint", r"^-->", "", "add"), Step("", r"^Finished ", "done", "end")],
    "docker build": [Step("", r"^(Successfully built|ERROR: failed to)", "done", "end"), Step("", r"^(#\d+ )?ERROR", "error", "open"), Step("", r"^(Step \d+/\d+|#\d+ \[)", "step", "close"), Step("error", r"^-+$", "", "skip"), Step("error", r".", "", "add")],
    "pip install": [Step("", r"^Successfully installed", "done", "end"), Step("", r"^(ERROR|WARNING):", "", "keep")],
    "gradle": [Step("", r"^BUILD (SUCCESSFUL|FAILED)", "done", "end"), Step("", r"^> Task .* FAILED$", "", "keep"), Step("", r"^\* What went wrong:", "wrong", "open"), Step("wrong", r"^\* Try:", "try", "close"), Step("wrong", r".", "", "add")],
    "maven": [Step("", r"^\[INFO\] BUILD (SUCCESS|FAILURE)", "done", "end"), Step("", r"^\[ERROR\] (\S+\.java:|Tests run:|Failures:)", "", "keep")],
    "dotnet build": [Step("", r"^Build (succeeded|FAILED)", "done", "end"), Step("start", r": (error|warning) [A-Z]+\d+:", "", "keep")],
    "dotnet test": [Step("", r"^(Passed|Failed)!", "done", "end"), Step("", r"^Failed \S+ \[", "failed", "open"), Step("failed", r"^Stack Trace:", "start", "close"), Step("failed", r"^(?!Error Message:).+", "", "add")],
    "phpunit": [Step("", r"^(Tests: \d|OK \()", "done", "end"), Step("", r"^(FAILURES|ERRORS)!", "after", "close"), Step("", r"^\d+\) ", "failed", "open"), Step("failed", r".", "", "add")],
    "mocha": [Step("", r"^\d+ failing", "failures", "end"), Step("failures", r"^\d+\) ", "", "open"), Step("failures", r"^at ", "", "skip"), Step("failures", r".", "", "add")],
    "vitest": [Step("", r"^Tests\s+\d", "done", "end"), Step("", r"^FAIL ", "failed", "open"), Step("failed", r"^(❯|⎯)", "", "skip"), Step("failed", r".", "", "add")],
    "playwright": [Step("", r"^\d+ (failed|passed)\b", "done", "end"), Step("", r"^\d+\) \[", "failed", "open"), Step("failed", r"^(at |\d+ \|)", "", "skip"), Step("failed", r".", "", "add")],
    "mix test": [Step("", r"^\d+ tests?, \d+ failures?", "done", "end"), Step("", r"^\d+\) test ", "failed", "open"), Step("failed", r"^Finished in", "after", "close"), Step("failed", r".", "", "add")],
    "shellcheck": [Step("", r"^For more information", "done", "end"), Step("", r"^In \S+ line \d+:", "issue", "open"), Step("issue", r".", "", "add")],
    "hadolint": [Step("", r"^\S+:\d+ (DL|SC)\d+ ", "", "keep")],
    "ninja": [Step("", r"^ninja: build stopped", "done", "end"), Step("", r"^FAILED: ", "failed", "open"), Step("", r"^\[\d+/\d+\]", "step", "close"), Step("failed", r".", "", "add")],
    "cmake": [Step("", r"^-- (Configuring incomplete|Generating done|Build files)", "done", "end"), Step("", r"^CMake (Error|Warning)", "issue", "open"), Step("", r"^-- ", "step", "close"), Step("issue", r".", "", "add")],
    "ansible-playbook": [Step("", r"^PLAY RECAP", "recap", "skip"), Step("", r"^(fatal|failed): ", "", "keep"), Step("recap", r"^\S+\s+: ok=\d+", "", "keep")],
    "git push": [Step("", r"^(To |! \[rejected\]|error: |\*|[+ ]?\w+\.\.+\w+ )", "", "keep")],
    "xcodebuild": [Step("", r"^\*\* (BUILD|TEST) (SUCCEEDED|FAILED) \*\*", "done", "end"), Step("", r": (fatal )?error: ", "", "keep")],
    "swift test": [Step("", r"^Executed \d+ tests?", "done", "end"), Step("", r": error: ", "", "keep")],
    "prettier": [Step("", r"^(\[warn\] Code style|All matched files)", "done", "end"), Step("", r"^\[(warn|error)\] \S+", "", "keep")],
    "black": [Step("", r"^(\d+ files? (would be )?(reformatted|left)|All done)", "done", "end"), Step("", r"^(would reformat|error: cannot format) ", "", "keep")],
    "webpack": [Step("", r"^webpack .* compiled", "done", "end"), Step("", r"^ERROR in ", "error", "open"), Step("", r"^(asset|modules) ", "start", "close"), Step("error", r".", "", "add")],
    "npm": [Step("", r"^(added|removed|changed|up to date)\b", "done", "end"), Step("", r"^npm (ERR!|error) code", "error", "open"), Step("error", r"^npm (ERR!|error) ", "", "add"), Step("", r"^\d+ vulnerabilit", "", "keep")],
}
_NONE = "array<string>"


def run(lines: Column, steps: list[Step], first: str = "start") -> Column:
    """struct(items, note) of an array of lines: one fold, in which each line meets the steps in their order."""
    one = lambda x: F.array(x)
    empty = F.array().cast(_NONE)

    def after(state: Column, raw: Column) -> Column:
        line = F.regexp_replace(raw, r"^\s+|\s+$", "")
        closed = F.when(F.size(state["block"]) > 0, F.concat(state["items"], one(F.array_join(state["block"], "\n")))).otherwise(state["items"])
        made = {
            "skip": (state["items"], state["block"], state["note"]), "keep": (F.concat(state["items"], one(line)), state["block"], state["note"]), "open": (closed, one(line), state["note"]),
            "add": (state["items"], F.concat(state["block"], one(line)), state["note"]), "close": (closed, empty, state["note"]), "end": (closed, empty, line),
        }
        out = state
        for step in reversed(steps):
            items, block, note = made[step.do]
            next_ = F.struct((F.lit(step.to) if step.to else state["mode"]).alias("mode"), items.alias("items"), block.alias("block"), note.alias("note"))
            fits = line.rlike(step.pattern)
            out = F.when((state["mode"] == step.mode) & fits if step.mode else fits, next_).otherwise(out)
        return out

    start = F.struct(F.lit(first).alias("mode"), empty.alias("items"), empty.alias("block"), F.lit(None).cast("string").alias("note"))
    last = lambda s: F.struct(F.when(F.size(s["block"]) > 0, F.concat(s["items"], one(F.array_join(s["block"], "\n")))).otherwise(s["items"]).alias("items"), s["note"].alias("note"))
    return F.aggregate(lines, start, after, last)


def counted(note: Column, word: str) -> Column:
    """The number before a word of a closing line, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(note, rf"(\d+) {word}", 1), F.lit("")).cast("int"), F.lit(0))


#: Commands whose output each machine reads, by our own patterns; of several the first counts.
COMMANDS = {
    "pytest": r"^(python3? -m )?pytest\b", "cargo test": r"^cargo (test|nextest)\b", "cargo clippy": r"^cargo clippy\b", "cargo build": r"^cargo (build|check|run)\b", "rspec": r"^(bundle exec )?rspec\b", "go test": r"^go test\b", "jest": r"^(npx )?jest\b",
    "git diff": r"^git (diff|show)\b", "git push": r"^git push\b", "tsc": r"^(npx )?tsc\b", "mypy": r"^(python3? -m )?mypy\b", "terraform plan": r"^(terraform|tofu) plan\b", "make": r"^make\b", "npm": r"^(npm|pnpm) (i|install|ci)\b", "eslint": r"^(npx )?eslint\b",
    "ruff": r"^ruff\b", "pylint": r"^pylint\b", "rubocop": r"^(bundle exec )?rubocop\b", "golangci-lint": r"^golangci-lint\b", "docker build": r"^docker (buildx )?build\b", "pip install": r"^pip3? install\b", "gradle": r"^(\./gradlew|gradle)\b", "maven": r"^(\./mvnw|mvn)\b",
    "dotnet build": r"^dotnet build\b", "dotnet test": r"^dotnet test\b", "phpunit": r"^(vendor/bin/)?phpunit\b", "mocha": r"^(npx )?mocha\b", "vitest": r"^(npx )?vitest\b", "playwright": r"^(npx )?playwright\b", "mix test": r"^mix test\b", "shellcheck": r"^shellcheck\b",
    "hadolint": r"^hadolint\b", "ninja": r"^ninja\b", "cmake": r"^cmake\b", "ansible-playbook": r"^ansible-playbook\b", "xcodebuild": r"^xcodebuild\b", "swift test": r"^swift test\b", "prettier": r"^(npx )?prettier\b", "black": r"^black\b", "webpack": r"^(npx )?webpack\b",
}


def machine_of(command: Column) -> Column:
    """The name of the machine that reads a command's output, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(COMMANDS.items()):
        out = F.when(command.rlike(pattern), name).otherwise(out)
    return out


def reduced(command: Column, text: Column, most: int = 50) -> Column:
    """A command's output by its machine: the note that ended the run, then the first items, and how many more there are;
    the text as it is where no machine knows the command or finds nothing."""
    lines = F.split(text, r"\r?\n")

    def by(name: Column) -> Column:
        found = F.lit(None).cast("struct<items:array<string>,note:string>")
        for machine, steps in MACHINES.items():
            found = F.when(name == machine, run(lines, steps)).otherwise(found)
        return found

    found = F.get(F.transform(F.array(machine_of(command)), by), 0)  # the name is found once

    def written(f: Column) -> Column:
        n = F.size(f["items"])
        more = F.when(n > most, F.array(F.concat(F.lit("... "), (n - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast(_NONE))
        note = F.when(f["note"].isNotNull(), F.array(f["note"])).otherwise(F.array().cast(_NONE))
        return F.when((n > 0) | f["note"].isNotNull(), F.array_join(F.concat(note, F.slice(f["items"], 1, most), more), "\n"))

    return F.coalesce(F.get(F.transform(F.array(found), written), 0), text)
