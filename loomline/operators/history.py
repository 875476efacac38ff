"""Session history: logs, audit trails, tool-call joins, adoption, classification and command corrections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import builtin
from ..functions import text as X


def log_summary(lines: DataFrame) -> DataFrame:
    """level, normal, n, example (the first line) of lines (line_no, line)."""
    rows = lines.select("line_no", "line", X.log_level(F.col("line")).alias("level"), X.normalise_log(F.col("line")).alias("normal")).where("level is not null")
    return rows.groupBy("level", "normal").agg(F.count(F.lit(1)).alias("n"), F.min_by("line", "line_no").alias("example"))


def audit(lines: DataFrame) -> DataFrame:
    """timestamp, action, original, rewritten of lines 'ts | action | original | rewritten'; shorter lines drop."""
    parts = F.split("line", r" \| ", 4)
    rows = lines.where(F.size(parts) >= 3).select(parts.alias("p"))
    get = lambda i: F.get("p", i - 1)
    return rows.select(get(1).alias("timestamp"), get(2).alias("action"), get(3).alias("original_cmd"), F.coalesce(get(4), F.lit("-")).alias("rewritten_cmd"))


def audit_actions(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def with_results(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Tool uses (session, id, command) with the last of their results (session, id, seq, output, is_error)."""
    last = results.groupBy("session", "id").agg(F.max_by(F.struct("output", "is_error"), "seq").alias("r"))
    return uses.join(last, ["session", "id"], "left").select(*uses.columns, "r.output", "r.is_error")


RULES, IGNORED, IGNORED_PREFIXES = builtin.RULES, builtin.IGNORED, builtin.IGNORED_PREFIXES

#: Fixed patterns: what may stand before a command, and git's options before its sub-command.
_VALUE = r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\S*)"""
ENVIRONMENT = rf"^(?:sudo\s+|env\s+|[A-Z_][A-Z0-9_]*={_VALUE}\s+)+"
GIT_OPTIONS = (
    r"^git (?:(?:-C\s+\S+|-c\s+\S+|--git-dir(?:=\S+|\s+\S+)|--work-tree(?:=\S+|\s+\S+)"
    r"|--no-pager|--no-optional-locks|--bare|--literal-pathspecs)\s+)+"
)


def _trimmed(command: Column) -> Column:
    return F.regexp_replace(command, r"^\s+|\s+$", "")


def ignored(command: Column) -> Column:
    """Whether a command has nothing to reduce: empty, or on the lists of whole commands and beginnings."""
    bare = _trimmed(command)
    out = bare.isin("", *IGNORED)
    for prefix in IGNORED_PREFIXES:
        out |= bare.startswith(prefix)
    return out


def bare_command(command: Column) -> Column:
    """A command without variables before it, the folder of its program, and git's global options."""
    bare = _trimmed(F.regexp_replace(_trimmed(command), ENVIRONMENT, ""))
    bare = F.regexp_replace(bare, r"^[^ ]*/([^ /]+)", "$1")
    return F.regexp_replace(bare, GIT_OPTIONS, "git ")


def classified(command: Column, rules: list[builtin.CommandRule] = RULES) -> Column:
    """Struct of target, category, pct and status: the last matching rule; null where none does, the command is
    ignored, or it writes a file by cat, head or tail.

    A rule is tried only on commands that begin with one of its letters. The rules are unrolled into one expression,
    so their patterns are compiled once a task and nothing is joined.
    """
    by_letter: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        for letter in rule.letters():
            by_letter.setdefault(letter, []).append(i)

    def number(b: Column) -> Column:
        first, out = F.substring(b, 1, 1), F.lit(None).cast("int")
        for letter, own in sorted(by_letter.items()):
            last = F.lit(None).cast("int")
            for i in own:
                last = F.when(b.rlike(rules[i].pattern), F.lit(i)).otherwise(last)
            out = F.when(first == letter, last).otherwise(out)
        return out

    def described(b: Column, i: Column) -> Column:
        pick = lambda values: F.element_at(F.array(*map(F.lit, values)), i + 1)
        pct, status = pick([float(r.savings_pct) for r in rules]), F.lit("supported")
        for k, rule in enumerate(rules):
            if re.compile(rule.pattern).groups and (rule.by_subcommand or rule.passed_through):
                sub = F.regexp_extract(b, rule.pattern, 1)
                for name, own in rule.by_subcommand.items():
                    pct = F.when((i == k) & (sub == name), own).otherwise(pct)
                for name in rule.passed_through:
                    status = F.when((i == k) & (sub == name), "passthrough").otherwise(status)
        target = F.concat(F.lit(f"{builtin.PROGRAM} "), pick([r.target for r in rules]))
        return F.when(i.isNotNull(), F.struct(target.alias("target"), pick([r.category for r in rules]).alias("category"), pct.alias("pct"), status.alias("status")))

    def found(b: Column) -> Column:
        writes = b.rlike(r"^(?:cat|head|tail) ") & b.rlike(r"\s(?:>|<(?:\s|$))")
        return F.get(F.transform(F.array(F.when(~writes, number(b))), lambda i: described(b, i)), 0)

    # lambdas over one-element arrays name the command once, and keep the long CASE out of generated code
    return F.when(~ignored(command), F.get(F.transform(F.array(bare_command(command)), found), 0))


def discover(commands: DataFrame) -> DataFrame:
    """Missed savings by target: commands (command, output_bytes) that a rule would have reduced."""
    rows = commands.withColumn("c", classified(F.col("command"))).where("c is not null")
    saved = F.floor(F.expr("output_bytes div 4") * F.col("c.pct") / 100).cast("long")
    shown = rows.select(F.col("c.target").alias("target"), X.first_words(F.col("command"), 2).alias("shown"), saved.alias("saved"))
    each = shown.groupBy("target", "shown").agg(F.count(F.lit(1)).alias("n"), F.sum("saved").alias("saved"))
    best = F.min_by("shown", F.struct((-F.col("n")).alias("k"), F.col("shown").alias("s")))
    return each.groupBy("target").agg(F.sum("n").alias("n"), F.sum("saved").alias("saved"), best.alias("most_common"))


def adoption(commands: DataFrame, covered: Column) -> DataFrame:
    """Commands and covered commands of each session (session, command)."""
    return commands.groupBy("session").agg(F.count(F.lit(1)).alias("commands"), F.count_if(covered).alias("covered")).withColumn("pct", 100.0 * F.col("covered") / F.col("commands"))


#: Fixed patterns of error messages.
UNKNOWN_FLAG = r"(?i)(unexpected argument|unknown (option|flag)|unrecognized (option|flag)|invalid (option|flag))"
NOT_FOUND = r"(?i)(command not found|not recognized as an internal|no such file or directory.*command)"
WRONG_PATH = r"(?i)(no such file or directory|cannot find the path|file not found)"
MISSING = r"(?i)(requires a value|requires an argument|missing (required )?argument|expected.*argument)"
DENIED = r"(?i)(permission denied|access denied|not permitted)"
REJECTED = r"(?i)(user (doesn't want|declined|rejected|cancelled)|operation (cancelled|aborted) by user)"


#: Words of an error.
ERROR_WORDS = ("error", "failed", "unknown", "invalid", "not found", "permission denied", "cannot")


def failed(flag: Column, output: Column) -> Column:
    """Whether a command failed: flagged, with words of an error, and not turned down by the user."""
    return flag & ~output.rlike(REJECTED) & F.lower(output).rlike("|".join(ERROR_WORDS))


def error_kind(output: Column) -> Column:
    kinds = ((UNKNOWN_FLAG, "Unknown Flag"), (NOT_FOUND, "Command Not Found"), (MISSING, "Missing Argument"), (DENIED, "Permission Denied"), (WRONG_PATH, "Wrong Path"))
    out = F.lit("General Error")
    for pattern, name in reversed(kinds):
        out = F.when(output.rlike(pattern), name).otherwise(out)
    return out


#: A line's operators, and what lies between them: quoted text, escapes and redirects hold no operator.
_OPERATORS = r"&&|\|\||[;|&]"
_PIECES = rf"""(?:\d*>&\d*|&>>?|"(?:\\.|[^"\\])*"|'[^']*'|\\.|[^;|&"'\\]|["'\\])+|{_OPERATORS}"""
_REDIRECTS = r"(?s)((?:\s+(?:\d*>&\d*|(?:&|\d*)>>?\s*[^\s>]+|<\s*[^\s<]+))+)\s*$"
#: Forms of head and tail with a number of lines and a file, and what reads them.
_RANGES = [(r"^head\s+-(\d+)\s+(.+)$", "max"), (r"^head\s+--lines=(\d+)\s+(.+)$", "max"), (r"^tail\s+-(\d+)\s+(.+)$", "tail"), (r"^tail\s+-n\s+(\d+)\s+(.+)$", "tail"), (r"^tail\s+--lines[= ]\s*(\d+)\s+(.+)$", "tail")]
DISABLED = f"{builtin.PROGRAM.upper()}_DISABLED="


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def _rewritten_part(part: Column, excluded: tuple[str, ...], rules: list[builtin.CommandRule]) -> Column:
    """One command under our program: its rule's prefix is replaced, what stands before it and redirects stay; null where
    no rule fits, or where the reduced output would be another than what was asked for."""
    own, none = builtin.PROGRAM, F.lit(None).cast("string")
    pairs: dict[str, str] = {}
    for rule in rules:
        names = "|".join(re.escape(p) for p in rule.prefixes)
        pairs.setdefault(f"{own} {rule.target}", rf"(?s)^(?:{names})(?:$| +(.*)$)" if names else "(?!)")
    patterns = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])

    def by_rule(plain: Column, redirects: Column, before: Column, target: Column) -> Column:
        bare, pattern = F.trim(F.substr(plain, F.length(before) + 1)), F.element_at(patterns, target)
        rest = F.call_function("regexp_extract", bare, pattern, F.lit(1))
        json = (target == f"{own} gh") & bare.rlike("(?i)--json|--jq|--template")
        put = lambda r: F.concat(before, target, F.when(r == "", "").otherwise(F.concat(F.lit(" "), r)), redirects)
        return F.when(F.rlike(bare, pattern) & ~json, _bound(rest, put))

    def ruled(plain: Column, redirects: Column) -> Column:
        before = F.regexp_extract(plain, ENVIRONMENT, 0)
        known = F.when(~F.regexp_extract(plain, r"^(\S*)", 1).isin(*excluded, ""), classified(plain, rules)["target"])
        return _bound(before, lambda b: F.when(~b.contains(DISABLED), _bound(known, lambda t: F.when(t.isNotNull(), by_rule(plain, redirects, b, t)))))

    def ranged(plain: Column, redirects: Column) -> Column:
        out = none
        for pattern, kind in reversed(_RANGES):
            put = F.concat(F.lit(f"{own} read "), F.regexp_extract(plain, pattern, 2), F.lit(f" --{kind}-lines "), F.regexp_extract(plain, pattern, 1), redirects)
            out = F.when(plain.rlike(pattern), put).otherwise(out)
        return out

    def chosen(plain: Column, redirects: Column) -> Column:
        flags = plain.rlike(r"^cat\s+-") & ~plain.rlike(r"^cat\s+-n\s")
        return F.when((plain == own) | plain.startswith(f"{own} "), part).when(plain.startswith("head -") | plain.startswith("tail "), ranged(plain, redirects)).when(~flags, ruled(plain, redirects))

    whole = F.regexp_extract(part, _REDIRECTS, 0)
    cut = lambda w: F.rtrim(F.substr(part, F.lit(1), F.length(part) - F.length(w)))
    return _bound(whole, lambda w: _bound(cut(w), lambda plain: chosen(plain, F.rtrim(w))))


def rewritten(line: Column, excluded: tuple[str, ...] = (), rules: list[builtin.CommandRule] = RULES) -> Column:
    """A line with each command that a rule knows under our program; null where none changes. Commands are taken apart at
    && || ; and &; of a pipe only the first is rewritten, and not if it is find or fd, whose lines the next one reads.
    Heredocs and arithmetic stay as they are. No Python: pieces are one pattern's matches."""
    bare = _trimmed(line)
    of = lambda pieces: lambda p, i: _piece(pieces, p, i)

    def _piece(pieces: Column, p: Column, i: Column) -> Column:
        seg = _trimmed(p)
        kept = (F.get(pieces, i + 1) == "|") & seg.rlike(r"^(find|fd)( |\z)")
        operator = F.when(p == ";", F.when(i < F.size(pieces) - 1, "; ").otherwise(";")).when(p.rlike(rf"^(?:{_OPERATORS})$"), F.concat(F.lit(" "), p, F.lit(" ")))
        new = lambda s: F.when(kept | (s == ""), s).otherwise(F.coalesce(_rewritten_part(s, excluded, rules), s))
        one = lambda n: F.struct(n.alias("text"), (n != seg).alias("changed"))
        return F.when(operator.isNotNull(), F.struct(operator.alias("text"), F.lit(False).alias("changed"))).otherwise(_bound(_bound(seg, new), one))

    def built(pieces: Column) -> Column:
        pipe = F.array_position(pieces, "|").cast("int")
        head = F.when(pipe > 0, F.slice(pieces, 1, F.greatest(pipe, F.lit(1)))).otherwise(pieces)
        tail = F.when(pipe > 0, F.array_join(F.slice(pieces, pipe + 1, F.size(pieces)), "")).otherwise("")

        def put(done: Column) -> Column:
            text = F.array_join(F.transform(done, lambda d: d["text"]), "")
            return F.when(F.exists(done, lambda d: d["changed"]), F.when(pipe > 0, F.concat(F.rtrim(text), tail)).otherwise(text))

        return _bound(head, lambda h: _bound(F.transform(h, of(h)), put))

    made = _bound(F.regexp_extract_all(bare, F.lit(_PIECES), F.lit(0)), built)
    own = ~bare.rlike(r"&&|[|;]| & ") & ((bare == builtin.PROGRAM) | bare.startswith(f"{builtin.PROGRAM} "))
    return F.when((bare == "") | bare.contains("<<") | bare.contains("$(("), F.lit(None).cast("string")).when(own, bare).otherwise(made)


def base_command(command: Column) -> Column:
    return X.first_words(F.regexp_replace(F.trim(command), r"^(RUST_BACKTRACE=1|NODE_ENV=production|DEBUG=\*) ", ""), 2)


def arguments(command: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(command, r"^\s*\S+(\s+\S+)?", ""), r"\s+"), lambda a: a != ""))


def similarity(a: Column, b: Column) -> Column:
    """0 for other base commands; else half, and half the Jaccard similarity of the arguments."""
    x, y = arguments(a), arguments(b)
    either = F.size(F.array_union(x, y))
    return F.when(base_command(a) != base_command(b), 0.0).when(either == 0, 1.0).otherwise(0.5 + 0.5 * F.size(F.array_intersect(x, y)) / either)


def _unpiped(command: Column) -> Column:
    """A command without the pipes and redirects at its end."""
    return F.trim(F.regexp_replace(command, r"\s(?:\|\s|2>&1|>&2|>>?\s).*$", ""))


def corrections(runs: DataFrame, ahead: int = 3, least: float = 0.6) -> DataFrame:
    """Failed commands and the first of the next `ahead` commands of the session that corrects each.

    A correction is like the failed command but not equal, and not nearly equal (a mere change of path); confidence
    is the similarity, and 0.2 more where the later command succeeded. One window of lead() values, no self-join.
    """
    order = Window.partitionBy("session").orderBy("seq")
    one = F.struct("command", "is_error", "output")
    rows = runs.withColumn("next", F.array(*[F.lead(one, k).over(order) for k in range(1, ahead + 1)]))
    rows = rows.where(failed(F.col("is_error"), F.col("output")) & (F.length("command") <= 200) & ~F.col("command").contains("\n"))

    def rated(c: Column) -> Column:
        like = similarity(F.col("command"), c["command"])
        sure = F.when(failed(c["is_error"], c["output"]), like).otherwise(F.least(like + 0.2, F.lit(1.0)))
        piped = _unpiped(F.col("command")) == _unpiped(c["command"])
        ok = c.isNotNull() & ~piped & (like >= 0.5) & ~((like > 0.9) & (like < 1.0)) & (F.col("command") != c["command"]) & (sure >= least) & (F.length(c["command"]) <= 200)
        return F.struct(ok.alias("ok"), c["command"].alias("command"), sure.alias("confidence"))

    first = F.get(F.filter(F.transform("next", rated), lambda c: c["ok"]), 0)
    rows = rows.withColumn("right", first).where("right is not null")
    return rows.select("session", "seq", F.col("command").alias("wrong"), F.col("right.command").alias("right"), F.col("right.confidence").alias("confidence"), error_kind(F.col("output")).alias("kind"))


def difference(wrong: Column, right: Column) -> Column:
    """What changed between two commands; of several words the least."""
    split = lambda c: F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    gone, new = F.array_min(F.array_except(split(wrong), split(right))), F.array_min(F.array_except(split(right), split(wrong)))
    return F.when(gone.isNotNull() & new.isNotNull(), F.concat(gone, F.lit(" → "), new)).when(gone.isNotNull(), F.concat(F.lit("removed "), gone)).when(new.isNotNull(), F.concat(F.lit("added "), new)).otherwise("unknown")


def correction_rules(pairs: DataFrame) -> DataFrame:
    """Corrections by base command, kind of error and difference, with the surest example."""
    rows = pairs.select(base_command(F.col("wrong")).alias("base"), "kind", difference(F.col("wrong"), F.col("right")).alias("diff"), "wrong", "right", "confidence")
    best = F.min_by(F.struct("wrong", "right"), F.struct((-F.col("confidence")).alias("k"), "wrong", "right"))
    return rows.groupBy("base", "kind", "diff").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"), best.alias("best")).select("base", "kind", "diff", "n", "confidence", "best.*")


#: Verdicts from the weakest to the strictest.
VERDICTS = ("default", "allow", "ask", "deny")


def permission_pattern(pattern: str) -> str:
    """A regular expression for the commands that a permission rule's pattern names.

    * alone names all; "git push", "git push*", "git push *" and "git push:*" name that command and what goes on after a
    space; any other * stands for any characters, ":*" and "*:" being a space and a *.
    """
    plain = lambda text: "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else rf"\{c}" if c > " " else rf"\x{ord(c):02x}" for c in text)
    stem = pattern.removesuffix("*").rstrip(":").rstrip() if pattern.endswith("*") else pattern
    if "*" not in stem and (stem or not pattern):
        return f"{plain(stem)}(?: .*)?"
    if stem in ("", "*"):
        return ".*"
    return ".*".join(map(plain, pattern.replace(":*", " *").replace("*:", "* ").split("*")))


def bash_patterns(settings: Column, verdict: str) -> Column:
    """The patterns of the Bash(...) rules of one verdict in a settings file's JSON; none where it isn't valid."""
    rules = F.from_json(F.get_json_object(settings, f"$.permissions.{verdict}"), "array<string>")
    bash = F.filter(F.coalesce(rules, F.array().cast("array<string>")), lambda r: r.startswith("Bash("))
    return F.transform(bash, lambda r: F.when(r.endswith(")"), F.substring(r, F.lit(6), F.length(r) - 6)).otherwise(r))


def permission(command: Column, rules: list[tuple[str, str]]) -> Column:
    """The strictest verdict of (pattern, verdict) rules over the parts of a compound command, which is split at &&, ||,
    | and ;. The patterns of a verdict are one regular expression, so that a part is tried three times at most."""
    parts = F.filter(F.transform(F.split(command, r"&&|\|\||[|;]"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    out = F.lit(VERDICTS[0])
    for name in VERDICTS[1:]:
        if patterns := [permission_pattern(p) for p, v in rules if v == name]:
            whole = f"(?s)^(?:{'|'.join(patterns)})$".replace("$", r"\z")
            out = F.when(F.exists(parts, lambda s: s.rlike(whole)), F.lit(name)).otherwise(out)
    return out


def positional_diff(old: DataFrame, new: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, line_no, line) of two texts compared place by place: added, removed, or modified where the characters are
    alike."""
    keys = [*by, "line_no"]
    both = old.select(*keys, F.col("line").alias("old")).join(new.select(*keys, F.col("line").alias("new")), keys, "full_outer")
    alike = X.char_jaccard(F.col("old"), F.col("new")) > 0.5
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same")
    return both.withColumn("kind", kind.when(alike, "modified").otherwise("replaced"))
