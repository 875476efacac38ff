"""Sub-projects of repositories, found from marker files and workspace manifests, and the symbols they own.

Tables: sources (repo, path), the files that are indexed; manifests (repo, path, text). Directories are met by equality
of prefixes, so that no pair of directories is compared that doesn't lie one under the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import cut

#: Files that make a directory a project, and the depth to which they do.
MARKERS = ("package.json", "go.mod", "pyproject.toml", "setup.py", "Cargo.toml")
MOST_DEPTH, LEAST_SYMBOLS = 2, 5

_STRINGS = "array<string>"
_STATE = "struct<open:boolean,done:boolean,found:array<string>>"


def _folded(text: Column, step) -> Column:
    """The strings that a walk over a text's lines finds: step(state, line, trimmed) gives the next state."""
    start = F.from_json(F.lit('{"open": false, "done": false, "found": []}'), _STATE)
    lines = F.split(text, r"\r?\n")
    return F.aggregate(lines, start, lambda s, line: step(s, line, F.trim(F.regexp_replace(line, r"\t", " "))))["found"]


def _state(s: Column, open_: Column | None = None, done: Column | None = None, add: Column | None = None) -> Column:
    found = s["found"] if add is None else F.concat(s["found"], F.array(add))
    return F.struct((s["open"] if open_ is None else open_).alias("open"), (s["done"] if done is None else done).alias("done"), found.alias("found"))


def pnpm_globs(text: Column) -> Column:
    """The list under `packages:`, up to the first line that is neither an entry nor indented."""
    yes = F.lit(True)

    def step(s: Column, line: Column, bare: Column) -> Column:
        entry = F.regexp_replace(F.trim(F.substr(bare, F.lit(3))), "^[\"']+|[\"']+$", "")
        ended = (bare != "") & ~line.rlike(r"^[ \t-]")
        return F.when(s["done"], s).when(bare.startswith("packages:"), _state(s, open_=yes)).when(~s["open"], s).when(bare.startswith("- "), _state(s, add=entry)).when(ended, _state(s, done=yes)).otherwise(s)

    return _folded(text, step)


def package_globs(text: Column) -> Column:
    """`workspaces` of a package.json: a list, or an object with a list of packages. Entries that are no text are left out."""
    json = F.try_parse_json(text)
    lists = F.coalesce(F.try_variant_get(json, "$.workspaces", "array<variant>"), F.try_variant_get(json, "$.workspaces.packages", "array<variant>"))
    texts = F.filter(lists, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(texts, lambda v: F.variant_get(v, "$", "string")), F.array().cast(_STRINGS))


def cargo_globs(text: Column) -> Column:
    """`members` of the [workspace] table of a Cargo.toml."""
    plain = F.regexp_replace(text, r"(?m)^((?:[^#\"'\n]|\"[^\"\n]*\"|'[^'\n]*')*)#[^\n]*$", "$1")
    table = F.regexp_extract(plain, r"(?ms)^[ \t]*\[workspace\][ \t]*\r?$(.*?)(?=^[ \t]*\[|\z)", 1)
    members = F.regexp_extract(table, r"(?ms)^[ \t]*members[ \t]*=[ \t]*\[(.*?)\]", 1)
    quoted = F.regexp_extract_all(members, F.lit("\"[^\"]*\"|'[^']*'"), F.lit(0))
    return F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2))


def go_globs(text: Column) -> Column:
    """The `use` lines of a go.work, alone or in a block."""

    def step(s: Column, line: Column, bare: Column) -> Column:
        clean = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"+|"+$', ""), r"^(\./)+", "")
        added = lambda c: F.when(clean(c).isin("", "."), s).otherwise(_state(s, add=clean(c)))
        inside = F.when(bare == ")", _state(s, open_=F.lit(False))).otherwise(added(bare))
        return F.when(bare.startswith("use ("), _state(s, open_=F.lit(True))).when(s["open"], inside).when(bare.startswith("use "), added(F.substr(bare, F.lit(5)))).otherwise(s)

    return _folded(text, step)


def workspace_globs(manifests: DataFrame) -> DataFrame:
    """repo, glob: the members that the manifests at the root of each repository name."""
    path, text = F.col("path"), F.col("text")
    found = F.when(path == "pnpm-workspace.yaml", pnpm_globs(text)).when(path == "package.json", package_globs(text)).when(path == "Cargo.toml", cargo_globs(text)).when(path == "go.work", go_globs(text))
    return manifests.where(text.isNotNull()).select("repo", F.explode(found).alias("glob")).distinct()


def normal_prefix(path: Column) -> Column:
    """A directory as it is compared: forward slashes, none at its ends, no ./ before it."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", ""), "^/+|/+$", "")


def _above(path: Column) -> Column:
    """All proper prefixes of a path at its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def _prefixes(path: Column) -> Column:
    return F.when(path.contains("/"), _above(path)).otherwise(F.array().cast(_STRINGS))


def directories(sources: DataFrame) -> DataFrame:
    """repo, dir: the directories that hold a source file, at any depth."""
    return sources.select("repo", F.explode(_prefixes(F.col("path"))).alias("dir")).distinct()


def members(dirs: DataFrame, globs: DataFrame) -> DataFrame:
    """repo, dir of the directories that a workspace names: dir/*, dir/**, * and **, or a path. Other forms name none."""
    glob = normal_prefix(F.col("glob"))
    form = F.when(glob.isin("*", "**"), glob).when(glob.endswith("/**"), "/**").when(glob.endswith("/*"), "/*").when(~glob.contains("*"), "=")
    base = F.when(form.isin("*", "**"), "").when(form == "/**", F.regexp_replace(glob, r"/\*\*$", "")).when(form == "/*", F.regexp_replace(glob, r"/\*$", "")).otherwise(glob)
    wanted = globs.select("repo", form.alias("form"), base.alias("base")).where("form is not null").distinct()
    d = F.col("dir")
    key = lambda form, base: F.struct(F.lit(form).alias("form"), base.alias("base"))
    deep = F.transform(_prefixes(d), lambda p: key("/**", p))
    once = F.array(key("=", d), key("**", F.lit("")), F.when(d.contains("/"), key("/*", X.directory_of(d))).otherwise(key("*", F.lit(""))))
    return dirs.select("repo", "dir", F.explode(F.concat(once, deep)).alias("k")).select("repo", "dir", "k.*").join(wanted, ["repo", "form", "base"], "left_semi").select("repo", "dir").distinct()


def discover(sources: DataFrame, manifests: DataFrame) -> DataFrame:
    """repo, prefix, markers of each repository's scopes: directories with a marker file down to a depth, and those that a
    workspace names at any. Of nested ones the outer stays, but a workspace's member isn't dropped for an outer
    directory that has only markers. The root (empty prefix) is a scope of every repository."""
    dirs = directories(sources)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    marked = manifests.where(F.col("path").contains("/") & name.isin(*MARKERS)).select("repo", X.directory_of(F.col("path")).alias("dir"), name.alias("marker"))
    order = F.array(*[F.lit(m) for m in MARKERS])
    markers = marked.groupBy("repo", "dir").agg(F.collect_set("marker").alias("m")).select("repo", "dir", F.filter(order, lambda m: F.array_contains("m", m)).alias("markers"))
    named = members(dirs, workspace_globs(manifests)).withColumn("named", F.lit(True))
    rows = dirs.join(markers, ["repo", "dir"], "left").join(named, ["repo", "dir"], "left").withColumn("named", F.coalesce("named", F.lit(False)))
    rows = rows.where(F.col("named") | F.col("markers").isNotNull() & (F.size(F.split("dir", "/")) <= MOST_DEPTH))
    outer = rows.select("repo", F.col("dir").alias("above"), F.col("named").alias("outer_named"))
    inside = rows.select("repo", "dir", "named", F.explode(_prefixes(F.col("dir"))).alias("above")).join(outer, ["repo", "above"]).where(~F.col("named") | F.col("outer_named")).select("repo", "dir")
    kept = rows.join(inside, ["repo", "dir"], "left_anti").select("repo", F.col("dir").alias("prefix"), F.coalesce("markers", F.array().cast(_STRINGS)).alias("markers"))
    roots = sources.select("repo").distinct().select("repo", F.lit("").alias("prefix"), F.array().cast(_STRINGS).alias("markers"))
    return kept.unionByName(roots)


def owners(paths: DataFrame, scopes: DataFrame, path: str = "path") -> DataFrame:
    """The rows with `scope`, the longest prefix among their repository's scopes that the path lies under."""
    asked = paths.select("repo", F.col(path).alias("_path")).distinct()
    prefixes = asked.select("repo", "_path", F.explode(F.concat(F.array(F.lit("")), _prefixes(F.col("_path")), F.array("_path"))).alias("prefix"))
    best = prefixes.join(scopes.select("repo", "prefix"), ["repo", "prefix"]).groupBy("repo", "_path").agg(F.max_by("prefix", F.length("prefix")).alias("scope"))
    of = F.col("r.repo").eqNullSafe(F.col("b.repo")) & F.col(f"r.{path}").eqNullSafe(F.col("b._path"))
    return paths.alias("r").join(best.alias("b"), of, "left").select("r.*", F.coalesce("b.scope", F.lit("")).alias("scope"))


def by_path(nodes: DataFrame) -> DataFrame:
    """repo, path, n, symbols: how many rows (repo, path, kind) a path has, and how many of them aren't files. What is asked
    of paths several times is then asked of each once."""
    return nodes.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") != "file").alias("symbols")).transform(cut)


def substantial(scopes: DataFrame, nodes: DataFrame, least: int = LEAST_SYMBOLS) -> DataFrame:
    """The scopes that own at least so many symbols (repo, path, kind) that aren't files, and the roots."""
    return owning(scopes, nodes.where("kind <> 'file'").groupBy("repo", "path").agg(F.count(F.lit(1)).alias("symbols")), least)


def owning(scopes: DataFrame, counted: DataFrame, least: int = LEAST_SYMBOLS) -> DataFrame:
    """The same of paths that are counted already (repo, path, symbols)."""
    counted = owners(counted.where("symbols > 0"), scopes).groupBy("repo", F.col("scope").alias("prefix")).agg(F.sum("symbols").alias("n"))
    return scopes.join(counted, ["repo", "prefix"], "left").where((F.col("prefix") == "") | (F.col("n") >= least)).select("repo", "prefix", "markers")
