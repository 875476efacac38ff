"""Sources and sinks of files: session logs, source trees, spend reports, usage tables."""

from __future__ import annotations

import contextlib
import re
import sqlite3
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X
from ..operators.graph import fingerprint_changes

#: Directories that are never walked, and the largest file read. Fixed values.
SKIPPED = ("node_modules", "target", "dist", "build", "vendor", "__pycache__", "venv")
MOST_BYTES = 1 << 20


def session_lines(spark: SparkSession, folder: str, since: str | None = None, project: str | None = None) -> DataFrame:
    """session, line_no, line of all .jsonl files below a folder, by time of change and by part of the path."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    if since:
        reader = reader.option("modifiedAfter", since)
    rows = reader.text(folder).select(F.col("_metadata.file_path").alias("session"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))
    return rows.where(F.col("session").contains(project)) if project else rows


def source_tree(spark: SparkSession, folder: str) -> DataFrame:
    """path, size, mtime, hash, content of the files of a tree; hidden, vendored and large files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    skip = "|".join(SKIPPED)
    kept = files.where((F.col("length") <= MOST_BYTES) & ~F.col("path").rlike(rf"/(?:\.[^/]+|{skip})(?:/|$)"))
    return kept.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def spend_reports(rows: DataFrame, unit: str) -> DataFrame:
    """key and measures of spend reports in JSON (report), which hold an array 'daily', 'weekly' or 'monthly'."""
    wrapper, key = {"day": ("daily", "date"), "week": ("weekly", "week"), "month": ("monthly", "month")}[unit]
    item = f"{key} string, inputTokens long, outputTokens long, cacheCreationTokens long, cacheReadTokens long, totalTokens long, totalCost double"
    parsed = rows.select(F.explode(F.from_json("report", f"{wrapper} array<struct<{item}>>")[wrapper]).alias("i"))
    return parsed.select(F.col(f"i.{key}").alias("key"), F.col("i.inputTokens").alias("input"), F.col("i.outputTokens").alias("output"), F.col("i.cacheCreationTokens").alias("cache_create"), F.col("i.cacheReadTokens").alias("cache_read"), F.col("i.totalCost").alias("cost"))


def append_usage(facts: DataFrame, folder: str) -> None:
    """Adds facts to a usage table that is partitioned by day, so that old days can be dropped as folders."""
    facts.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("day").parquet(folder)


def read_usage(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows.where(F.col("day") >= F.lit(since).cast("date")) if since else rows


def export(df: DataFrame, folder: str, form: str) -> None:
    """Writes rows as csv (with a header) or json."""
    (df.write.option("header", True).csv(folder) if form == "csv" else df.write.json(folder))


def whole_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, language, text of the files below a folder, each in one row."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("language", X.language_of(F.col("path")))


def ignore_pattern(rules: str, base: str = "") -> tuple[str, str]:
    """What a .gitignore file leaves out, and what it takes back, as patterns of paths below the folder `base`."""
    out: tuple[list[str], list[str]] = ([], [])
    for line in rules.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        name = line.removeprefix("!").rstrip("/")
        rooted = "/" in name
        parts = re.split(r"(/\*\*/|\*\*/|/\*\*|\*|\?)", name.lstrip("/"))
        body = "".join({"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)
        out[back].append(f"{re.escape(base)}{'' if rooted else '(?:.*/)?'}{body}{'/.*' if line.endswith('/') else '(?:/.*)?'}")
    spell = lambda own: f"^(?:{'|'.join(own)})$" if own else "(?!)"
    return spell(out[0]), spell(out[1])


def without_ignored(files: DataFrame, root: str, rules: dict[str, str]) -> DataFrame:
    """Files (path, ...) below root without those that .gitignore files (folder below root -> content) leave out."""
    inner = F.expr(f"substring(path, instr(path, '{root.rstrip('/')}/') + {len(root.rstrip('/')) + 1})")
    for base, content in rules.items():
        gone, back = ignore_pattern(content, f"{base.strip('/')}/" if base.strip("/") else "")
        files = files.where(~inner.rlike(gone) | inner.rlike(back))
    return files


def ignore_rules(ignores: DataFrame) -> DataFrame:
    """repo, folder, line_no, back, folders_only, pattern: the rules of ignore files (repo, folder, text), each as a pattern of
    paths below its folder. back: it takes back what others leave out."""
    rows = ignores.select("repo", "folder", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    line = F.regexp_replace("line", r"(?<!\\)\s+$", "")
    rows = rows.withColumn("line", line).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    back, bare = F.col("line").startswith("!"), F.regexp_replace("line", r"^!|^\\(?=[!#])", "")
    body = F.regexp_replace(bare, "/+$", "")
    rooted, text = body.contains("/"), F.regexp_replace(body, "^/", "")
    for given, marked in ((r"([.+^$(){}|\\])", r"\\$1"), (r"\[!", "[^"), ("/\\*\\*/", "\x01"), ("^\\*\\*/", "\x02"), ("/\\*\\*$", "\x03"), (r"\*+", "[^/]*"), (r"\?", "[^/]"), ("\x01", "/(?:.*/)?"), ("\x02", "(?:.*/)?"), ("\x03", "/.+")):
        text = F.regexp_replace(text, given, marked)
    pattern = F.concat(F.lit("^"), F.when(rooted, "").otherwise("(?:.*/)?"), text, F.lit("$"))
    return rows.select("repo", "folder", "line_no", back.alias("back"), bare.endswith("/").alias("folders_only"), pattern.alias("pattern"))


def not_ignored(files: DataFrame, ignores: DataFrame) -> DataFrame:
    """Files (repo, path, ...) that the ignore files of their repository (repo, folder, text; the root's folder is empty) don't
    leave out. A rule holds below its folder; of the rules that fit the last of the deepest folder counts; what lies in a
    folder that is left out can't be taken back. A path meets the rules of the folders above it by equality."""
    parts = F.split("path", "/")
    prefix = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    entry = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(prefix(n).alias("entry"), (n < F.size(parts)).alias("is_folder")))
    paths = files.select("repo", "path").distinct()
    entries = paths.select("repo", F.explode(entry).alias("e")).select("repo", "e.*").distinct()
    steps = F.split("entry", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda n: F.when(n == 0, "").otherwise(F.array_join(F.slice(steps, 1, n), "/")))
    met = entries.select("repo", "entry", "is_folder", F.explode(above).alias("folder")).join(ignore_rules(ignores), ["repo", "folder"])
    inner = F.when(F.col("folder") == "", F.col("entry")).otherwise(F.expr("substring(entry, length(folder) + 2)"))
    fits = met.where((F.col("is_folder") | ~F.col("folders_only")) & F.rlike(inner, F.col("pattern")))
    last = F.max_by("back", F.struct(F.length("folder").alias("deep"), "line_no"))
    out = fits.groupBy("repo", "entry").agg(last.alias("back")).where(~F.col("back")).select("repo", "entry")
    gone = paths.select("repo", "path", F.explode(F.transform(entry, lambda e: e["entry"])).alias("entry")).join(out, ["repo", "entry"], "left_semi").select("repo", "path").distinct()
    return files.join(gone, ["repo", "path"], "left_anti")


def federated(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of many repositories, each in a folder repo=<name>, as one with the column `repo`; a column that some
    don't have is null there."""
    return spark.read.option("mergeSchema", True).parquet(folder).withColumn("repo", F.col("repo").cast("string"))


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file that all executors can open, read by ranges of its row numbers. The schema names the
    columns that are read."""
    kind = StructType.fromDDL(schema)
    names = ", ".join(f'"{f.name}"' for f in kind)
    with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
        low, high = con.execute(f'SELECT COALESCE(MIN(rowid), 0), COALESCE(MAX(rowid), -1) FROM "{table}"').fetchone()
    step = max(1, -(-(high - low + 1) // parts))
    ranges = spark.range(low, high + 1, step, numPartitions=min(parts, max(1, high - low + 1)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
            for batch in batches:
                for first in batch["id"]:
                    cursor = con.execute(f'SELECT {names} FROM "{table}" WHERE rowid >= ? AND rowid < ?', (int(first), int(first) + step))
                    while rows := cursor.fetchmany(5000):
                        yield pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype=object) for i, f in enumerate(kind)})

    return ranges.mapInPandas(read, kind)


def teed(outputs: DataFrame, least: int, most: int, files: int) -> DataFrame:
    """Raw outputs (slug, epoch, exit_code, raw) that are kept: of failed runs and at least `least` bytes, cut to `most`
    bytes with a note, the newest `files`."""
    size = F.octet_length("raw")
    cut = F.decode(F.substring(F.encode("raw", "UTF-8"), 1, most), "UTF-8")
    content = F.when(size > most, F.concat(cut, F.lit(f"\n\n--- truncated at {most} bytes ---"))).otherwise(F.col("raw"))
    name = F.concat_ws("_", F.col("epoch").cast("string"), X.slug(F.col("slug")))
    rows = outputs.where((F.col("exit_code") != 0) & (size >= least)).select(F.concat(name, F.lit(".log")).alias("file"), content.alias("content"), "epoch")
    return rows.orderBy(F.desc("epoch"), F.desc("file")).limit(files).select("file", "content")


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, folder: str) -> None:
    """Writes a table beside its folder and then renames it into place, so that readers see the old one or the new."""
    spark = df.sparkSession
    fresh, old = f"{folder.rstrip('/')}.{uuid.uuid4().hex}.new", f"{folder.rstrip('/')}.{uuid.uuid4().hex}.old"
    df.write.parquet(fresh)
    path, fs = _path(spark, folder)
    if fs.exists(path):
        fs.rename(path, _path(spark, old)[0])
    if not fs.rename(_path(spark, fresh)[0], path):
        raise OSError(f"{folder} could not be replaced")
    fs.delete(_path(spark, old)[0], True)


def delete_rows(spark: SparkSession, folder: str, condition: Column) -> None:
    """Rewrites a table without the rows that a condition holds for; rows it is null for stay."""
    replace_table(spark.read.parquet(folder).where(~F.coalesce(condition, F.lit(False))), folder)


@contextlib.contextmanager
def refresh_lock(spark: SparkSession, folder: str, wait: float = 2.0, poll: float = 0.05, stale: float = 60.0) -> Iterator[bool]:
    """Holds a folder's lock file; False where another holds it for longer than one waits. Locks older than `stale`
    seconds are taken over."""
    path, fs = _path(spark, f"{folder.rstrip('/')}.lock")
    fs.mkdirs(path.getParent())
    until, held = time.monotonic() + wait, False
    while True:
        with contextlib.suppress(Py4JJavaError):
            fs.create(path, False).close()
            held = True
            break
        with contextlib.suppress(Py4JJavaError):
            if time.time() - fs.getFileStatus(path).getModificationTime() / 1000 > stale:
                fs.delete(path, False)
                continue
        if time.monotonic() >= until:
            break
        time.sleep(poll)
    try:
        yield held
    finally:
        if held:
            fs.delete(path, False)


def refreshed(old: DataFrame, prints: DataFrame, files: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows by file (file_path) after a change of files (path, size, mtime, hash, ...): those of unchanged files stay as
    they are, changed and new files are extracted, rows of removed files go. prints: the fingerprints of `old`."""
    status = fingerprint_changes(files.select("path", "size", "mtime", "hash"), prints)
    same = status.where("status = 'unchanged'").select(F.col("path").alias("file_path"))
    todo = files.join(status.where("status in ('added', 'changed')").select("path"), "path", "left_semi")
    return old.join(same, "file_path", "left_semi").unionByName(extract(todo))
