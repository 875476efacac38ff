"""Rendered texts: file cards with hand-written notes, manifests, learned rules, source headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands around the generated part of a card, and of a header.
START, END = "<!-- generated:start -->", "<!-- generated:end -->"
HEADER, HEADER_END = "map:start", "map:end"


def wrapped(body: Column) -> Column:
    return F.concat(F.lit(f"{START}\n"), body, F.lit(f"\n{END}"))


def merged(old: Column, body: Column) -> Column:
    """A card with its generated part renewed and all else kept; null where its marks are damaged, so that it is left
    alone. A card without marks keeps its text under the new part; one without text begins with room for notes."""
    start, end = F.locate(START, old), F.locate(END, old)
    kept = F.concat(F.substring(old, F.lit(1), start - 1), wrapped(body), F.substring(old, end + len(END), F.length(old)))
    fresh = F.concat(wrapped(body), F.lit("\n\n## Notes\n"))
    empty = F.coalesce(F.trim(F.regexp_replace(old, r"\s+", " ")) == "", F.lit(True))
    return (
        F.when(empty, fresh)
        .when(start == 0, F.concat(wrapped(body), F.lit("\n\n"), F.regexp_replace(old, r"^\s+", "")))
        .when(end > start, kept)
    )


def cards(symbols: DataFrame, file_edges: DataFrame, old: DataFrame) -> DataFrame:
    """file_path, card, status (written, unchanged, skipped) of every file: its symbols and importers, merged with the
    cards that are there (file_path, card)."""
    items = F.array_sort(F.collect_list(F.struct("line_start", "id", "kind", "name")))
    listed = F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i["kind"], F.lit(" "), i["name"])), "\n")
    bodies = symbols.groupBy("file_path").agg(listed.alias("symbols"))
    users = file_edges.groupBy(F.col("target_file").alias("file_path")).agg(F.countDistinct("source_file").alias("n"))
    rows = bodies.join(users, "file_path", "left").join(old.withColumnRenamed("card", "_old"), "file_path", "left")
    body = F.concat(F.lit("# "), "file_path", F.lit("\n\n"), "symbols", F.lit("\n\nused by "), F.coalesce("n", F.lit(0)), F.lit(" files"))
    new = rows.withColumn("_new", merged(F.col("_old"), body))
    status = F.when(F.col("_new").isNull(), "skipped").when(F.col("_new") == F.col("_old"), "unchanged").otherwise("written")
    return new.select("file_path", F.coalesce("_new", "_old").alias("card"), F.coalesce(status, F.lit("written")).alias("status"))


def manifest(cards: DataFrame) -> DataFrame:
    """file_path and digest of every card."""
    return cards.select("file_path", F.sha2("card", 256).alias("digest"))


#: The file that lists a repository's cards, and the form of manifests.
INDEX, VERSION = "INDEX.md", 1


def _short(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def indexes(cards: DataFrame) -> DataFrame:
    """repo, body: the index of each repository's cards (repo, file, source, body), in order of their sources."""
    line = F.struct("source", F.concat(F.lit("- ["), "source", F.lit("]("), "file", F.lit(")")).alias("line"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda i: i["line"]), "\n")
    return cards.groupBy("repo").agg(F.concat(F.lit("# Index\n\n"), listed).alias("body"))


def manifests(cards: DataFrame, files: DataFrame, extractor: str) -> DataFrame:
    """repo, file, source, hash, source_hash, extractor, version: an entry for each card (repo, file, source, body) and one for
    the repository's index, which has no source. hash is of the generated text, source_hash that of the source file
    (repo, path, hash) at the time."""
    sources = files.select("repo", F.col("path").alias("source"), F.col("hash").alias("source_hash"))
    own = cards.select("repo", "file", "source", _short(F.col("body")).alias("hash")).join(sources, ["repo", "source"], "left").select("repo", "file", "source", "hash", "source_hash")
    first = indexes(cards).select("repo", F.lit(INDEX).alias("file"), F.lit(None).cast("string").alias("source"), _short(F.col("body")).alias("hash"), F.lit(None).cast("string").alias("source_hash"))
    return own.unionByName(first).dropDuplicates(["repo", "file"]).withColumns({"extractor": F.lit(extractor), "version": F.lit(VERSION)})


def drift(manifest: DataFrame, files: DataFrame, extractor: str) -> DataFrame:
    """repo, kind, source of what a repository's cards no longer say: content_drift (the source has changed), removed (it is
    gone), coverage (a source has no card), index_drift (the cards are another extractor's; one row, whose source is that
    one's name) and missing (there is no manifest; one row)."""
    entries = manifest.where("source is not null").select("repo", "source", "source_hash")
    live = files.select("repo", F.col("path").alias("source"), F.col("hash").alias("now"))
    known = manifest.select("repo").distinct()
    both = entries.join(live.join(known, "repo", "left_semi"), ["repo", "source"], "full_outer")
    carded = entries.select("repo", "source", F.lit(True).alias("carded"))
    rows = both.join(carded.distinct(), ["repo", "source"], "left")
    kind = F.when(F.col("now").isNull(), "removed").when(F.col("carded").isNull(), "coverage").when(~F.col("source_hash").eqNullSafe(F.col("now")), "content_drift")
    found = rows.select("repo", kind.alias("kind"), "source").where("kind is not null")
    other = manifest.where(F.col("extractor") != extractor).select("repo", F.lit("index_drift").alias("kind"), F.col("extractor").alias("source")).distinct()
    missing = files.select("repo").distinct().join(known, "repo", "left_anti").select("repo", F.lit("missing").alias("kind"), F.lit(None).cast("string").alias("source"))
    return found.unionByName(other).unionByName(missing)


def orphans(old: DataFrame, cards: DataFrame) -> DataFrame:
    """Old cards whose file is gone, and whether they may be deleted: not if somebody wrote notes into them."""
    gone = old.join(cards.select("file_path"), "file_path", "left_anti")
    rest = F.regexp_replace(F.regexp_replace("card", r"(?s)<!-- generated:start -->.*?<!-- generated:end -->", ""), r"(?m)^## Notes\s*$", "")
    return gone.select("file_path", (F.trim(F.regexp_replace(rest, r"\s+", " ")) == "").alias("deletable"))


def learned(rules: DataFrame) -> DataFrame:
    """base and section of a file of corrections (base, wrong, right, n), a section for each base command."""
    line = F.concat(F.lit("- Use `"), "right", F.lit("` not `"), "wrong", F.lit("`"), F.when(F.col("n") > 1, F.concat(F.lit(" (seen "), F.col("n").cast("string"), F.lit("x)"))).otherwise(""))
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), line.alias("line"))))
    rows = rules.groupBy("base").agg(F.array_join(F.transform(items, lambda i: i["line"]), "\n").alias("lines"))
    title = F.concat(F.upper(F.substring("base", 1, 1)), F.expr("substring(base, 2)"))
    return rows.select("base", F.concat(F.lit("## "), title, F.lit("\n"), "lines", F.lit("\n")).alias("section"))


def with_header(source: Column, header: Column, comment: Column) -> Column:
    """A source text with a header between marks, which are comments: renewed where it is, else put at the top, or
    under a line that names an interpreter."""
    block = F.concat(comment, F.lit(f" {HEADER}\n"), comment, F.lit(" "), header, F.lit("\n"), comment, F.lit(f" {HEADER_END}\n"))
    found = rf"(?s)[^\n]{{1,4}} {HEADER}\n.*?{HEADER_END}\n"
    first = F.when(source.rlike(r"^#!"), F.regexp_extract(source, r"^(#![^\n]*\n?)", 1)).otherwise("")
    rest = F.substring(source, F.length(first) + 1, F.length(source))
    renewed = F.concat(F.regexp_extract(source, rf"(?s)^(.*?){found}", 1), block, F.regexp_extract(source, rf"{found}(.*)$", 1))
    return F.when(source.rlike(found), renewed).otherwise(F.concat(first, block, rest))


def header(source: Column) -> Column:
    """The text between the marks of a header; null for none."""
    found = F.regexp_extract(source, rf"(?s){HEADER}\n[^\n]{{1,4}} (.*?)\n[^\n]{{1,4}} {HEADER_END}", 1)
    return F.nullif(found, F.lit(""))
