"""Ranked retrieval: weighted postings, BM25, blending with graph scores, reciprocal-rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import cut, shuffled

#: Fixed values.
K1, B, RRF_K, BLEND, RESCUE, TEST_PENALTY = 1.2, 0.75, 60.0, 0.5, 0.15, 0.35
WEIGHTS = {"name": 3.0, "path": 2.0, "signature": 1.0, "doc": 1.0}


def postings(docs: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """doc_id, term, tf: each field's tokens without repeats, weighted by field and added up. Documents are dealt out by id
    before they are cut into tokens: a small file is read by a task or two, which would hold all postings. The number of parts
    is named, since Spark would put small documents together again."""
    fields = [c for c in weights if c in docs.columns]
    tokens = lambda c: X.path_tokens(F.col(c)) if c == "path" else X.identifier_tokens(F.col(c))
    each = F.flatten(F.array(*[F.transform(F.coalesce(tokens(c), F.array().cast("array<string>")), _weighted(weights[c])) for c in fields]))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("id", *fields).repartition(parts, "id").select(F.col("id").alias("doc_id"), F.explode(each).alias("t"))
    return rows.groupBy("doc_id", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"))


def _weighted(w: float):
    return lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"))


def bm25(index: DataFrame, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """doc_id, score (largest 1) of documents that hold a term. Corpus figures are one row; only postings of the
    query's terms are joined with document lengths. A document's parts are added in the order of the terms, so that equal
    documents have equal scores to the last bit."""
    lengths = index.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    hits = index.where(F.col("term").isin(terms))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df), "term").join(lengths, "doc_id").join(F.broadcast(corpus))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    parts = [F.coalesce(F.sum(F.when(F.col("term") == t, part)), F.lit(0.0)) for t in dict.fromkeys(terms)]
    scored = rows.groupBy("doc_id").agg(reduce(Column.__add__, parts, F.lit(0.0)).alias("score")).where("score > 0")
    return _scaled(scored, "score")


def _scaled(scored: DataFrame, column: str) -> DataFrame:
    """The scores as shares of the largest, which is one row and so known to all tasks."""
    top = scored.agg(F.max(column).alias("_top"))
    return scored.join(F.broadcast(top)).withColumn(column, F.col(column) / F.col("_top")).drop("_top")


def rebuilt(index: DataFrame, changed: DataFrame, removed: DataFrame | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The index after documents changed (id and fields) or went (id): only their postings are made anew."""
    ids = changed.select(F.col("id").alias("doc_id"))
    if removed is not None:
        ids = ids.unionByName(removed.select(F.col("id").alias("doc_id")))
    return index.join(ids, "doc_id", "left_anti").unionByName(postings(changed, weights))


def with_rows(scored: DataFrame, docs: DataFrame) -> DataFrame:
    """Scores (doc_id, score) with the rows (id, ...) that they belong to."""
    return scored.withColumnRenamed("doc_id", "id").join(docs, "id")


def restricted(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index of some documents alone; figures follow from it."""
    return index.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")


def blended(lexical: DataFrame, structural: DataFrame, is_test: DataFrame, blend: float = BLEND, rescue: float = RESCUE) -> DataFrame:
    """Lexical and structural scores (each with largest 1) half and half. What only the graph finds needs a structural
    score of `rescue`; tests (id) count less."""
    s = _scaled(structural.select(F.col("id").alias("doc_id"), F.col("score").alias("near")), "near")
    rows = lexical.join(s, "doc_id", "full_outer").where(F.col("score").isNotNull() | (F.col("near") >= rescue))
    total = F.coalesce(F.col("score"), F.lit(0.0)) * (1 - blend) + F.coalesce(F.col("near"), F.lit(0.0)) * blend
    rows = rows.select("doc_id", total.alias("total"), F.col("score").isNull().alias("rescued")).join(is_test.select(F.col("id").alias("doc_id"), F.lit(TEST_PENALTY).alias("factor")), "doc_id", "left")
    return rows.select("doc_id", (F.col("total") * F.coalesce("factor", F.lit(1.0))).alias("score"), "rescued")


def fused(rankings: DataFrame, limit: int, k: float = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of rankings (list, doc_id, score), the best `limit`; a document is attributed to its first
    list. Of each list, four times as many (20 at least) take part, so long lists are cut before they are shuffled."""
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("score"), "doc_id"))
    rows = rankings.withColumn("rank", rank).where(F.col("rank") <= max(4 * limit, 20))
    rows = rows.groupBy("doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("list").alias("first_list"))
    return rows.withColumn("score", F.round("score", 12)).orderBy(F.desc("score"), "doc_id").limit(limit)


def top(scored: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.desc("score"), key).limit(n)


def grep(lines: DataFrame, pattern: str, per_file: int = 25, most: int = 200) -> DataFrame:
    """Matching lines (file_path, line_no, line), at most so many a file and in all, in order of file and line."""
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy("line_no"))
    return lines.where(F.col("line").rlike(pattern)).withColumn("rank", rank).where(F.col("rank") <= per_file).orderBy("file_path", "line_no").limit(most)


def participating(hits: DataFrame, strong: float = 0.1, high: float = 0.5, ratio: float = 0.25) -> DataFrame:
    """Scopes (scope, share, coverage, best) that take part in a query: enough of its weight lies in their names or
    enough of its terms are covered, and their best score comes near the best of all."""
    rows = hits.where((F.col("share") >= strong) | (F.col("coverage") >= high))
    return rows.join(F.broadcast(rows.agg(F.max("best").alias("_most")))).where(F.col("best") >= ratio * F.col("_most")).drop("_most")


def scope_terms(index: DataFrame, owners: DataFrame, terms: list[str]) -> DataFrame:
    """scope, term, idf, n, avg_len: how rare each term of a query is in each scope (owners: doc_id, scope), which is a
    corpus of its own. One pass over the postings gives the figures of all scopes."""
    lengths = index.groupBy("doc_id").agg(F.sum("tf").alias("len"), F.collect_set(F.when(F.col("term").isin(terms), F.col("term"))).alias("held"))
    docs = lengths.join(shuffled(owners.select("doc_id", "scope")), "doc_id")
    held = [F.count_if(F.array_contains("held", t)).alias(f"df{i}") for i, t in enumerate(terms)]
    corpora = docs.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *held)
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"df{i}").alias("df")) for i, t in enumerate(terms)])).alias("t")
    rows = corpora.select("scope", "n", "avg_len", each).select("scope", "n", "avg_len", "t.*")
    return rows.select("scope", "term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"), "n", "avg_len")


def scoped_bm25(index: DataFrame, owners: DataFrame, figures: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """scope, doc_id, score (largest of each scope 1) of documents that hold a term, by the figures of their own scope."""
    hits = index.join(F.broadcast(figures.select("term").distinct()), "term").join(shuffled(owners.select("doc_id", "scope")), "doc_id")
    lengths = index.groupBy("doc_id").agg(F.sum("tf").alias("len"))
    rows = hits.join(shuffled(lengths), "doc_id").join(shuffled(figures), ["scope", "term"])
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = rows.groupBy("scope", "doc_id").agg(F.sum(part).alias("score")).where("score > 0")
    return scored.join(shuffled(scored.groupBy("scope").agg(F.max("score").alias("_top"))), "scope").select("scope", "doc_id", (F.col("score") / F.col("_top")).alias("score"))


def participation(scored: DataFrame, index: DataFrame, figures: DataFrame, names: DataFrame) -> DataFrame:
    """scope, best_doc, best, share, coverage: how much of the query's weight in a scope lies in the name (names: id, name) of
    its best hit, and how much in any of that document's fields."""
    best = scored.groupBy("scope").agg(F.min_by("doc_id", F.struct((-F.col("score")).alias("k"), "doc_id")).alias("best_doc"), F.max("score").alias("best"))
    named = best.join(shuffled(names.select(F.col("id").alias("best_doc"), X.identifier_tokens(F.col("name")).alias("words"))), "best_doc")
    held = index.select(F.col("doc_id").alias("best_doc"), "term", F.lit(True).alias("held"))
    rows = named.join(shuffled(figures), "scope").join(shuffled(held), ["best_doc", "term"], "left")
    whole = F.sum("idf")
    share = lambda hit: F.when(whole > 0, F.sum(F.when(hit, F.col("idf")).otherwise(0.0)) / whole).otherwise(0.0)
    return rows.groupBy("scope", "best_doc", "best").agg(share(F.array_contains("words", F.col("term"))).alias("share"), share(F.col("held").isNotNull()).alias("coverage"))


def scoped_ask(index: DataFrame, owners: DataFrame, names: DataFrame, terms: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, score, first_list (the scope) of the best hits over all scopes that answer the query well enough, fused by
    their ranks; and scope, best of those that matched too weakly."""
    figures = scope_terms(index, owners, terms).transform(cut)
    scored = scoped_bm25(index, owners, figures).transform(cut)
    gates = participation(scored, index, figures, names).transform(cut)
    taking = shuffled(participating(gates).select("scope"))
    hits = fused(scored.join(taking, "scope", "left_semi").select(F.col("scope").alias("list"), "doc_id", "score"), limit)
    return hits, gates.join(taking, "scope", "left_anti").select("scope", "best")


def skeleton(symbols: DataFrame) -> DataFrame:
    """One outline a file: its symbols in order of their spans, members (those inside another's span) indented."""
    before = Window.partitionBy("file_path").orderBy("line_start").rangeBetween(Window.unboundedPreceding, -1)
    depth = symbols.withColumn("depth", F.coalesce((F.max("line_end").over(before) >= F.col("line_end")).cast("int"), F.lit(0)))
    items = F.array_sort(F.collect_list(F.struct("line_start", "id", "depth", "name")))
    return depth.groupBy("file_path").agg(F.array_join(F.transform(items, lambda i: F.concat(F.when(i["depth"] > 0, "  ").otherwise(""), i["name"])), "\n").alias("outline"))
