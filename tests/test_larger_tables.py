"""Small cases of what only larger tables show."""

import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import extraction, resolution
from loomline.operators import graph as G
from loomline.operators import memory as M
from loomline.operators import privacy as P
from loomline.operators import retrieval as Q
from loomline.plans import registry
from loomline.sources import codebase as C
from loomline.streaming import streams as ST

SMALL = "/root/testdata/sf0.001"


def hash_joins(df):
    """Whether the plan sends a table to the driver to join by its keys."""
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def same_as_sql(spark, name, folder):
    """Whether a query's rows, in any order, are those of its SQL over the tables of a folder."""
    with duckdb.connect() as con:
        for file in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}/*.parquet'")
        want = con.execute(registry.ORACLES[name]).fetchall()
    return sorted(map(repr, map(tuple, registry.QUERIES[name](spark, str(folder)).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["C8_line_numbers", "D18_positional_diff"])
def test_texts_without_lines_or_with_other_line_ends(spark, tmp_path, name):
    texts = ["", "", "", "a", "a\n", "a", "a\r\nb\r\n", "a\nb\n", "\n", "\n\n", "x\n" * 11, "x\r\n" * 9, None, "", "a\u0301b", "é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert same_as_sql(spark, name, tmp_path)


def test_imports_have_no_limit(spark, tmp_path):
    n = M.MOST_EXPORTED * 7 // 6 + 10
    spark.range(n).selectExpr("id * 5 + 1 as conv_id", "0L as turn", "'user' as role", "concat('note ', id) as text").write.parquet(f"{tmp_path}/conversations.parquet")
    active = sum((i * 5 + 1) % 7 > 0 for i in range(n))
    assert active > M.MOST_EXPORTED and registry.QUERIES["A16_import"](spark, str(tmp_path)).count() == active


def test_words_end_at_other_than_ascii_letters(spark):
    lines = spark.createDataFrame([("a", 1, "inñ in inside the_ theé ofü 2of of"), ("a", 2, "if é||ifé elif x")], "file_path string, line_no int, line string")
    symbols = spark.createDataFrame([("s", "s", "a", 1, 1), ("t", "t", "a", 2, 2)], "id string, name string, file_path string, line_start int, line_end int")
    assert dict(G.complexity(lines, symbols, G.words("in", "the", "of")).select("id", "complexity").collect()) == {"s": 6, "t": 1}
    assert dict(G.complexity(lines, symbols).select("id", "complexity").collect()) == {"s": 1, "t": 5}


def test_years_of_five_digits(spark):
    assert [r[0] for r in spark.range(2).select(X.epoch_ms((F.col("id") * 3000000 + 1) * 86400000)).collect()] == ["1970-01-02T00:00:00Z", "10183-09-22T00:00:00Z"]


def test_equal_documents_score_alike(spark):
    """However their postings lie, in either order of each."""
    terms = ["a", "b", "c"]
    rows = [(f"d{i}", t, w) for i in range(60) for t, w in sorted([("a", 3.0), ("b", 7.0), ("c", 2.0)], key=lambda r: (i + 3 * ord(r[0])) * i % 7)]
    rows += [(f"x{i}", terms[i % 3 and 1], 1.0) for i in range(41)] + [(f"y{i}", "z", 5.0) for i in range(500)]
    scores = []
    for k in (1, 3):
        index = spark.createDataFrame(rows[::1 if k == 1 else -1], "doc_id string, term string, tf double").repartition(k)
        scores += [r.score for r in Q.bm25(index, terms).where("doc_id like 'd%'").collect()]
    assert len(scores) == 120 and set(scores) == {1.0}


def test_spans_send_no_table_to_the_driver(spark):
    assert not hash_joins(extraction.extract(C.source_lines(spark, SMALL)))


def test_references_send_no_table_to_the_driver(spark):
    t = resolution.Tables(**C.views(spark, SMALL))
    assert not any(hash_joins(df) for df in C.views(spark, SMALL).values())
    index = resolution.Index(t)
    assert not hash_joins(resolution.imports(t, index)) and "_methods" not in vars(index) and "ancestors" not in vars(index)


def test_types_are_looked_up_together(spark):
    """Each table's use of the lookups is one join, as plans and exchanges take the driver's memory."""
    t = resolution.Tables(**C.views(spark, SMALL))
    joins = lambda df: df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")
    assert joins(resolution.relations(t, resolution.Index(t))) == joins(t.relations) + 2


def test_candidates_send_no_table_to_the_driver(spark):
    found = registry.QUERIES["H39_import_candidates"](spark, SMALL)
    assert not hash_joins(found) and found.where("found like '%,%'").count() > 0


def test_graphs_send_no_table_to_the_driver(spark):
    assert not hash_joins(resolution.resolve(resolution.Tables(**C.views(spark, SMALL)))[0])


def test_graphs_leave_little_on_disk(spark):
    """Tables between are compressed columns, no checkpoints of rows, and the shuffle files of each go when it is there."""
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    found = lambda folders, name: {f for d in folders for f in Path(d).rglob(name)}
    files = lambda: found([d.getPath() for d in env.blockManager().diskBlockManager().localDirs()], "shuffle_*.data")
    rows = lambda: found([(spark.sparkContext.getCheckpointDir() or "").removeprefix("file:")], "rdd-*")
    spark.range(1).transform(G.cut)  # the folder is there
    before = files(), rows()
    made = resolution.resolve(resolution.Tables(**C.views(spark, SMALL)))
    until = time.time() + 20
    while time.time() < until and files() - before[0]:
        time.sleep(0.5)
    assert not files() - before[0] and not rows() - before[1] and made[1].count() > 0


def test_files_of_edges_send_no_table_to_the_driver(spark):
    assert not any(hash_joins(registry.QUERIES[name](spark, SMALL)) for name in ("L15_file_edges", "D14_package_edges"))


def test_postings_are_dealt_out_before_they_are_made(spark):
    docs = spark.createDataFrame([("a", "one_two", "x/two.py"), ("b", "three", "x/y.py")], "id string, name string, path string").coalesce(1)
    index = Q.postings(docs)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange") and index.rdd.getNumPartitions() == 4
    assert {(r.term, r.tf) for r in index.where("doc_id = 'a'").collect()} >= {("one", 3.0), ("two", 5.0)}


def test_gates_send_no_table_to_the_driver(spark):
    assert not any(hash_joins(registry.QUERIES[name](spark, SMALL)) for name in ("K7_gates", "K8_weak_scopes"))


def test_files_of_repositories_are_listed_once(spark):
    plans = [registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString() for name in ("D10_scope_owners", "L8_substantial", "B10_drift_report")]
    assert not any("l_suppkey" in plan for plan in plans)


def test_texts_without_signs_are_not_searched(spark):
    texts = ["a@b.co.c@d.com x@y.zz", "@@a@b.com@c.de a..b%+-@x-.yy", "none", "", "aaa@", "me@x.c you@x.cc5@y.com", "$5 EUR 7 3€ 4", "http://a https://b", "a.local b.c.internal 10.2.3.4 555-123-4567", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for kind, (pattern, _) in (P.PATTERNS | P.SECRETS).items():
        quick = P.counts(F.col("text"), kind)
        assert [r[0] for r in df.select(quick).collect()] == [r[0] for r in df.select(F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).collect()]
        assert "CASE WHEN" in df.select(quick)._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_shuffle_scores_alone(spark, monkeypatch):
    """Of a round's exchanges one is of the scores before the join and one of what is added up."""
    plans, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    edges = spark.createDataFrame([(f"n{i}", f"n{i * 7 % 50}", "CALLS") for i in range(200)], "source string, target string, type string")
    G.pagerank(edges, spark.createDataFrame([("n1", 1.0)], "id string, weight double"), rounds=3)
    assert plans[-1].count("Exchange hashpartitioning") == 2 and "BroadcastHashJoin" not in plans[-1]


def test_rounds_sort_no_steps_and_add_by_numbers(spark, monkeypatch):
    """A round looks scores up in a hash table, and ids are numbers in it; where two ids share a hash another one is taken."""
    plans, cut, key = [], G.cut, G._key
    monkeypatch.setattr(G, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    edges = spark.createDataFrame([(f"n{i}", f"n{i * 7 % 50}", "CALLS") for i in range(200)], "source string, target string, type string")
    seeds = spark.createDataFrame([("n1", 1.0), ("alone", 1.0)], "id string, weight double")
    want = {r.id: round(r.score, 12) for r in G.pagerank(edges, seeds).collect()}
    assert "ShuffledHashJoin" in plans[-1] and "SortMergeJoin" not in plans[-1] and want["alone"] == 0.375
    salts = []
    monkeypatch.setattr(G, "_key", lambda c, salt: (salts.append(salt), F.length(c).cast("long") if salt == 0 else key(c, salt))[1])
    assert {r.id: round(r.score, 12) for r in G.pagerank(edges, seeds).collect()} == want and set(salts) == {0, 1}


def test_postings_of_a_question_are_made_once(spark):
    assert "Generate" not in registry.QUERIES["K6_ask"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


def test_streams_of_runs_have_few_batches(spark, monkeypatch):
    """However many files the lines are in."""
    batches, run = [], ST.run_once
    monkeypatch.setattr(ST, "run_once", lambda stream, mode, checkpoint: (run(stream, mode, checkpoint), batches.extend(Path(f"{checkpoint}/commits".removeprefix("file://")).glob("[0-9]*")))[0])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        assert registry.QUERIES["I5_machine_stream"](spark, SMALL).count() > 0 and 1 <= len(batches) <= 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
