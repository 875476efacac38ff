"""The registered queries on the smallest tables: those with SQL against DuckDB, the others by their rows and columns."""

from pathlib import Path

import duckdb
import pytest

from loomline.llm import mixing, ngram_join, queries, repeats, secrets, sharding, toxicity

DATA = Path("/root/testdata/sf0.001")
here = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")

COLUMNS = {
    "op2_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op5_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8_nearest_neighbours": "query_id rank vec_id score",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_repeat_removal": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op12_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op13_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(row):
    return tuple("" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row)


@here
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, duck, name):
    df, want = queries.QUERIES[name](spark, str(DATA)), duck.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    assert sorted(map(plain, df.select(columns).collect())) == sorted(map(plain, want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()))


@here
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, str(DATA))
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    documents = {r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall()}
    if name == "op8_nearest_neighbours":
        assert {r.query_id for r in rows} == {r[0] for r in duck.sql("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").fetchall()}
    else:
        assert {r.doc_id for r in rows} == documents


def test_very_long_texts_are_read_whole(spark):
    words = " ".join(f"w{i % 7919}x{i % 104729}" for i in range(220_000))
    long = f"{words} idiot moron stupid password=abcdef12 the end {words[:3000]}"
    docs = spark.createDataFrame([(1, long, "a"), (2, long + " more", "a"), (3, "short", "b")], "doc_id long, text string, source string")
    assert len(long) > 2_500_000
    sizes = {r.doc_id: r["size"] for r in mixing.mix(docs).collect()}
    assert sizes[1] == len(long.split()) and sizes[3] == 1
    groups = {r.doc_id: r.component_id for r in ngram_join.link_groups(docs).collect()}
    assert groups == {1: 1, 2: 1, 3: 3}
    spans = {r.doc_id: [(long[s.start : s.end], s.kind) for s in r.base] for r in secrets.scan(docs).collect()}
    assert spans[1] == [("password=abcdef12", "assign")]
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.Model()).collect()}
    assert scores[1] > scores[3]
    removed = {r.doc_id: r.n_removed for r in repeats.without_repeats(docs).collect()}
    assert removed[3] == 0 and removed[1] == len(long) and removed[2] == len(long)
    assert {r.doc_id: r.n_bytes for r in sharding.assign(docs).collect()}[2] == len(long) + 5
