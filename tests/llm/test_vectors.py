import random

import numpy as np

from loomline.llm import vectors


def brute(rows, every, top):
    usable = {k: np.array(v, dtype=float) for k, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(usable))
    m = np.array([usable[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        s = (m * usable[q]).sum(axis=1)
        keep = ids != q
        best = np.lexsort((ids[keep], -s[keep]))[:top]
        out[int(q)] = [(int(i), float(x)) for i, x in zip(ids[keep][best], s[keep][best])]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score")
    out = {}
    for r in sorted(vectors.nearest(df, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def clustered(n, dim, seed, spread=0.5):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(10, dim))
    m = centers[rng.integers(0, 10, n)] + spread * rng.normal(size=(n, dim))
    return m.astype(np.float32)


def test_recall_and_scores(spark):
    for m in (clustered(3000, 32, 1), clustered(2000, 16, 2) * np.random.default_rng(3).uniform(0.2, 3, (2000, 1)).astype(np.float32)):
        rows = [(i, v.tolist()) for i, v in enumerate(m)]
        got, want = run(spark, rows), brute(rows, 20, 20)
        assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
        recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
        assert recall >= 0.9
        for q, found in got.items():
            assert found == sorted(found, key=lambda x: (-x[1], x[0]))
            for i, s in found:
                assert abs(s - float((m[i].astype(float) * m[q].astype(float)).sum())) < 1e-9


def test_ties_bad_vectors_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100, None), (120, [0.0, 0.0]), (140, [nan, 1.0]), (160, [inf, 1.0]), (180, [None, 1.0]), (200, [])]
    random.Random(1).shuffle(rows)
    assert run(spark, rows) == brute([r for r in rows if r[1]], 20, 20)
    few = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0])]
    assert run(spark, few) == {0: [(1, 4.0)]}
    assert run(spark, few[:0]) == {} and run(spark, [(0, None)]) == {}


def test_recall_of_a_large_shard_of_any_kind():
    rng = np.random.default_rng(5)
    for points in (clustered(20_000, 48, 6, 0.3).astype(float), rng.normal(size=(8_000, 48))):
        shard = vectors.Shard(np.arange(len(points)), points, 20, vectors.SEARCH_BEAM)
        asked = rng.choice(len(points), 200, replace=False)
        query, found, _ = shard.answer(asked, points[asked])
        product = points[asked] @ points.T
        product[np.arange(200), asked] = -np.inf
        want = np.argsort(-product, axis=1)[:, :20]
        recall = np.mean([len(set(found[query == q]) & set(w)) / 20 for q, w in zip(asked, want)])
        assert recall >= 0.9


def test_shards_stream_their_queries(spark):
    m = clustered(900, 8, 7)
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {}
        for r in vectors.nearest(df, every=3, top=5, shard_rows=60).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {q: [i for i, _ in w] for q, w in brute(rows, 3, 5).items()}
    assert set(got) == set(want) and np.mean([len({*got[q]} & {*want[q]}) / 5 for q in want]) >= 0.95
