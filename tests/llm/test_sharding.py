import hashlib
from collections import defaultdict

from loomline.llm import sharding


def brute(rows, limit):
    place = lambda d, t: int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:12], 16)
    items = [(d, len((t or "").encode()), place(d, t)) for d, t in rows]
    out = []

    def split(members, depth):
        total = sum(n for _, n, _ in members)
        if not members:
            return
        if total <= limit or len({p for _, _, p in members}) == 1:
            out.extend((d, n, depth, p >> (48 - depth), total, len(members)) for d, n, p in members)
            return
        for bit in (0, 1):
            split([m for m in members if m[2] >> (47 - depth) & 1 == bit], depth + 1)

    split(items, 0)
    return out


def test_shards_against_recursive_splits(spark, tmp_path):
    rows = [(i, "text " * (i % 40)) for i in range(500)] + [(7, "same row " * 30)] * 12 + [(1000, "x" * 5000), (None, None), (None, "y"), (2000, "")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, depth int")
    key = lambda r: tuple((x is None, x) for x in r)
    for limit in (10**6, 2000, 150, 1):
        got = sharding.assign(docs, limit)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, limit), key=key)
    sharding.write_shards(docs.drop("depth"), f"{tmp_path}/out", 2000)
    sizes = defaultdict(int)
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        sizes[r.shard] += len((r.text or "").encode())
    want = {(d, p): total for _, _, d, p, total, _ in brute(rows, 2000)}
    assert sorted(sizes.values()) == sorted(want.values())


def test_empty_table(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0
