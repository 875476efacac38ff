"""Vector codes by cell bounds against comparing every part with every entry, in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from loomline.llm.codes import LARGEST, Cells, encode


def plain(rows, entries=64):
    """rows: (key, vector, label). The result by definition."""
    kept = [(k, [max(-LARGEST, min(LARGEST, math.floor(256 * x))) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = 16 * max(1, -(-max(len(v) for _, v, _ in kept) // 16))
    kept = [(k, v + [0] * (size - len(v)), label) for k, v, label in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    width = size // 16
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(16)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), i) for i, e in enumerate(books[p]))
    for _ in range(2):
        new = []
        for p in range(16):
            of = {}
            for _, v, _ in kept:
                of.setdefault(near(v, p)[1], []).append(cut(v, p))
            new.append([[sum(c) // len(of[i]) for c in zip(*of[i])] if i in of else e for i, e in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    coded = [(k, "".join(f"{near(v, p)[1]:02x}" for p in range(16)), sum(near(v, p)[0] for p in range(16)), label) for k, v, label in kept]
    return [(k, code, error, sum(e for _, _, e, x in coded if x == label), digest) for k, code, error, label in coded]


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("case", ["clusters", "odd", "few", "one length"])
def test_against_definition(spark, case):
    rng = np.random.default_rng(4)
    if case == "clusters":
        rows = [(int(i), (rng.normal(size=32) + 3 * (i % 5)).round(3).tolist(), int(i % 3)) for i in rng.permutation(200)]
        rows += [(i, [1.0] * 32, 7) for i in range(300, 380)]
    elif case == "odd":
        rows = [(i % 40, (rng.normal(size=int(rng.integers(0, 40))) * 2).tolist(), [1, None, 2][i % 3]) for i in range(120)]
        rows += [(None, [0.5] * 5, None), (None, [0.25] * 5, 1), (500, None, 1), (501, [1.0, None], 1), (502, [float("nan")], 1), (503, [float("inf"), 1.0], 1), (504, [], 1), (505, [1e300, -1e300], 2)]
    elif case == "few":
        rows = [(1, [0.5] * 16, None), (2, [-0.001] * 16, 3)]
    else:
        rows = [(i, rng.normal(size=16).tolist(), 1) for i in range(100)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, code string, _ints double").repartition(3)
    assert rows_of(encode(df)) == sorted(plain(rows), key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert encode(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and encode(df).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 4, 6])
def test_bounds_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    book = rng.integers(-20, 20, (3, 64, 4))
    book[:, 10:20] = book[:, :10]  # ties
    cells = Cells(book, bits)
    queries = rng.integers(-30, 30, (500, 4))
    for p in range(3):
        far = ((queries[:, None, :] - book[p][None]) ** 2).sum(axis=2)
        index, least = cells.nearest(p, queries)
        assert (index == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
