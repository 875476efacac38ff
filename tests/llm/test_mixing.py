import re

import pytest

from loomline.llm import mixing


def water_fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by resharing the excess by weight until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= cap * sizes[s]
        open_ -= over
    return target


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size long, at long")


def test_targets_and_taken_words(spark):
    rows = [(i, " ".join(["w x"] * (i * 7 % 50)) or None, ["a", "b", None, "Z", ""][i * i % 5]) for i in range(400)] + [(7, "same words here", "a")] * 5
    got = mixing.mix(frame(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    want = water_fill(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows)
    for source, words in taken.items():
        assert abs(words - want[source]) <= 6
    again = {(r.doc_id, r.taken) for r in mixing.mix(frame(spark, rows[::-1])).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}


def test_empty_table_and_texts_without_words(spark):
    assert mixing.mix(frame(spark, [(1, "x", "a")]).limit(0)).count() == 0
    assert [(r.size, r.taken, r.target) for r in mixing.mix(frame(spark, [(1, None, "a"), (2, " \t", "a")])).collect()] == [(0, 0, 0.0)] * 2


def test_mixed_rows_keep_columns(spark):
    docs = frame(spark, [(i, "one two three", "ab"[i % 2]) for i in range(100)])
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    assert abs(out.count() - 150) <= 2 and out.groupBy("doc_id").count().where("count > 2").count() == 0
