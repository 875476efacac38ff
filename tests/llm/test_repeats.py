import hashlib
import random
from collections import Counter

import numpy as np

from loomline.llm import repeats


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        mask = [False] * len(d)
        for i in range(len(d) - window + 1):
            if count[d[i : i + window]] > 1:
                mask[i : i + window] = [True] * window
        kept = bytes(b for b, m in zip(d, mask) if not m)
        spans = sum(m and not p for m, p in zip(mask, [False, *mask]))
        out.append((len(d), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, window):
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    texts = [None, "", "short", "a" * (3 * window), "ab" * (2 * window)]
    for i in range(40):
        body = prose(rng.randint(5, 120))
        if i % 3 == 0:
            body = prose(5) + passage[rng.randint(0, 20) :] + body
        if i % 4 == 0 and len(texts) > 8:
            other = rng.choice(texts[5:])
            at = rng.randint(0, len(other))
            body = other[:at] + "X" + other[at:]
        if i % 7 == 0:
            body = body + " " + body[: rng.randint(1, len(body))]
        texts.append(body)
    return texts + texts[6:9]


def check(spark, texts, window, gram, most):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs, window, gram, most).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_against_brute_force(spark):
    check(spark, corpus(random.Random(1), 50), 50, 16, 1000)


def test_large_buckets_are_refined_by_shuffle(spark):
    check(spark, corpus(random.Random(2), 40), 40, 12, 0)


def test_production_window(spark):
    check(spark, corpus(random.Random(3), 200), 200, 64, 2000)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(4).choice("abcdefgh ") for _ in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text[:150]), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in repeats.without_repeats(docs).collect())
    assert got == [(0, 0), (1, 300), (1, 300), (2, 0)]
    assert repeats.without_repeats(docs.limit(0)).count() == 0


def test_refinement_finds_what_occurs_twice_at_one_place_of_a_bucket():
    rng = random.Random(9)
    for window in (3, 5, 7, 12, 40):
        pieces = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(4)]
        data = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))).encode() for _ in range(60)]
        buckets, shift = [rng.randint(0, 3) * 10**15 for _ in data], [rng.randint(0, 6) for _ in data]
        keys = {(i, o): (buckets[i], o - shift[i], d[o : o + window]) for i, d in enumerate(data) for o in range(len(d) - window + 1)}
        count = Counter(keys.values())
        owner, offset = repeats.refined(data, np.array(buckets), np.array(shift), window)
        assert set(zip(owner.tolist(), offset.tolist())) == {k for k, v in keys.items() if count[v] > 1}


def test_texts_beyond_a_slice(spark):
    rng = random.Random(10)
    block = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    other = lambda n: "".join(rng.choices("ijklmnop ", k=n))
    long = other(1_100_000) + block + other(50_000) + block[:400]
    docs = spark.createDataFrame([(1, long), (2, block[300:700])], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.without_repeats(docs).collect()}
    assert got == {1: (len(long), 1100, 2), 2: (400, 400, 1)}


def test_rows_of_null_key_whose_texts_have_equal_short_hashes(spark):
    """Texts with equal 32-bit hashes and one (null) key, of several lengths, are still told apart."""
    from pyspark.sql import functions as F

    ids = spark.range(300_000).select(F.format_string("%08d", "id").alias("t"))
    pairs = [r.both for r in ids.groupBy(F.hash("t").alias("h")).agg(F.sort_array(F.collect_list("t")).alias("both")).where("size(both) > 1").limit(3).collect()]
    assert pairs
    rng = random.Random(5)
    tail = "".join(rng.choice("abcdefgh") for _ in range(240))  # equal ends keep hashes of 4-byte blocks equal
    texts = [t + tail for both in pairs for t in both] + [tail[20:200] + "x" * 70, None, "", tail]
    docs = spark.createDataFrame([(None, t, 1, "y") for t in texts], "doc_id long, text string, mark int, key string")
    assert docs.select(F.hash("text").alias("h")).distinct().count() < len(texts)
    for most in (2000, 0):
        got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(docs, 40, 16, most).collect())
        assert got == sorted(brute(texts, 40))
