import random
import re

import numpy as np
from pyspark.sql import DataFrameWriter

from loomline.llm import ngram_join


def shingles(text, words=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and"] + ["w%d" % i for i in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = [None, "", " \n\t", "one", "One", "one two three", "a b c d", "A B\tc\nd", "É e é", "é e É"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120, 400]))]
        if rng.random() < 0.5:
            base[3:3] = passage
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append((" " if rng.random() < 0.7 else "\n").join(copy))
    return texts


def run(spark, texts):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_groups(docs).collect()}


def test_against_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        assert run(spark, texts) == brute(texts)


def test_tiles_and_trees_lose_nothing():
    rng = np.random.default_rng(3)
    base = rng.poisson(5, (40, ngram_join.GROUPS)).astype(np.uint32)
    vectors = np.maximum(base[rng.integers(0, 40, 3000)].astype(int) + rng.integers(-1, 2, (3000, ngram_join.GROUPS)) * (rng.random((3000, ngram_join.GROUPS)) < 0.1), 0).astype(np.uint32)
    sizes, classes = vectors.sum(axis=1).astype(np.int64), rng.integers(0, 2500, 3000)
    tree, other = ngram_join.CountTree(sizes, vectors, classes), ngram_join.CountTree(sizes[:70], vectors[:70], classes[:70])
    got = {(int(a), int(b)) for x, y in tree.join(other, 85) for a, b in zip(x, y)}
    bound = np.minimum(vectors[:, None, :], vectors[None, :70, :]).sum(axis=2)
    want = (185 * bound >= 85 * (sizes[:, None] + sizes[None, :70])) & (100 * np.minimum(sizes[:, None], sizes[None, :70]) >= 85 * np.maximum(sizes[:, None], sizes[None, :70]))
    want &= classes[:, None] != classes[None, :70]
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(want)))) and got


def test_repeated_rows_null_keys_and_empty_table(spark):
    text = "one two three four five six"
    docs = spark.createDataFrame([(5, text), (5, text), (3, text), (None, text), (None, "x y"), (8, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.link_groups(docs).collect())
    assert got == [(-1, 1, -1), (-1, 3, 3), (3, 3, 3), (5, 3, 3), (5, 3, 3), (8, 0, 8)]
    assert ngram_join.link_groups(docs.limit(0)).count() == 0
    kept = sorted(r.doc_id for r in ngram_join.keep_one(docs.where("doc_id is not null")).collect())
    assert kept == [3, 8]


def test_a_row_without_key_links_its_neighbours(spark):
    words = ["w%d" % i for i in range(40)]
    a, n, b = [*words], [*words[:-2], "x", "y"], ["z", "v", *words[2:-2], "x", "y"]
    assert 100 * len(shingles(" ".join(a)) & shingles(" ".join(b))) < 85 * len(shingles(" ".join(a)) | shingles(" ".join(b)))
    docs = spark.createDataFrame([(1, " ".join(a)), (None, " ".join(n)), (2, " ".join(b)), (None, "p q r s")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.link_groups(docs).collect()}
    assert got == {(1, 37): 1, (None, 37): 1, (2, 37): 1, (None, 1): None}


def test_large_group_whose_pivot_links_a_part(spark):
    rng = random.Random(5)
    base = ["b%d" % i for i in range(80)]
    texts = []
    for k in range(700):
        copy = list(base)
        for place in rng.sample(range(80), rng.choice([0, 1, 1, 2, 2, 3])):
            copy[place] = "e%d" % rng.randrange(10**6)
        texts.append(" ".join(copy))
    assert run(spark, texts) == brute(texts)


def test_words_longer_than_a_slice_hash_alike_wherever_they_stand():
    from loomline.llm.bytegrams import SLICE
    from loomline.llm.shingles import word_hashes

    for size in (SLICE - 1, SLICE, SLICE + 1, SLICE + 2, 2 * SLICE):
        word = b"q" * size
        found = [word_hashes([text])[1] for text in (word, b" " + word, b"a b " + word + b" c", b"x" * (SLICE - 3) + b" " + word + b"\n")]
        assert len({int(h[k]) for h, k in zip(found, (0, 0, 2, 1))}) == 1


def test_each_pair_is_one_blocks_own():
    homes = np.array([[9, 4, 7, -1], [4, 7, 2, -1], [3, -1, -1, -1]])
    x, y = np.array([0, 0, 1]), np.array([1, 2, 2])
    assert ngram_join.own_pairs(4, homes, x, y).tolist() == [True, True, True]
    assert ngram_join.own_pairs(7, homes, x, y).tolist() == [False, True, True]


def test_rounds_end_where_nothing_is_alike(spark, monkeypatch):
    rounds = []
    bounded = ngram_join._bounded
    monkeypatch.setattr(ngram_join, "_bounded", lambda *a: rounds.append(1) or bounded(*a))
    rng = random.Random(7)
    texts = [" ".join(["one", "and", "the", "same", *("u%d" % rng.randrange(10**9) for _ in range(6))]) for _ in range(40)]
    assert run(spark, texts) == brute(texts) and len(rounds) == 1


def test_trees_find_what_rounds_leave(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    texts = corpus(4)
    assert run(spark, texts) == brute(texts)


def test_small_tables_take_no_memory_of_the_driver(spark, monkeypatch):
    """Each table that a join broadcasts by its size would take megabytes of its heap."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    usual, seen, write = [spark.conf.get(k, None) for k in keys], set(), DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (seen.add(tuple(spark.conf.get(k, None) for k in keys)), write(self, *a, **b))[1])
    docs = spark.createDataFrame([(i, f"a b c d e f g {i // 2}") for i in range(8)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.link_groups(docs).collect()} == {i: i // 2 * 2 for i in range(8)}
    assert seen == {("-1", "-1")} and [spark.conf.get(k, None) for k in keys] == usual
