import random

from loomline.llm import toxicity


def distance(a, b):
    """Edits by letters added, left out, changed, and swapped with the next."""
    d = {(i, j): max(i, j) for i in range(-1, len(a) + 1) for j in range(-1, len(b) + 1) if min(i, j) <= 0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_distances():
    rng = random.Random(1)
    terms = ["idiot", "moron", "loser", "stupid", "bad", "abcabc", "worthless", "disgusting", "abababababa"]
    trie = toxicity.FuzzyTrie(terms, ["zorg"], ["morn"], twice_from=9)
    words = [*terms, "morn", "idiots", "diot", "lsoer", "idoit", "zorgling", "zor", "owrthlses", "disgsuting"] + ["".join(rng.choice("idiotmrnlsebac") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    for term in terms:
        for _ in range(300):
            w = list(term)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(w) + 1)
                if rng.random() < 0.4 and k + 1 < len(w):
                    w[k], w[k + 1] = w[k + 1], w[k]
                else:
                    w[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "o"])
            words.append("".join(w))
    for word in words:
        near = min(((distance(word, t), t) for t in terms if distance(word, t) <= toxicity.edits_allowed(t, twice_from=9)), default=None)
        if word.startswith("zorg"):
            assert trie.match(word) == ("zorg", 0)
        elif near is None or near[0] and word == "morn":
            assert trie.match(word) is None
        else:
            assert trie.match(word) == (near[1], near[0]), word


def test_quotation_scores_lower_than_abuse():
    model = toxicity.Model()
    scorer = toxicity.Scorer(model)
    plain, quoted, clean = (scorer.score(t) for t in ("you are an idiot and a moron", 'the word "idiot" was quoted and "moron" too', "a kind day"))
    assert plain > 0.5 > quoted > clean
    assert scorer.score("you are an idioot, morron") > 0.5 and scorer.score(None) == scorer.score("") < 0.5


def test_learning_and_held_out_accuracy(spark):
    rng = random.Random(2)
    common = ["".join(rng.choice("aeioust") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(common) for _ in range(60)]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["glarb", "frobnit", "vexu" + rng.choice(common)]))
        rows.append((i, " ".join(words), "toxic"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None, "x"), (5, rows[5][1], "x")], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_sample(docs, known))
    assert "vexu" in model.stems and {"glarb", "frobnit"} <= set(model.terms)
    got = toxicity.score(docs, model).withColumn("fold", toxicity.fold(toxicity.F.col("doc_id"))).collect()
    held = [r for r in got if r.fold == 0 and r.doc_id is not None]
    assert len(held) > 80 and sum(r.predicted == (r.doc_id % 5 == 1) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got) and len(got) == 702
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and 500 < kept.count() < 600
    assert toxicity.fit([]).terms == toxicity.Model().terms and toxicity.score(docs.limit(0), model).count() == 0


def test_quotation_is_told_from_abuse_by_a_learned_weight():
    rng = random.Random(3)
    common = ["".join(rng.choice("aeioust") for _ in range(rng.randint(2, 6))) for _ in range(200)]
    words = lambda n: [rng.choice(common) for _ in range(n)]
    texts = [(" ".join([*words(20), "glarb", *words(5), "frobnit", *words(15)]), 1) for _ in range(120)] + [(" ".join(words(40)), 0) for _ in range(400)]
    model = toxicity.fit(texts)
    scorer = toxicity.Scorer(model)
    quotes = [f'{" ".join(words(20))} she said "glarb" and wrote "frobnit" {" ".join(words(20))}' for _ in range(50)]
    abuse = [f'{" ".join(words(20))} you glarb and frobnit {" ".join(words(20))}' for _ in range(50)]
    assert model.weights[2] < toxicity.Model().weights[2]
    assert all(scorer.score(t) < 0.5 for t in quotes) and all(scorer.score(t) >= 0.5 for t in abuse)
    assert scorer.score("you golarb, you frobint, " + " ".join(words(10))) >= 0.5


def test_sample_of_repeated_keys_is_the_same_in_every_order(spark):
    rows = [(k, f"text {k} {j} {'idiot' if k % 2 else 'fine'}") for k in range(30) for j in range(4)] + [(3, None), (5, "z" * (toxicity.LONGEST + 1))]
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, toxic int")
    found = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(4)
        found.append(toxicity.training_sample(docs, labels))
    assert found[0] == found[1] and all(len(t) < 100 and " 0 " in t for t, _ in found[0])
    assert len(found[0]) == len({t for t, _ in found[0]})
