import random

import corpus_pipeline
from loomline.llm.common import table


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abdehimnorstu") for _ in range(rng.randint(2, 7))) for _ in range(n))
    base = prose(150)
    rows = [(i, prose(rng.randint(5, 200)), "en", f"s{i % 3}", None) for i in range(120)]
    rows += [(200 + i, base, "en", "s0", 10) for i in range(5)] + [(300, base.replace(base.split()[70], "changed", 1), "en", "s1", 10)]
    rows += [(400, "you idiot moron stupid idiot", "en", "s2", 5), (401, None, None, None, None), (402, "key password=abcdef12345 end", "en", "s2", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, columns = table(spark, str(tmp_path), "documents"), None
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "secrets", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        columns = columns or docs.columns
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        seen[name] = [r.asDict() for r in docs.collect()]
    ids = lambda name: sorted(r["doc_id"] for r in seen[name])
    assert 400 not in ids("toxicity") and len(ids("toxicity")) == 128
    assert [i for i in ids("ngram_join") if 200 <= i <= 300] == [200] and len(ids("ngram_join")) == 123
    assert next(r["text"] for r in seen["secrets"] if r["doc_id"] == 402) == "key [assign] end"
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()
    assert len(packed) == len(seen["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_near_copies_between_the_thresholds_go(spark, tmp_path):
    base = [f"w{i}" for i in range(47 * 6)]
    scattered = [f"x{i}" if i % 47 == 23 else w for i, w in enumerate(base)]
    block = [f"b{i}" for i in range(300)]
    longer = block[:150] + [f"y{i}" for i in range(65)] + block[150:]
    far = [f"z{i}" if i % 20 == 10 else w for i, w in enumerate(base)]
    grams = lambda words, n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    jaccard = lambda x, y, n: len(grams(x, n) & grams(y, n)) / len(grams(x, n) | grams(y, n))
    assert all(jaccard(x, y, 4) < 0.85 and jaccard(x, y, 5) >= 0.8 for x, y in ((base, scattered), (block, longer))) and jaccard(base, far, 5) < 0.8
    rows = [(1, " ".join(base)), (2, " ".join(scattered)), (3, " ".join(block)), (4, " ".join(longer)), (5, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, str(tmp_path)).collect()) == [1, 3, 5]


def test_empty_tables_and_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, offset string, length string"
    labels = "doc_id long, quality int, toxic int"
    odd = [(None, None, None, None, None, "x", "y"), (1, "", "en", None, 0, None, None), (1, "", "en", None, 0, None, None), (2, " ", "en", "s", 1, "", ""), (3, "w " * 400_000, "en", "s", 800_000, "", "")]
    for name, rows in (("none", []), ("odd", odd)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        packed = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert not packed if name == "none" else {r.doc_id for r in packed} >= {3}
