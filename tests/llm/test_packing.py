import bisect
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from loomline.llm import packing, tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["Hello <|endoftext|> x", "ÀÉİ ſ Σας 中文 á 'S it's we'll don't", "a\xa0b\x85c\x1cd", "", "x" * 5000, "42 1.5e3 ²½ a_b ---", "É́té", "\t\n", "ß Straße ǅ"]


def expected(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_those_of_the_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    encoder = tokens.Encoder(PATH, tokens.unsafe_ids(PATH))
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlucmfwygpbvkéüñ'") for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for text in [*ODD, " ".join(words), " ".join(w.upper() + "," for w in words)]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids)


def check(spark, texts, capacity):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'z' AS offset")
    rows = packing.pack(docs, PATH, capacity).collect()
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in enumerate(texts):
        ids = expected(tokenizer, text)
        got = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in got] == [(k, at, min(capacity, len(ids) - at)) for k, at in enumerate(range(0, len(ids), capacity))]
        for r in got:
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length]))
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_pieces_and_places(spark):
    rng = random.Random(6)
    texts = [None, "", *ODD] + [" ".join(rng.choice(["the", "cat", "sat"]) for _ in range(rng.choice([3, 20, 61, 100, 250]))) for _ in range(300)]
    sequences, total = check(spark, texts, 64)
    assert sequences <= total / 64 * 1.05 + 1


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(7, "one two")] * 3 + [(None, "x")], "doc_id long, text string")
    assert packing.pack(docs.limit(0), PATH).count() == 0
    rows = packing.pack(docs, PATH).collect()
    assert Counter(r.doc_id for r in rows) == {7: 3, None: 1} and len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_plan_is_near_the_lower_bound():
    rng = random.Random(7)
    for most in (4096, 1500, 300):
        counts = Counter(rng.randint(1, most) for _ in range(20000))
        slots = packing.plan(dict(counts))
        used = sequences_of(slots)
        assert sum(s[2] for s in slots) == 20000
        assert used <= -(-sum(k * n for k, n in counts.items()) // 4096) * 1.01 + 1


def sequences_of(slots):
    return max(first + -(-many // each) for _, _, many, each, first, _ in slots)


def best_fit_decreasing(lengths, capacity):
    gaps, opened = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        if at == len(gaps):
            opened += 1
            left = capacity - length
        else:
            left = gaps.pop(at) - length
        bisect.insort(gaps, left)
    return opened


def test_plan_is_best_fit_decreasing():
    rng = random.Random(8)
    cases = [[rng.randint(1000, 1100) for _ in range(3000)], [rng.choice((1000, 1365, 1366, 2050)) for _ in range(3000)], [rng.randint(1, 4096) for _ in range(3000)], [1] * 9000 + [4096], [4095, 1, 1], [7] * 5, [2048] * 5]
    cases += [[rng.randint(1, 60) for _ in range(rng.randint(1, 400))] for _ in range(50)]
    for k, lengths in enumerate(cases):
        capacity = 4096 if k < 7 else 64
        slots = packing.plan(dict(Counter(lengths)), capacity)
        assert sequences_of(slots) == best_fit_decreasing(lengths, capacity)
        ends, seen = {}, Counter()
        for length, first_rank, many, each, first, at in slots:
            assert first_rank == seen[length]
            seen[length] += many
            for n in range(many):
                place = (first + n // each, at + n % each * length)
                assert ends.get(place[0], 0) == place[1]
                ends[place[0]] = place[1] + length
                assert ends[place[0]] <= capacity
        assert seen == Counter(lengths)
