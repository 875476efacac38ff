"""Fingerprints: prefix arrays against plain substrings, the edited texts by definition, likeness of known texts."""

import hashlib

import numpy as np
import pytest

from loomline.llm import fingerprints as fp


def prints(*texts):
    return fp.Hashed(list(texts)).whole().fingerprints()


def near(one, two):
    return fp.likeness(*prints(one, two))


def test_spans_are_equal_where_texts_are(monkeypatch):
    rng = np.random.default_rng(2)
    text, other = "".join(rng.choice(list("ab🎉c"), 150)), ""
    other = "x" + text[20:90] + "y" * 30
    for block in (7, 64, 1 << 16):
        monkeypatch.setattr(fp, "BLOCK", block)
        hashed = fp.Hashed([text, other])
        whole = hashed.whole()
        seen = {}
        starts, ends = map(np.array, zip(*[(i, j) for i in range(0, 150, 3) for j in range(i, 150)]))
        for i, j, h in zip(starts, ends, whole.spans(0 * starts, starts, ends).tolist()):
            seen.setdefault(text[i:j], set()).add(h)
        assert all(len(v) == 1 for v in seen.values()) and len({min(v) for v in seen.values()}) == len(seen)
        assert whole.common(0, 20, 1, 1) == 70 and whole.common(0, 0, 0, 0) == 150 and whole.common(0, 150, 1, 0) == 0
        for keep, take in ((40, 60), (0, 50), (3, 4), (100, 0), (0, 0), (10, 101), (120, 5), (0, 101), (0, 7)):
            joined = fp.Spliced(hashed, hashed.lows[:1], np.array([keep]), hashed.lows[1:], np.array([take]))
            alone = fp.Hashed([text[:keep] + other[:take]]).whole()
            assert joined.fingerprints() == alone.fingerprints()
            assert sorted(np.concatenate(joined.grams()[0])) == sorted(np.concatenate(alone.grams()[0]))


def test_texts_hashed_together_have_the_fingerprints_that_they_have_alone():
    texts = ["abc" * 30, "", "x", "é🎉" * 40, "abc" * 30, "abc" * 3000]
    assert prints(*texts) == [p for t in texts for p in prints(t)]


def test_steps():
    for n in range(1, 3000):
        step = 1
        while step * fp.CHECKS < n:
            step *= 2
        assert fp._step(n) == step
    assert fp._step(0) == 1


def test_likeness():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    for n in (30, 300, 5000):
        text = prose(n)
        assert near(text, text) == 1.0 and near(text, prose(n)) < 0.1
        third = len(text) // 3
        assert 0.55 < near(text, text[:-third] + prose(n)[:third]) < 0.75
        assert 0.55 < near(text, prose(n)[:third] + text[third:]) < 0.75
        assert near(text, text + " more") > 0.8
        changed = text.split(" ")
        changed[n // 2] = "other"
        assert near(text, " ".join(changed)) > 0.75
        moved = text[third:] + " " + text[:third]
        assert near(text, moved) > 0.5
    assert near("", "") == 1.0 and near("", "a") == 0.0 and near("a", "b") == 0.0
    assert near("abc", "abd") == pytest.approx(2 / 3)
    assert near("aaaa" * 1000, "aaaa" * 1001) > 0.9


ODD = [
    (5, "a" * 10), (5, "a" * 10), (5, "b🎉" * 7), (4, None), (4, ""), (None, "null key text of some length"), (None, "null key text of some length"), (None, None),
    (9, "x"), (8, "xy"), (7, "xyz"), (-3, "the last of the keys but for null"), (2**62, "ab\x00cd" * 5), (-(2**63), "least"), (6, "w " * 4000),
]


def plain(rows, hashes):
    """(key, n, digest of the edited text, both texts) by definition."""
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    out = []
    for (k, text), (_, following) in zip(order, order[1:] + order[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        of = prints(text, edited, following)
        out.append((k, len(text), hashlib.sha256(edited.encode()).hexdigest(), of[0], of[1], fp.likeness(of[0], of[1]), fp.likeness(of[0], of[2])))
    return sorted(out, key=str)


@pytest.mark.parametrize("case", ["odd", "one", "many", "one key"])
def test_against_definition(spark, case):
    rng = np.random.default_rng(6)
    text = lambda: "".join(rng.choice(list("abc é"), rng.integers(0, 200)))
    rows = {"odd": ODD, "one": [(3, "abcdef")], "many": [(int(k), text()) for k in rng.permutation(500)], "one key": [(1, text()) for _ in range(300)] + [(1, "same")] * 200}[case]
    schema = "doc_id long, text string, n_chars int, _key string, _row int"
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema).repartition(3)
    hashes = {r[0]: r[1] for r in df.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS h").collect()}
    got = fp.fingerprints(df)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, hashes)


def test_long_texts_and_an_empty_table(spark):
    long = "".join(chr(97 + i * i % 23) for i in range(400_000))
    df = spark.createDataFrame([(1, long), (2, long[:300_000] + "!"), (3, long)], "doc_id long, text string")
    got = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    assert got[1].fingerprint == got[3].fingerprint and got[1].n_chars == 400_000
    assert got[3].near_next > 0.7 and got[1].near_next == 1.0 and 0.6 < got[2].near_edited
    assert got[1].edited_sha256 == hashlib.sha256((long[: 400_000 - 133_333] + long[:133_333]).encode()).hexdigest()
    assert fp.fingerprints(df.limit(0)).count() == 0
