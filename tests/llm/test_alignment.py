"""Cross-tokenizer alignment against the two libraries and a plain walk over bytes."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomline.llm.alignment import Aligned, Bits, Pair, align

TEXTS = [
    "the cat sat on the mat", "", None, "naïve café – ﬁne ① 漢字 🎉 end", "tabs\tand\nlines\r\n  more   spaces \n x ", " lead", "trail ", "   ", "\n\n", "it's we'll  they've\x1c odd\x1f x", "<|endoftext|> <s> </s> <unk> <0x41>", "lower one eighth ▁ block",
    "a" * 3000 + " " * 500 + "b　c\xa0d\x85e", "the cat sat on the mat", "x\x00y", "é combininǵ", " line sep​zero", "�", "١٢٣ ४५ 1234567", "don 'tis ' s", "\ttab first", "a \n b\n\n  c", "1" * 50, "é\n è\t\tà",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = {c: i for i, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]))}
    byte_of = {c: i for c, i in shown.items()}
    byte_of |= {chr(256 + n): i for n, i in enumerate(i for i in range(256) if i not in shown.values())}
    return a, b, byte_of


def tokens(libraries, text):
    """((id, bytes) by A, the same by B), or two empty lists."""
    a, b, byte_of = libraries
    if not text:
        return [], []
    ids = a.encode(f" {text}", add_special_tokens=False).ids
    own = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in ids]
    other = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = f" {text}".encode()
    return (own, other) if b"".join(t for _, t in own) == whole == b"".join(t for _, t in other) else ([], [])


def plain(libraries, texts):
    """Every text's row by definition."""
    out, links = [], []
    for text in texts:
        a, b = tokens(libraries, text)
        spans = []
        for side in (a, b):
            at, found = 0, []
            for i, t in side:
                found.append((i, at, at + len(t)))
                at += len(t)
            spans.append(found)
        shared = {e for _, _, e in spans[0]} & {e for _, _, e in spans[1]}
        of = [{}, {}]
        for side, found in enumerate(spans):
            cuts = iter(sorted(shared))
            cut = next(cuts, 0)
            for i, s, e in found:
                if s >= cut:
                    cut = next(cuts)
                of[side].setdefault(cut, []).append(str(i))
        groups = [f"{','.join(of[0][c])}|{','.join(of[1][c])}" for c in sorted(shared)]
        links.append([(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e] if len(a) < 400 else _swept(*spans))
        out.append([len(a), len(b), len(groups), len(links[-1]), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    counts = Counter(p for x in links for p in set(x))
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [(*r[:4], sum(counts[p] == best[p[0]] for p in x), sum(counts[p] for p in x), r[4]) for r, x in zip(out, links)]


def _swept(a, b):
    out, k = [], 0
    for i, s, e in a:
        while b[k][2] <= s:
            k += 1
        m = k
        while m < len(b) and b[m][1] < e:
            out.append((i, b[m][0]))
            m += 1
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("held", [1 << 20, 60, 0])
def test_against_plain_walk(spark, libraries, held):
    docs = spark.createDataFrame([(i % 20, t, 1, "x", "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_a int, _key string, code string").repartition(3)
    got = sorted((tuple(str(v) for v in r) for r in align(docs, most_held=held).collect()))
    want = sorted((str(i % 20), *map(str, r)) for i, r in enumerate(plain(libraries, TEXTS)))
    assert got == want


def test_ids_are_the_libraries(libraries):
    pair = Pair(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
    assert pair.cuttable
    rng = np.random.default_rng(5)
    letters = list("ab e'st.,!19\n\t\r  é漢　\xa0\x1c-")
    texts = ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(3000)]
    for _ in range(2):  # the second time from what is kept
        for side, (ids, n) in enumerate(pair.encode(texts)):
            for text, own in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
                assert own.tolist() == (libraries[1].encode(text) if side else libraries[0].encode(f" {text}", add_special_tokens=False).ids), repr(text)


def test_bits():
    rng = np.random.default_rng(1)
    for size in (1, 63, 64, 65, 1000):
        one, two = (np.flatnonzero(rng.random(size) < 0.3) for _ in range(2))
        a, b = Bits.at(one, size), Bits.at(two, size)
        assert (a & b).select().tolist() == sorted(set(one) & set(two))
        assert (a | b).select().tolist() == sorted(set(one) | set(two))
        places = np.arange(size)
        assert a.rank(places).tolist() == [int((one < p).sum()) for p in places]


def test_long_texts_and_odd_tables(spark, libraries):
    words = " ".join(f"w{i % 7919}" for i in range(60_000))
    texts = [words, " " * 300_000 + "x", "z" * 200_000, "\n \t" * 50_000]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in align(docs).collect())
    assert got == sorted(plain(libraries, texts))
    empty = align(docs.limit(0))
    assert empty.columns == ["doc_id", *COLUMNS] and empty.count() == 0
    assert [tuple(r) for r in align(docs.limit(0).unionByName(spark.createDataFrame([(1, None)], docs.schema))).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_a_batch_gives_what_its_texts_give_alone():
    pair = Pair(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))
    whole = Aligned(pair, TEXTS)
    for i, text in enumerate(TEXTS):
        alone = Aligned(pair, [text])
        assert (alone.groups[0], alone.n_links[0]) == (whole.groups[i], whole.n_links[i])
