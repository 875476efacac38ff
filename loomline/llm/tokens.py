"""Token ids of a public word-end BPE vocabulary, as the tokenizers library gives them, from a table of known words."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import regex
from tiktoken._tiktoken import CoreBPE

#: Texts of these characters only are lower-cased and split the same way by any library; others go to tokenizers itself.
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-˿]*")
#: The vocabulary file's own splitting pattern. Fixed value.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Stands for the word end within a word's bytes; no UTF-8 text holds it.
END = b"\xff"
#: Pieces kept by an encoder.
_KEPT = 400_000


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(2)
def _vocabulary(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    model = json.loads(open(path, encoding="utf-8").read())["model"]
    byte_of, suffix = _byte_of(), model["end_of_word_suffix"]
    raw = lambda t: bytes(byte_of[c] for c in t.removesuffix(suffix)) + (END if t.endswith(suffix) else b"")
    known = {c for t in model["vocab"] for c in t} <= set(byte_of) | set(suffix)
    ranks = {raw(t): i for t, i in model["vocab"].items() if known and not re.fullmatch(r"<\|.*\|>", t)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return ranks, [(raw(a), raw(b)) for a, b in pairs]


@lru_cache(2)
def unsafe_ids(path: str) -> frozenset[int]:
    """Ids that merging by rank alone would build from another pair than the vocabulary lists.

    A word whose ids are all outside this set has the same ids either way: every merge lay within one of its tokens
    and was a listed one, hence also the first that the listed pairs allow.
    """
    ranks, pairs = _vocabulary(path)
    listed = {a + b: (a, b) for a, b in pairs}
    bad = set()
    for token, rank in ranks.items():
        parts = [bytes([b]) for b in token]
        if len(parts) > 1 and parts[-1] == END:
            parts[-2:] = [parts[-2] + END]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            joined = parts[best] + parts[best + 1]
            if joined not in ranks or listed.get(joined) != (parts[best], parts[best + 1]):
                bad.add(rank)
                break
            parts[best : best + 2] = [joined]
    return frozenset(bad)


class Encoder(dict):
    """From a text to its ids as little-endian 32-bit bytes. As a dictionary: from lower-case pieces without white
    space to their ids, filled as pieces come and emptied at a bound."""

    def __init__(self, path: str, unsafe: frozenset[int]):
        super().__init__()
        self.path, self.unsafe, self.slow = path, unsafe, None
        ranks, _ = _vocabulary(path)
        self.core = CoreBPE({**ranks, END: max(ranks.values()) + 1}, {}, r"\S+")

    def whole(self, text: str) -> list[int]:
        """The ids by the tokenizers library itself."""
        if self.slow is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
        return self.slow.encode(text, add_special_tokens=False).ids

    def __missing__(self, piece: str) -> bytes:
        ids: list[int] = []
        for word in SPLIT.findall(piece):
            found = self.core.encode_single_piece(word.encode("utf-8") + END)
            ids += self.whole(word) if not self.unsafe.isdisjoint(found) else found
        if len(self) >= _KEPT:
            self.clear()
        self[piece] = packed = b"".join(i.to_bytes(4, "little") for i in ids)
        return packed

    def encode(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, text.lower().split()))
        return b"".join(i.to_bytes(4, "little") for i in self.whole(text))
