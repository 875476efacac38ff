"""Secret scans: fixed patterns, and values in credential context that are costly to guess."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_column

#: Fixed patterns of the base kinds, with the least length of the part that counts.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "guess")

#: Words that introduce a credential, for the values that the base patterns do not reach. Fixed values.
#: They may be parts of identifiers: after "_", "-", a digit or a change to upper case, the plain ones after any letter.
WORD = re.compile(
    r"""(?ai:pass(?:word|wd|phrase)|secret|token|credential|api[_-]?key"""
    r"""|(?:(?<![a-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:pass(?:code)?|pwd|auth|bearer|(?:private|access)[_-]?key|signature))"""
    r"""(?:(?<=[a-z])(?=[A-Z])|(?=[sS]?(?![A-Za-z])))"""
)
NAME = re.compile(r"[A-Za-z0-9_-]*")
#: What stands between a name and its value, and the value; after a longer name, a sign is needed.
_VALUE = r"""["'`]?([^\s"'`,;<>(){}\[\]]{8,})"""
SIGNED = re.compile(r"""["']?\s{0,3}[:=]>?\s{0,3}""" + _VALUE)
SPOKEN = re.compile(r"""["']?\s{0,3}(?:(?:is|was|are)\s{1,3}|[:=]>?\s{0,3}|\s)""" + _VALUE)
NEEDLES = ("pass", "pwd", "secret", "token", "credential", "auth", "bearer", "key", "signature")
#: Values of at least so many guesses (as a power of ten) are reported.
LEAST_GUESSES = 10.0
#: Letters of the words taken from a vocabulary.
WORD_LETTERS = (4, 20)

#: Words often met in passwords, by rank.
COMMON = (
    "password 123456 qwerty letmein welcome admin login master dragon monkey shadow sunshine princess football baseball "
    "superman batman trustno1 iloveyou hello freedom whatever secret token test guest root user default changeme example "
    "sample demo public private access summer winter spring autumn server database system service account company office "
    "python java spark data cloud key value name none null true false"
).split()
#: Rows of a keyboard.
KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("40135@$!7", "aoiesasit")


@lru_cache(1)
def _neighbours() -> dict[str, frozenset[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(KEYBOARD):
        for x, key in enumerate(row):
            for dy, dx in ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0)):
                if 0 <= y + dy < len(KEYBOARD) and 0 <= x + dx < len(KEYBOARD[y + dy]):
                    near.setdefault(key, set()).add(KEYBOARD[y + dy][x + dx])
    return {k: frozenset(v) for k, v in near.items()}


@lru_cache(2)
def _ranks(words: str | None) -> dict[str, int]:
    """Ranks of the common words, and behind them those of a vocabulary file's whole words, which are in the order in
    which they were merged, that is, about by how often they are met."""
    ranks = {word: rank for rank, word in enumerate(COMMON, 1)}
    if words is not None:
        model = json.loads(open(words, encoding="utf-8").read())["model"]
        end = model["end_of_word_suffix"]
        whole = (t.removesuffix(end) for t in sorted(model["vocab"], key=model["vocab"].get) if t.endswith(end))
        for word in whole:
            if word.isascii() and word.isalpha() and WORD_LETTERS[0] <= len(word) <= WORD_LETTERS[1]:
                ranks.setdefault(word, len(ranks) + 1)
    return ranks


def _alphabet(part: str) -> int:
    """How many characters a brute-force search over this part's classes tries at each place."""
    classes = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))
    size = sum(n for test, n in classes if any(test(c) for c in part))
    return size + 33 * any(not c.isalnum() for c in part) or 10


_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


def _stretches(value: str, follows: Callable[[int], bool]) -> Iterator[tuple[int, int]]:
    """Maximal stretches [start, end) in which every place but the first follows the one before it."""
    start = 0
    for i in range(1, len(value) + 1):
        if i == len(value) or not follows(i):
            yield start, i
            start = i


def _runs(value: str) -> Iterator[tuple[int, int, str, float]]:
    """Repeats, sequences and keyboard walks of any length, as long as they go."""
    low, near = value.lower(), _neighbours()
    for start, end in _stretches(value, lambda i: value[i] == value[i - 1]):
        if end - start >= 3:
            yield start, end, "repeat", math.log10(_alphabet(value[start]) * (end - start))
    for unit in (2, 3, 4):
        for start, end in _stretches(value[unit:], lambda i, unit=unit: value[unit + i] == value[i] and value[unit + i - 1] == value[i - 1]):
            times = (end - start) // unit + 1
            if times > 1 and value[start] == value[start + unit]:
                yield start, start + unit * times, "repeat", unit * math.log10(_alphabet(value[start : start + unit])) + math.log10(times)
    for step in (1, -1):
        for start, end in _stretches(value, lambda i, step=step: value[i].isalnum() and ord(value[i]) - ord(value[i - 1]) == step):
            if end - start >= 3:
                yield start, end, "sequence", math.log10((26 if value[start].isalpha() else 10) * (end - start) * (1 if step == 1 else 2))
    for start, end in _stretches(value, lambda i: low[i] in near.get(low[i - 1], ())):
        if end - start >= 4:
            turns = 1 + sum(KEYBOARD_ROW[low[i]] != KEYBOARD_ROW[low[i - 1]] for i in range(start + 2, end))
            yield start, end, "walk", math.log10(47 * (end - start)) + turns * math.log10(5)


def _segments(value: str, words: str | None = None) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, kind, log10 of guesses) of every segment but brute-force ones, by start."""
    low = value.lower()
    plain = low.translate(LEET)
    ranks, n = _ranks(words), len(value)
    runs = sorted(_runs(value), reverse=True)
    for i in range(n):
        while runs and runs[-1][0] == i:
            yield runs.pop()
        for j in range(i + 3, min(n, i + WORD_LETTERS[1]) + 1):
            rank, extra = ranks.get(low[i:j]), 1
            if rank is None and (rank := ranks.get(plain[i:j])) is not None:
                extra = 2
            if rank is not None:
                extra *= 1 if value[i:j] == low[i:j] else 2
                yield i, j, "word", math.log10(rank * extra + 1)
        if value[i].isdigit() and (found := _DATE.match(value, i)):
            yield i, found.end(), "date", math.log10(365 * 120 if found.end() - i > 4 else 120)


KEYBOARD_ROW = {key: y for y, row in enumerate(KEYBOARD) for key in row}


def _best(value: str, words: str | None = None, least: float = math.inf) -> list[tuple[float, int, str]]:
    """For each end position the least log10 of guesses, with start and kind of the last segment.

    Stops where the cost of the whole value is known to be at least the given one: a segmentation either ends a
    segment at the place reached or has one that crosses it, and costs only add up.
    """
    n, base = len(value), math.log10(_alphabet(value)) if value else 0.0
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    ending: dict[int, list[tuple[int, str, float]]] = {}
    segments = _segments(value, words)
    ahead = next(segments, None)
    for j in range(1, n + 1):
        while ahead is not None and ahead[0] < j:
            ending.setdefault(ahead[1], []).append((ahead[0], ahead[2], ahead[3]))
            ahead = next(segments, None)
        options = [(best[j - 1][0] + base, j - 1, "brute")]
        options += [(best[i][0] + cost + 0.3, i, kind) for i, kind, cost in ending.pop(j, ())]
        best.append(min(options))
        if best[j][0] >= least and all(best[i][0] + cost >= least for crossing in ending.values() for i, _, cost in crossing):
            break
    return best


def costly(value: str, least: float, words: str | None = None) -> bool:
    """Whether the guess cost of a whole value is at least the given one."""
    best = _best(value, words, least)
    return len(best) <= len(value) or best[-1][0] >= least


def guess_cost(value: str, words: str | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses that the cheapest segmentation of a value needs, and its segments.

    Dynamic programming over end positions: best[j] is the least sum of log-guesses over segmentations of value[:j]
    into words, dates, repeats, sequences, keyboard walks and brute-force spans. Time is linear in the value's length.
    An empty value costs 0.
    """
    best, n = _best(value, words), len(value)
    parts, j = [], n
    while j:
        _, i, kind = best[j]
        parts.append((i, j, kind))
        j = i
    merged: list[tuple[int, int, str]] = []
    for i, j, kind in reversed(parts):
        if kind == "brute" and merged and merged[-1][2] == "brute":
            merged[-1] = (merged[-1][0], j, kind)
        else:
            merged.append((i, j, kind))
    return best[n][0], merged


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns, leftmost and non-overlapping within a kind, by start and then kind."""
    found = []
    low = text.lower()
    if any(word in low for word in ("passw", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    if m := LONG_HEX.search(text):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text, m.start()) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def context_values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what stands as a value after a name with a credential word in it."""
    at = 0
    while m := WORD.search(text, at):
        end = NAME.match(text, m.end()).end()
        alone = end == m.end() and not text[max(m.start() - 1, 0) : m.start()].isalnum()
        found = (SPOKEN if alone else SIGNED).match(text, end)
        if found:
            yield found.span(1)
        at = found.end() if found else end


def guess_spans(text: str, taken: list[tuple[int, int, str]], least: float = LEAST_GUESSES, words: str | None = None) -> list[tuple[int, int, str]]:
    """Values in credential context that cost at least 10**least guesses, without what base spans cover of them."""
    low = text.lower()
    if not any(word in low for word in NEEDLES):
        return []
    found, covered, first = [], sorted((s, e) for s, e, _ in taken), 0
    for start, end in context_values(text):
        value = text[start:end].rstrip(".!?:")
        end = start + len(value)
        if len(value) < 8 or not costly(value, least, words):
            continue
        while first < len(covered) and covered[first][1] <= start:
            first += 1
        at, i = start, first
        while i < len(covered) and covered[i][0] < end:
            if covered[i][0] > at:
                found.append((at, covered[i][0], "guess"))
            at, i = max(at, covered[i][1]), i + 1
        if at < end:
            found.append((at, end, "guess"))
    return found


def spelled(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_text(text: str | None, least: float = LEAST_GUESSES, words: str | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans); offsets are code points, ends are exclusive."""
    if not text:
        return [], []
    base = base_spans(text)
    every = sorted(base + guess_spans(text, base, least, words), key=lambda s: (s[0], KINDS.index(s[2])))
    return base, every


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST_GUESSES, words: str | None = None) -> DataFrame:
    """Spans of secrets in each whole text: key, base and spans, arrays of (start, end, kind).

    words is the path of a vocabulary file on every executor, whose words are cheap to guess.

    Null and empty texts have none. Texts are scanned row by row, so repeated rows and any order give equal results;
    a very long text needs memory in proportion to its own length. Extra columns are ignored.
    """

    def scanned(texts: list) -> list[list]:
        both = [scan_text(t, least, words) for t in texts]
        spell = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]
        return [[spell(b) for b, _ in both], [spell(a) for _, a in both]]

    span = "array<struct<start:int,end:int,kind:string>>"
    return map_column(docs, text, [key], f"base {span}, spans {span}", lambda: scanned)


def redact(docs: DataFrame, mark: str = "[{kind}]", least: float = LEAST_GUESSES, words: str | None = None) -> DataFrame:
    """The documents with every span of a secret replaced by its mark, and n_chars (where present) counted again."""
    out = map_column(docs, "text", docs.columns, "text string", lambda: lambda texts: [[_redacted(t, mark, least, words) for t in texts]])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _redacted(text: str | None, mark: str, least: float, words: str | None) -> str | None:
    _, spans = scan_text(text, least, words)
    if not spans:
        return text
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], mark.format(kind=kind)]
        elif end <= at:
            continue
        at = max(at, end)
    return "".join([*parts, text[at:]])


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text."""
    spell = lambda c: F.array_join(F.transform(F.col(c), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(spell("base"), 256).alias("base_sha256"), spell("spans").alias("spans"))
