"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, weighed by the context of each hit."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_column, give_back, map_column

WORD = re.compile(r"[^\W\d_]+")
#: Terms that are always in the lexicon, so that it works without labels. Fixed values.
SEEDS = ("idiot", "moron", "stupid", "worthless", "pathetic", "disgusting", "loser", "scum")
#: Words that announce that somebody else's words follow. Fixed values.
REPORTING = frozenset(
    "said says say wrote writes write quoted quote quotes called calls word words term terms reported claims claimed "
    "sagte sagt schrieb zitat wort dit disait mot mots citation dijo dice palabra cita".split()
)
QUOTES = "\"“”„«»‘’`'"
#: Words on either side of a hit that tell quotation from abuse.
WINDOW = 6
#: Letters of terms that accept two misspellings. With 9, clean texts rejected rose from 1.5 to 5.4 in a hundred.
TWICE_FROM = 14
#: Bounds of the labelled sample that the lexicon and the weights are learned from.
MOST_TOXIC, MOST_CLEAN = 1500, 3000
#: Characters of a text that the model learns from, at most.
LONGEST = 50_000
#: Cached verdicts in a Python worker.
_CACHE = 400_000


def edits_allowed(term: str, fuzzy_from: int = 5, twice_from: int = TWICE_FROM) -> int:
    """How many misspellings a term accepts: none, one, or in long terms two."""
    return (len(term) >= fuzzy_from) + (len(term) >= twice_from)


class FuzzyTrie:
    """A trie of terms intersected with the Levenshtein automata of the words read, determinised as words come.

    A state is the set of (trie node, edits so far) that a prefix of a word can reach; (state, character) pairs are
    kept, so a word costs a dictionary look-up a character and most die after two or three. An edit is a letter added,
    left out, changed, or swapped with the next one. A term accepts words as many edits away as edits_allowed() says,
    but no word in `exceptions`; a stem accepts whatever follows it and allows no edit.
    """

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = (), exceptions: Iterable[str] = (), fuzzy_from: int = 5, twice_from: int = TWICE_FROM):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[str, int]] = {}
        self.stem_ends: dict[int, str] = {}
        self.reach = [0]
        self.exceptions = frozenset(exceptions)
        for term in sorted(set(terms)):
            most = edits_allowed(term, fuzzy_from, twice_from)
            self.ends[self._add(term, most)] = (term, most)
        for stem in sorted(set(stems)):
            self.stem_ends[self._add(stem, 0)] = stem
        self.states: list[frozenset] = []
        self.known: dict[frozenset, int] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.stem_of: list[str | None] = []
        self.start = self._state({(0, "", 0)})

    def _add(self, term: str, edits: int) -> int:
        node = 0
        self.reach[0] = max(self.reach[0], edits)
        for c in term:
            if c not in self.children[node]:
                self.children.append({})
                self.reach.append(0)
                self.children[node][c] = len(self.children) - 1
            node = self.children[node][c]
            self.reach[node] = max(self.reach[node], edits)
        return node

    def _state(self, reached: set[tuple[int, str, int]]) -> int:
        """The number of the state of (node, letter owed by a swap, edits), with letters left out added."""
        todo = list(reached)
        while todo:
            node, owed, edits = todo.pop()
            for child in self.children[node].values() if not owed else ():
                if edits + 1 <= self.reach[child] and (child, "", edits + 1) not in reached:
                    reached.add((child, "", edits + 1))
                    todo.append((child, "", edits + 1))
        best: dict[tuple[int, str], int] = {}
        for node, owed, edits in reached:
            best[node, owed] = min(edits, best.get((node, owed), edits))
        state = frozenset((node, owed, edits) for (node, owed), edits in best.items())
        if state not in self.known:
            self.known[state] = len(self.states)
            self.states.append(state)
            self.stem_of.append(next((self.stem_ends[n] for n, owed, e in sorted(state) if e == 0 and not owed and n in self.stem_ends), None))
        return self.known[state]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, str, int]] = set()
        for node, owed, edits in self.states[state]:
            if owed:
                if c == owed:
                    out.add((node, "", edits))
                continue
            children = self.children[node]
            if (child := children.get(c)) is not None:
                out.add((child, "", edits))
            if edits < self.reach[node]:
                out.add((node, "", edits + 1))
            for letter, child in children.items():
                if edits + 1 <= self.reach[child]:
                    out.add((child, "", edits + 1))
                    after = self.children[child].get(c)
                    if letter != c and after is not None and edits + 1 <= self.reach[after]:
                        out.add((after, letter, edits + 1))
        self.steps[state, c] = after = self._state(out) if out else -1
        return after

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term that accepts the lower-case word, ties to the first in order; or None."""
        state, steps = self.start, self.steps
        for c in word:
            state = steps[state, c] if (state, c) in steps else self._step(state, c)
            if state < 0:
                return None
            if self.stem_of[state] is not None:
                return self.stem_of[state], 0
        ends = [(edits, *self.ends[node]) for node, owed, edits in self.states[state] if not owed and node in self.ends]
        found = min(((edits, term) for edits, term, most in ends if edits <= most), default=None)
        if found is None or found[0] and word in self.exceptions:
            return None
        return found[1], found[0]


FEATURES = ("plain", "fuzzy", "quoted", "density", "bias")


@dataclass
class Model:
    """A lexicon, and the weights of FEATURES."""

    terms: list[str] = field(default_factory=lambda: list(SEEDS))
    stems: list[str] = field(default_factory=list)
    exceptions: list[str] = field(default_factory=list)
    strengths: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [3.0, 1.5, 0.3, 0.5, -3.0])

    def trie(self) -> FuzzyTrie:
        return FuzzyTrie(self.terms, self.stems, self.exceptions)


def _quoted(text: str, words: list[tuple[str, int, int]], i: int) -> bool:
    """Whether the hit lies between quotation marks within WINDOW words, or shortly after a word that reports."""
    first, last = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
    if any(words[j][0] in REPORTING for j in range(first, i)):
        return True
    before, after = text[words[first][1] : words[i][1]], text[words[i][2] : words[last][2] + 1]
    opened = any(c in QUOTES and (k == 0 or not before[k - 1].isalnum()) for k, c in enumerate(before))
    closed = any(c in QUOTES and (k + 1 == len(after) or not after[k + 1].isalnum()) for k, c in enumerate(after))
    return opened and closed


class Scorer:
    """Features and scores of texts; keeps verdicts on the words met, within a bound."""

    def __init__(self, model: Model):
        self.trie, self.weights, self.strengths = model.trie(), np.array(model.weights), model.strengths
        self.seen: dict[str, bool] = {}

    def _suspect(self, piece: str) -> bool:
        if len(self.seen) >= _CACHE:
            self.seen.clear()
        self.seen[piece] = found = any(self.trie.match(w) for w in WORD.findall(piece))
        return found

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        pieces = low.split()
        seen = self.seen
        hot = False
        for piece in set(pieces):
            hot |= seen[piece] if piece in seen else self._suspect(piece)
        if not hot:
            return [0.0, 0.0, 0.0, 0.0, 1.0]
        words = [(m[0], m.start(), m.end()) for m in WORD.finditer(low)]
        plain = fuzzy = quoted = 0.0
        for i, (word, _, _) in enumerate(words):
            if found := self.trie.match(word):
                strength = self.strengths.get(found[0], 1.0)
                if _quoted(low, words, i):
                    quoted += strength
                elif found[1]:
                    fuzzy += strength
                else:
                    plain += strength
        return [math.log1p(plain), math.log1p(fuzzy), math.log1p(quoted), min(5.0, 100.0 * (plain + fuzzy) / max(len(words), 1)), 1.0]

    def score(self, text: str | None) -> float:
        return float(1.0 / (1.0 + math.exp(-float(np.clip(self.weights @ np.array(self.features(text)), -30, 30)))))


def learn_lexicon(texts: list[tuple[str, int]], least_share: float = 0.01) -> Model:
    """Terms and stems that tell toxic texts from clean ones, by smoothed log-odds of the texts that hold them.

    Candidates are whole words and their prefixes of 4 to 10 letters. A candidate is taken when at least `least_share`
    of the toxic texts (5 at least) hold it and its smoothed odds are 30 (stems: 8) times those of clean texts, best first by
    texts times log-odds, and never together with one that it begins or that begins it. A term's strength is its
    log-odds, by a third. Words of clean texts one edit from a term become exceptions.
    """
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    sizes = [sum(toxic == label for _, toxic in texts) for label in (0, 1)]
    words_of: tuple[Counter, Counter] = (Counter(), Counter())
    least = max(5, least_share * sizes[1])
    # toxic texts first: of the prefixes that clean ones hold only those are kept that enough toxic ones hold
    for label in (1, 0):
        for text in (text for text, toxic in texts if toxic == label):
            words = set(WORD.findall(text.lower()))
            words_of[label].update(words)
            begun = {w[:k] for w in words for k in range(4, min(10, len(w)) + 1)}
            counts[label].update(begun if label else begun & counts[1].keys())
        counts = (counts[0], Counter({c: n for c, n in counts[1].items() if n >= least}))
    ranked = []
    for source, whole in ((words_of, True), (counts, False)):
        for term, n in source[1].items():
            odds = (n + 0.5) / (sizes[1] + 1) / ((source[0][term] + 0.5) / (sizes[0] + 1))
            if n >= least and len(term) >= 4 and odds >= (30 if whole else 8):
                ranked.append((round(math.log(odds) * n, 6), whole, len(term), term, round(math.log(odds) / 3, 6)))
    terms: list[str] = []
    stems: list[str] = []
    strengths: dict[str, float] = {}
    for _, whole, _, term, strength in sorted(ranked, reverse=True):
        if any(t.startswith(term) or term.startswith(t) for t in terms + stems):
            continue
        (terms if whole else stems).append(term)
        strengths[term] = strength
    model = Model(terms=sorted({*terms, *SEEDS}), stems=sorted(stems), strengths=strengths)
    trie = model.trie()
    model.exceptions = sorted(w for w in words_of[0] if (found := trie.match(w)) and found[1])
    return model


def quoting(texts: list[tuple[str, int]], model: Model, every: int = 8) -> list[tuple[str, int]]:
    """Clean texts that quote a term: every eighth clean one, with a term in quotation marks after a word that reports.

    Labelled texts hardly ever quote, so that the weight of quoted hits could not be learned from them alone.
    """
    terms, reporting = sorted(model.strengths) or sorted(model.terms), sorted(REPORTING)
    clean = [text for text, label in texts if not label][::every]
    return [(f'{text}\n{reporting[i % len(reporting)]}: "{terms[i % len(terms)]}"', 0) for i, text in enumerate(clean)]


def fit(texts: list[tuple[str, int]], rounds: int = 400) -> Model:
    """A lexicon and logistic weights from (text, label) pairs, and from clean texts made to quote; the default model
    where a class is missing."""
    if {label for _, label in texts} != {0, 1}:
        return Model()
    model = learn_lexicon(texts)
    scorer = Scorer(model)
    texts = texts + quoting(texts, model)
    x = np.array([scorer.features(t) for t, _ in texts])
    y = np.array([label for _, label in texts], dtype=float)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    prior = np.array(Model().weights)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (balance * (p - y)) / len(y) + 1e-3 * (w - prior)
        w -= 2.0 * gradient
    model.weights = [float(v) for v in np.round(w, 6)]
    give_back()
    return model


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; fold 0 is held out. A null key counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5


def training_sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> list[tuple[str, int]]:
    """At most most_toxic + most_clean labelled texts outside fold 0: those whose key has the least MD5.

    The bound makes the sample small enough to broadcast and to learn from on the driver. A key that is labelled both
    ways counts as toxic; of texts that share a key the least counts, so that reruns agree. Texts of more than LONGEST
    characters are not learned from, which bounds what the driver holds.
    """
    known = labels.where((fold(F.col("doc_id")) != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = [known.where(F.col("toxic") == label).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(n) for label, n in ((1, most_toxic), (0, most_clean))]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    labelled = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST).join(picked, "doc_id")
    rows = labelled.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    return [(r["text"] or "", r["toxic"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score (0 to 1) and predicted of each whole text.

    Null and empty texts score like any without a hit; a very long text is read whole, and the density of its hits
    counts. Repeated rows get equal scores, ties are of no account, an empty table gives an empty result, and other
    columns, whatever their names, are ignored.
    """

    def start():
        scorer = Scorer(model)

        def scored(texts: list) -> list[list]:
            found = [scorer.score(t) for t in texts]
            return [found, [int(s >= 0.5) for s in found]]

        return scored

    return map_column(docs, text, [key], "score double, predicted int", start)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""

    def start():
        scorer = Scorer(model)
        return lambda texts: [scorer.score(t) < 0.5 for t in texts]

    return filter_column(docs, "text", start)
