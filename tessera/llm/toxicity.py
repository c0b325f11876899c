"""Toxicity: Levenshtein automata intersected with a lexicon trie, with context windows.

A lexicon of words and stems is learned from labelled texts (log-odds of document counts, on a bounded
sample) beside a short list of known insults. Its trie is intersected with the Levenshtein automaton of
distance 1, where two neighbouring letters that change places are one edit too; it is made deterministic while it
runs, so misspelled terms are found as well. Words of five letters or more may be misspelled in any of these ways,
words of four letters by changed places only; stems may not. Each hit is weighed by a window
of words around it: inside quotation marks or beside words of reporting it counts less, beside words of address
more. A logistic model over a text's hits, fitted on hits of the fold that its lexicon did not see, gives the score; its
intercept is set to the shares of the classes among all labelled texts, not those of the sample.

Defined results: a null or empty text has no hits and gets the score of a text without hits; without labelled
rows of both kinds the known insults alone decide, with fixed coefficients; repeated rows are scored alike; other columns,
labels and ids are never inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_stored, map_rows, stored

#: Labelled rows of each class that the model is fitted on, at most: those with the smallest checksums of their ids.
SAMPLE = 4000
#: A term must occur in LEAST_TEXTS toxic texts and in LEAST_SHARE of them, with log-odds of LEAST_ODDS and a deviation of
#: LEAST_SIGMAS from its expected number. No other bound is set to their number.
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS, LEAST_SIGMAS = 4, 0.008, 2.5, 4.0
#: Misspellings are looked for of words of FUZZY_LETTERS or more (of SWAP_LETTERS or more by changed places only)
#: that are known insults or occur in FUZZY_SHARE of the toxic texts.
SWAP_LETTERS, FUZZY_LETTERS, FUZZY_SHARE = 4, 5, 0.05
#: Lengths of stems that are tried besides whole words, unless ``fit`` is given others.
STEMS = range(4, 9)
WINDOW = 6  # words on either side of a hit
THRESHOLD = 0.7
CACHED_WORDS = 100_000

# Insults known beforehand, in four languages.
INSULTS = """idiot moron stupid imbecile cretin loser scum trash worthless pathetic disgusting clown dumbass scumbag jerk
dummkopf trottel abschaum arschloch vollidiot wertlos
crétin imbécile connard salaud ordure minable
imbécil estúpido cabrón gilipollas escoria inútil""".split()
# Words of reporting and of address.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes quoting word words term terms phrase told asked sagte schrieb nannte zitat wort begriff dit écrit appelé citation mot terme dijo escribió llamó cita palabra término".split())
ADDRESS = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split())
QUOTES = "\"“”„«»‟"

_WORD = re.compile(rf"[\w]+|[{QUOTES}]")


@dataclass
class Lexicon:
    """Words (True) and stems (False) with their weights; the words that may be misspelled."""

    weights: dict[tuple[str, bool], float]
    fuzzy: frozenset[str] = frozenset(w for w in INSULTS if len(w) >= SWAP_LETTERS)
    forms: dict[str, float] = field(default_factory=dict)  # misspellings whose weight is known
    max_edits: int = 1


class Automaton:
    """The trie of a lexicon walked by Levenshtein automata. A state is the set of (node, edits, awaited) alive, where
    awaited is the letter that must follow when two have changed places, or empty; its followers are made when first
    needed. ``find`` gives the best term of a word, or None."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.next: list[dict[str, int]] = [{}]
        self.word_end: list[tuple[str, bool] | None] = [None]
        self.stem_end: list[tuple[str, bool] | None] = [None]
        self.fuzzy: list[bool] = [False]  # whether a term that may be misspelled in any way lies below
        self.swaps: list[bool] = [False]  # the same for changed places
        for term, whole in lexicon.weights:
            at, swap = 0, whole and term in lexicon.fuzzy
            may = swap and len(term) >= FUZZY_LETTERS
            self.fuzzy[0] |= may
            self.swaps[0] |= swap
            for letter in term:
                if letter not in self.next[at]:
                    self.next[at][letter] = len(self.next)
                    self.next.append({})
                    self.word_end.append(None)
                    self.stem_end.append(None)
                    self.fuzzy.append(False)
                    self.swaps.append(False)
                at = self.next[at][letter]
                self.fuzzy[at] |= may
                self.swaps[at] |= swap
            (self.word_end if whole else self.stem_end)[at] = (term, whole)
        self.states: dict[frozenset, int] = {}
        self.alive: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.letters = set().union(*self.next) if self.next else set()
        self.start = self._state({(0, 0, "")})
        self.words: dict[str, tuple | None] = {}

    def _state(self, alive: set[tuple[int, int, str]]) -> int:
        best: dict[tuple[int, str], int] = {}
        todo = list(alive)
        while todo:  # a letter of the term left out: go on without reading
            node, edits, awaited = todo.pop()
            if best.get((node, awaited), 9) <= edits:
                continue
            best[node, awaited] = edits
            if edits < self.lexicon.max_edits and not awaited:
                todo += [(n, edits + 1, "") for n in self.next[node].values() if self.fuzzy[n]]
        key = frozenset((node, edits, awaited) for (node, awaited), edits in best.items())
        if key not in self.states:
            self.states[key] = len(self.alive)
            self.alive.append(key)
            self.moves.append({})
        return self.states[key]

    def _step(self, state: int, letter: str) -> int:
        letter = letter if letter in self.letters else ""
        got = self.moves[state].get(letter)
        if got is None:
            following = set()
            for node, edits, awaited in self.alive[state]:
                if awaited:
                    if letter == awaited:
                        following.add((node, edits, ""))
                    continue
                same = self.next[node].get(letter)
                if same is not None:
                    following.add((same, edits, ""))
                if edits < self.lexicon.max_edits:
                    if self.fuzzy[node]:
                        following.add((node, edits + 1, ""))  # a letter too many
                        following.update((n, edits + 1, "") for n in self.next[node].values() if self.fuzzy[n])  # another letter
                    for first, n in self.next[node].items():  # the letter after next comes first
                        beyond = self.next[n].get(letter) if first != letter else None
                        if beyond is not None and self.swaps[beyond]:
                            following.add((beyond, edits + 1, first))
            got = self.moves[state][letter] = self._state(following)
        return got

    def find(self, word: str) -> tuple[tuple[str, bool], int] | None:
        """The term matched and the edits: exact words first, then the longest stem, then the nearest word."""
        if word in self.words:
            return self.words[word]
        state, stem = self.start, None
        for letter in word:
            state = self._step(state, letter)
            if not self.alive[state]:
                break
            for node, edits, _ in self.alive[state]:
                if edits == 0 and self.stem_end[node]:
                    stem = self.stem_end[node]
        else:
            ends = sorted((edits, self.word_end[node]) for node, edits, awaited in self.alive[state] if self.word_end[node] and not awaited and (edits == 0 or self.word_end[node][0] in self.lexicon.fuzzy))
            if ends and (ends[0][0] == 0 or not stem):
                stem = None
                return self._remember(word, (ends[0][1], ends[0][0]))
        return self._remember(word, (stem, 0) if stem else None)

    def _remember(self, word: str, found):
        if len(self.words) >= CACHED_WORDS:
            self.words.clear()
        if len(word) <= 40:
            self.words[word] = found
        return found

    def hits(self, text: str) -> tuple[list[tuple], int]:
        """Hits of a text (form, term, edits, context weight), and its number of words."""
        words = _WORD.findall(text.lower())
        known, find, at = self.words, self.find, []
        for i, w in enumerate(words):
            if (known[w] if w in known else find(w)) is not None:
                at.append(i)
        if not at:
            return [], len(words)
        out = []
        for i in at:
            w = words[i]
            if w in QUOTES:
                continue
            term, edits = find(w)
            before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
            context = 1.0
            if any(x in QUOTES for x in before) and any(x in QUOTES for x in after):
                context *= 0.35
            if any(x in REPORTING for x in before):
                context *= 0.6
            if any(x in ADDRESS for x in before) or any(x in ADDRESS for x in after):
                context *= 1.25
            out.append((w, term, edits, context))
        return out, len(words)


def features(lexicon: Lexicon, hits: list[tuple], n_words: int) -> list[float]:
    """Evidence of distinct terms (which levels off), hits, their density, and the strongest term."""
    by_term: dict[tuple, float] = {}
    total = 0.0
    for form, term, edits, context in hits:
        weight = lexicon.weights[term]
        if edits:
            weight = lexicon.forms.get(form, 0.5 * weight)
        weight *= context
        by_term[term] = max(by_term.get(term, 0.0), weight)
        total += max(0.0, weight)
    distinct = sum(max(0.0, w) for w in by_term.values())
    return [12.0 * math.tanh(distinct / 12.0), math.log1p(total), min(3.0, math.sqrt(100.0 * total / max(20, n_words))), max(by_term.values(), default=0.0)]


@dataclass
class Model:
    lexicon: Lexicon
    coefficients: list[float]  # intercept first

    def score(self, x: list[float]) -> float:
        z = self.coefficients[0] + sum(a * b for a, b in zip(self.coefficients[1:], x))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


#: Coefficients where there is nothing to fit: one known insult outside quotation passes the threshold.
UNFITTED = [-4.0, 0.6, 1.0, 0.3, 0.6]


def _select(counts: dict[tuple[str, bool], list[int]], n_toxic: int, n_clean: int) -> dict[tuple[str, bool], float]:
    """Terms with their log-odds: well supported, rare in clean texts; a stem goes where it adds texts to its
    words, and a longer stem goes where a shorter one is as pure."""
    found = []
    lengths = sorted({len(term) for (term, whole) in counts if not whole})
    for key, (t, c) in counts.items():
        if t < max(LEAST_TEXTS, LEAST_SHARE * n_toxic):
            continue
        odds = math.log((t + 0.5) / (n_toxic + 1)) - math.log((c + 0.5) / (n_clean + 1))
        share = n_toxic / (n_toxic + n_clean)
        expected = (t + c) * share
        if odds >= LEAST_ODDS and (t - expected) / math.sqrt(expected * (1 - share) + 1e-9) >= LEAST_SIGMAS:
            found.append((t * odds, odds, key, t, c))
    found.sort(key=lambda x: (-x[0], x[2]))
    words = {k[0]: (t, c) for _, _, k, t, c in found if k[1]}
    stems = {k[0]: (t, c) for _, _, k, t, c in found if not k[1]}
    out: dict[tuple[str, bool], float] = {}
    for _, odds, (term, whole), t, c in found:
        if not whole:
            best = max((n for w, (n, _) in words.items() if w.startswith(term)), default=0)
            if t < 1.3 * best + 2:  # one word makes nearly all of it
                continue
            if any(term[:k] in stems and stems[term[:k]][1] <= c and stems[term[:k]][0] >= t for k in lengths if k < len(term)):
                continue
        out[term, whole] = min(6.0, odds)
    return out


def _supported(t: Column, c: Column, n_toxic: int, n_clean: int) -> Column:
    """Whether ``_select`` may take a term by its counts alone, checked before terms leave the executors."""
    odds = F.log((t + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))
    return (t >= max(LEAST_TEXTS, LEAST_SHARE * n_toxic)) & (odds >= LEAST_ODDS - 1e-9)


def _with_insults(weights: dict, counts: dict, n_toxic: int, n_clean: int) -> Lexicon:
    out = dict(weights)
    for w in INSULTS:
        if (w, True) not in out:
            t, c = counts.get((w, True), (0, 0))
            odds = math.log((t + 1.0) / (n_toxic + 2)) - math.log((c + 0.1) / (n_clean + 2)) if n_toxic and n_clean else 4.0
            if odds > 1.0:
                out[w, True] = min(4.0, odds)
    usual = {w for w, whole in out if whole and len(w) >= SWAP_LETTERS and (w in INSULTS or counts[w, True][0] >= max(5, FUZZY_SHARE * n_toxic))}
    return Lexicon(out, frozenset(usual))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, steps: int = 3000) -> list[float]:
    """Projected gradient steps on the penalised likelihood; coefficients of features stay at zero or above."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    a = np.hstack([np.ones((len(x), 1)), x / scale])
    penalty = np.array([0.0] + [ridge] * x.shape[1])
    step = 1 / (0.25 * np.linalg.eigvalsh(a.T @ a)[-1] + ridge)
    w = last = np.zeros(a.shape[1])
    for k in range(steps):
        at = w + k / (k + 3) * (w - last)
        new = at - step * (a.T @ (1 / (1 + np.exp(-np.clip(a @ at, -30, 30))) - y) + penalty * at)
        new[1:] = np.maximum(new[1:], 0)
        w, last = new, w
    return [float(w[0]), *(float(v) for v in w[1:] / scale)]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", stems: range = STEMS) -> Model:
    """Fit on labelled rows: at most SAMPLE a class, by the checksum of the id. Only texts and labels are used. All labelled
    texts are counted, so that scores do not depend on whether SAMPLE was reached. Words of any length may be terms; of
    stems the lengths ``stems`` are tried."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1)).groupBy("k").agg(F.max("y").alias("y"))
    order = F.crc32(F.col("k").cast("string"))
    picked = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(order, "k").limit(SAMPLE)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    every = texts.select("k", F.xxhash64("t").alias("h")).join(marked, "k").groupBy("y").agg(F.countDistinct("h").alias("n"))
    # Two times SAMPLE ids at most are sent to the workers; equal texts count once.
    sample = stored(texts.join(F.broadcast(picked), "k").groupBy(F.xxhash64("t").alias("h"), "y").agg(F.min("t").alias("t"), F.min("k").alias("k")).select("t", "y", F.expr("cast(crc32(cast(k as string)) div 3 % 2 as int)").alias("fold")), "toxicity-sample")
    try:
        return _fit(sample, {r["y"]: r["n"] for r in every.collect()}, stems)
    finally:
        drop_stored(sample)


def _fit(sample: DataFrame, every: dict[int, int], stems: range = STEMS) -> Model:
    """``every``: texts of each class among all labelled rows."""
    sizes = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}

    def terms(parts):
        seen: dict[tuple, Counter] = defaultdict(Counter)
        for part in parts:
            for t, y, fold in zip(part["t"], part["y"], part["fold"]):
                words = set(_WORD.findall(t.lower()))
                found = {(w, True) for w in words if w[0] not in QUOTES and not w.isdigit()}
                found |= {(w[:n], False) for w in words for n in stems if len(w) > n}
                seen[fold, y].update(found)
        out = [(term, whole, fold, y, n) for (fold, y), c in seen.items() for (term, whole), n in c.items()]
        yield list(zip(*out)) if out else [[] for _ in range(5)]

    n = {y: sizes.get((0, y), 0) + sizes.get((1, y), 0) for y in (0, 1)}
    if not n[0] or not n[1]:
        return Model(_with_insults({}, {}, 0, 0), UNFITTED)
    known = [*INSULTS]
    rows = (
        map_rows(sample, "term string, whole boolean, fold int, y int, n long", terms)
        .groupBy("term", "whole")
        .agg(*(F.sum(F.when((F.col("fold") == f) & (F.col("y") == y), F.col("n")).otherwise(0)).alias(f"n{f}{y}") for f in (0, 1) for y in (0, 1)))
        .where(F.greatest(*(_supported(*(sum((F.col(f"n{f}{y}") for f in folds), F.lit(0)) for y in (1, 0)), *(sum(sizes.get((f, y), 0) for f in folds) for y in (1, 0))) for folds in ((0,), (1,), (0, 1)))) | F.col("term").isin(known))
        .collect()
    )  # the terms of a bounded sample of texts that occur in a share of them

    def lexicon(folds: tuple[int, ...]) -> Lexicon:
        counts = {(r["term"], r["whole"]): [sum(r[f"n{f}1"] for f in folds), sum(r[f"n{f}0"] for f in folds)] for r in rows}
        toxic, clean = (sum(sizes.get((f, y), 0) for f in folds) for y in (1, 0))
        return _with_insults(_select(counts, toxic, clean), counts, toxic, clean)

    full, crossed = lexicon((0, 1)), {0: lexicon((1,)), 1: lexicon((0,))}

    def found(parts):
        own = {f: Automaton(x) for f, x in crossed.items()}
        whole = Automaton(full)
        for part in parts:
            y, fold, x, forms = [], [], [], []
            for t, label, f in zip(part["t"], part["y"], part["fold"]):
                hits, n_words = own[f].hits(t)
                y.append(label)
                fold.append(f)
                x.append(features(own[f].lexicon, hits, n_words))
                forms.append(sorted({h[0] for h in whole.hits(t)[0] if h[2]}))
            yield [y, fold, x, forms]

    got = map_rows(sample, "y int, fold int, x array<double>, forms array<string>", found).collect()
    seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for r in got:
        for form in r["forms"]:
            seen[form][r["y"]] += 1
    full.forms = {form: max(0.0, min(4.0, math.log((t + 0.25) / n[1]) - math.log((c + 0.25) / n[0]))) for form, (c, t) in seen.items()}
    coefficients = _logistic(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float))
    coefficients[0] += math.log(every[1] / n[1]) - math.log(every[0] / n[0])
    return Model(full, coefficients)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` (0 to 1) of every row."""
    keyed = docs.select(docs[key].alias("k"), docs[text].alias("t"))

    def rows(parts):
        automaton = Automaton(model.lexicon)
        for part in parts:
            yield [part["k"], [model.score(features(model.lexicon, *automaton.hits(t or ""))) for t in part["t"]]]

    return map_rows(keyed, f"{key} {keyed.schema['k'].dataType.simpleString()}, score double", rows)


def reject(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows below the threshold, all columns kept as they are."""
    automatons: list[Automaton] = []

    @F.pandas_udf("boolean")
    def clean(texts):
        if not automatons:
            automatons.append(Automaton(model.lexicon))
        return texts.map(lambda t: model.score(features(model.lexicon, *automatons[0].hits(t or ""))) < threshold)

    return docs.where(clean(F.col(text)))
