"""Toxicity scores from a learned lexicon, matched with misspellings by Levenshtein automata on a trie.

Lexicon: words, and stems (the first letters of words) that stand in clearly more toxic than clean labelled documents,
with their log odds as weights.  Labels are read from a bounded sample of the labelled rows that may be learned from.
Matching: a token that is no entry and begins with no stem is run through the automaton of all strings within
``EDITS`` of it, intersected with the trie of the words, those under a stem too, and of the stems, which a token may go
on from; it is tried with any two neighbouring letters swapped as well.  Words and stems of ``LONG`` letters or more are
found within ``LONG_EDITS``.  A token is only run if it keeps a part of some entry that so few edits leave whole.  A
token that occurs in clean documents of the sample is no misspelling; all others of the same word are.  Scores: each hit counts by its weight, less for a misspelling, and
by its context: a window of text around it is weighed for quotation marks and verbs of report, which make a quotation,
and for address in the second person, which makes abuse.  A logistic curve, fitted on the sample, maps the sum to 0..1.

Cases: null and empty texts have no evidence and so the least score; very long texts are scored whole; a labelled
document that occurs in several rows counts once for each distinct text; without labels to learn from, or without a
toxic one, all scores are 0; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm import textkit

#: Labelled rows that the lexicon and the curve are learned from, at most.  Entries are as many as reach LEAST_SHARE and
#: LEAST_RATIO in these; there is no limit to their number but what so many texts hold.
SAMPLE_ROWS = 20_000
#: An entry occurs in this share of the toxic documents of the sample at least, and this many times as often there.
LEAST_SHARE, LEAST_RATIO = 0.015, 20.0
LEAST_WORD, STEMS, STEM_GAIN = 4, (3, 4, 5, 6, 7, 8), 1.3
EDITS, LONG_EDITS, LONG, FUZZY_LENGTH, MISSPELT = 1, 2, 9, 4, 0.8
WINDOW_CHARS, QUOTED, REPORTED, ADDRESSED = 48, 0.3, 0.6, 1.2
CACHE_TOKENS = 300_000

_TOKEN = re.compile(r"[^\W_]+")
# Words that report speech and words of address, by language.
_REPORT = re.compile(r"\b(?:said|says|wrote|writes|called|quote|quoted|sagte|schrieb|nannte|dit|écrit|appelé|dijo|escribió|llamó)\b", re.I)
_ADDRESS = re.compile(r"\b(?:you|your|du|dich|dein|ihr|tu|te|toi|vous|usted|tú)\b", re.I)
_QUOTES = "\"“”„«»‘’"


class Automaton:
    """Accepts the strings within ``edits`` of a word.

    A state holds, for each number of edits up to that, the set of places in the word that may have been reached with
    them, as the bits of an integer, so a step is a few operations on whole sets (the non-deterministic automaton run in
    parallel).
    """

    def __init__(self, word: str, edits: int):
        self.edits, self.end = edits, 1 << len(word)
        self.places: dict[str, int] = {}
        for k, c in enumerate(word):
            self.places[c] = self.places.get(c, 0) | 1 << k
        self.all = 2 * self.end - 1

    def start(self) -> tuple[int, ...]:
        return tuple((2 << d) - 1 & self.all for d in range(self.edits + 1))

    def step(self, state: tuple[int, ...], letter: str) -> tuple[int, ...] | None:
        """The state after a letter; None if no string can be accepted from there."""
        here = self.places.get(letter, 0)
        before, reached = state[0], (state[0] & here) << 1
        out = [reached]
        for places in state[1:]:
            # The same letter; one too many; another one; one left out.
            reached = ((places & here) << 1 | before | before << 1 | reached << 1) & self.all
            out.append(reached)
            before = places
        return tuple(out) if reached else None

    def accepts(self, state: tuple[int, ...]) -> bool:
        return bool(state[-1] & self.end)


_POWER = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(512)], np.uint64)


def _hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the first 0, 1, ... ``width`` characters of texts a hash in order and one that is the same in any order."""
    codes = np.array(texts, f"U{max(1, width)}").view(np.uint32).reshape(len(texts), -1).astype(np.uint64)
    mixed = textkit.mix64(codes + np.uint64(1))
    ordered, loose = (np.zeros((len(texts), mixed.shape[1] + 1), np.uint64) for _ in range(2))
    np.cumsum(mixed, axis=1, out=loose[:, 1:])
    for k in range(mixed.shape[1]):
        ordered[:, k + 1] = ordered[:, k] * _POWER[1] + mixed[:, k]
    return ordered, loose


def _swaps(token: str) -> list[str]:
    """A token with each two neighbouring letters swapped that differ."""
    return [token[:k] + token[k + 1] + token[k] + token[k + 2 :] for k in range(len(token) - 1) if token[k] != token[k + 1]]


class Lexicon(dict):
    """Weights of entries; as a dict it is the cache token -> weight (0: no hit)."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], inflected: dict[str, float] | None = None, clean: set[str] | None = None, dense: set[str] | None = None):
        super().__init__()
        self.words, self.stems = words, stems
        #: Words, and longer stems with a star, under a stem that stands for them if spelt right; no misspellings.
        self.inflected, self.clean = inflected or {}, clean or set()
        #: Entries (stems with a star) in whose neighbourhood ordinary words lie densely: matched exactly only.
        self.dense = dense or set()
        self.weights = {w: x for w, x in {**{w: x for w, x in self.inflected.items() if w[-1] != "*"}, **words}.items() if w not in self.dense}
        self.beginnings = {s: x for s, x in {**{w[:-1]: x for w, x in self.inflected.items() if w[-1] == "*"}, **stems}.items() if len(s) > FUZZY_LENGTH and s + "*" not in self.dense}
        self.begin_sizes = sorted({len(s) for s in self.beginnings})
        self.lengths = sorted({len(s) for s in stems})
        self.tries: dict[int, dict] = {}  # by the edits of their entries
        #: By the length of a token: (place, size, parts) tests, one of which holds for any token near an entry; tokens of
        #: other lengths have the tests of the longest.  As many edits as an entry allows leave one of its parts whole.
        places: dict[int, dict[tuple[int, int], set[str]]] = {}
        longest = max([0, *map(len, self.weights), *map(len, self.beginnings)]) + LONG_EDITS + 1
        for word, stem in [*((w, False) for w in self.weights if len(w) >= FUZZY_LENGTH), *((s, True) for s in self.beginnings)]:
            edits, size = self.edits_of(word), len(word)
            node = self.tries.setdefault(edits, {})
            for c in word:
                node = node.setdefault(c, {})
            node["*" if stem else ""] = word
            cuts = [size * k // (edits + 1) for k in range(edits + 2)]
            for n in range(size - edits, longest + 1 if stem else size + edits + 1):
                tests = places.setdefault(n, {})
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    shifts = [0] if k == 0 else [n - size] if k == edits and not stem else range(-edits, edits + 1)
                    for shift in shifts:
                        if a + shift >= 0:
                            tests.setdefault((a + shift, b - a), set()).add(word[a:b])
        self.longest = longest
        self.tests = {n: [(at, at + size, parts) for (at, size), parts in sorted(t.items())] for n, t in places.items()}
        #: Letters in order, of words and of stems: a token with two letters swapped has the same.
        self.letters = {"".join(sorted(w)) for w in self.weights if len(w) >= FUZZY_LENGTH}
        self.begin_letters = {"".join(sorted(s)) for s in self.beginnings}
        # The same tests on hashes: of parts by place, of whole words, of stems by length, and of letters in any order.
        every = lambda texts: np.sort(np.array([_hashes([t], len(t))[0][0, -1] for t in texts], np.uint64))
        loose = lambda texts: np.sort(np.array([_hashes([t], len(t))[1][0, -1] for t in texts], np.uint64))
        self.hashed_tests = {n: [(a, b, every(parts)) for a, b, parts in t] for n, t in self.tests.items()}
        by_size = lambda texts: {n: [t for t in texts if len(t) == n] for n in sorted({len(t) for t in texts})}
        self.hashed_words = {n: every(t) for n, t in by_size(words).items()}
        self.hashed_stems = {n: every(t) for n, t in by_size(stems).items()}
        self.hashed_letters = {n: loose(t) for n, t in by_size(self.letters).items()}
        self.hashed_begin_letters = {n: loose(t) for n, t in by_size(self.begin_letters).items()}
        self.width = max([self.longest, *self.hashed_words, *self.hashed_stems, *self.hashed_letters])

    @property
    def parts(self) -> tuple:
        return self.words, self.stems, self.inflected, self.clean, self.dense

    @staticmethod
    def edits_of(entry: str) -> int:
        return LONG_EDITS if len(entry) >= LONG else EDITS

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        low = token.lower()
        if not (value := self.exact(low)) and low not in self.clean:
            value = MISSPELT * self.misspelt(low)
        self[token] = value
        return value

    def prepare(self, tokens: set[str]) -> None:
        """Notes of many tokens at once those that can be no hit, so that only the others are looked at one by one."""
        new = [t for t in tokens if t not in self]
        if len(self) + len(new) > CACHE_TOKENS:
            self.clear()
            new = list(tokens)
        if not new:
            return
        low = [t.lower() for t in new]
        size = np.fromiter(map(len, low), np.int64, len(low))
        ordered, loose = _hashes(low, self.width)
        maybe = np.zeros(len(low), bool)
        has = lambda hashes, known: known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
        for n, known in self.hashed_stems.items():
            rows = np.flatnonzero(size >= n)
            maybe[rows] |= has(ordered[rows, n], known)
        for n, known in self.hashed_begin_letters.items():
            rows = np.flatnonzero(size >= n)
            maybe[rows] |= has(loose[rows, n], known)
        capped = np.minimum(size, self.longest)
        order = np.argsort(capped, kind="stable")
        bounds = np.searchsorted(capped[order], np.arange(self.longest + 2))
        for n in range(1, self.longest + 1):
            rows = order[bounds[n] : bounds[n + 1]]
            if not len(rows):
                continue
            hit, own = np.zeros(len(rows), bool), ordered[rows]
            for a, b, known in self.hashed_tests.get(n, ()):
                if b <= own.shape[1] - 1:
                    hit |= has(own[:, b] - own[:, a] * _POWER[b - a], known)
            maybe[rows] |= hit
        for hashes, tables in ((ordered, self.hashed_words), (loose, self.hashed_letters)):
            for n, known in tables.items():
                rows = np.flatnonzero(size == n)
                maybe[rows] |= has(hashes[rows, n], known)
        self.update((new[k], 0.0) for k in np.flatnonzero(~maybe).tolist())

    def misspelt(self, token: str) -> float:
        """The greatest weight of what a token may be a misspelling of; else 0."""
        return max((self.beginnings[e[:-1]] if e[-1] == "*" else self.weights[e] for e in self.meant(token)), default=0.0)

    def meant(self, token: str) -> list[str]:
        """The entries that a token may be a misspelling of, stems with a star."""
        if len(token) < FUZZY_LENGTH - EDITS:
            return []
        found = self.near(token) + [s + "*" for s in self.near_stems(token)] if self.may_be_near(token) else []
        # Swapped letters: of a whole word, or of the stem that a longer token goes on from.
        if "".join(sorted(token)) in self.letters:
            found += [s for s in _swaps(token) if s in self.weights]
        for n in self.begin_sizes:
            if "".join(sorted(token[:n])) in self.begin_letters:
                found += [s + "*" for s in _swaps(token[:n]) if s in self.beginnings]
        return found

    def exact(self, token: str) -> float:
        """The weight of a token that is an entry or begins with one; else 0."""
        if (weight := self.words.get(token)) is not None:
            return weight
        for n in self.lengths:
            if (weight := self.stems.get(token[:n])) is not None:
                return weight
        return 0.0

    def may_be_near(self, token: str) -> bool:
        """False for a token that can't be near an entry: it has no part that the edits would leave whole."""
        for a, b, parts in self.tests.get(min(len(token), self.longest), ()):
            if token[a:b] in parts:
                return True
        return False

    def near(self, token: str) -> list[str]:
        """The words within the edits for their length of a token: its automaton and the trie are walked together."""
        return self._walk(token, "")

    def near_stems(self, token: str) -> list[str]:
        """The stems within the edits for their length of a beginning of a token."""
        return self._walk(token, "*")

    def _walk(self, token: str, mark: str) -> list[str]:
        found = []
        for edits, trie in self.tries.items():
            automaton = Automaton(token, edits)
            open_ = [(trie, automaton.start())]
            while open_:
                node, state = open_.pop()
                for letter, child in node.items():
                    if letter in ("", "*"):
                        if letter == mark and (mark or automaton.accepts(state)):
                            found.append(child)
                    elif (following := automaton.step(state, letter)) is not None:
                        open_.append((child, following))
        return found

    def evidence(self, text: str) -> float:
        """The sum of the weights of all hits in a text, by context."""
        return self._evidence(text, set(_TOKEN.findall(text)))

    def evidences(self, texts: list[str]) -> list[float]:
        """The evidence of each of several texts."""
        tokens = [set(_TOKEN.findall(t)) for t in texts]
        self.prepare(set().union(*tokens))
        return [self._evidence(t, own) for t, own in zip(texts, tokens, strict=True)]

    def _evidence(self, text: str, tokens: set[str]) -> float:
        found = [t for t in tokens if self[t]]
        if not found:
            return 0.0
        marked = set(found)
        total = 0.0
        for m in _TOKEN.finditer(text):
            if m[0] in marked:
                total += self[m[0]] * context(text, m.start(), m.end())
        return total


def context(text: str, start: int, end: int) -> float:
    """How much a hit counts, by the window around it."""
    before, after = text[max(0, start - WINDOW_CHARS) : start], text[end : end + WINDOW_CHARS]
    factor = 1.0
    if any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES):
        factor *= QUOTED
    if _REPORT.search(before):
        factor *= REPORTED
    elif _ADDRESS.search(before) or _ADDRESS.search(after):
        factor *= ADDRESSED
    return factor


def terms(text: str) -> set[str]:
    """Words of four letters or more, and stems (marked by a star) of longer ones."""
    words = {w for w in map(str.lower, _TOKEN.findall(text)) if len(w) >= LEAST_WORD}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def learn(sample: DataFrame) -> Lexicon:
    """A lexicon from (text, toxic) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic: dict[str, int] = {}
            clean: dict[str, int] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = toxic if label else clean
                for t in terms(text):
                    held[t] = held.get(t, 0) + 1
            every = list({**toxic, **clean})
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([toxic.get(t, 0) for t in every], pa.int64()), pa.array([clean.get(t, 0) for t in every], pa.int64())], ["term", "t", "c"])

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return Lexicon({}, {})
    # Fewer toxic than LEAST_SHARE allows for would make entries of single documents.
    least = max(3, LEAST_SHARE * n[1])
    counts = sample.select("text", "toxic").mapInArrow(textkit.ending(run), "term string, t long, c long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n.get(0, 0) + 1))
    rows = counts.filter(F.col("t") >= least).select("term", "t", odds.alias("odds")).filter(F.col("odds") >= math.log(LEAST_RATIO)).orderBy(F.desc("t"), "term").collect()
    words = {r["term"]: r for r in rows if not r["term"].endswith("*")}
    stems: dict[str, float] = {}
    for r in sorted((r for r in rows if r["term"].endswith("*")), key=lambda r: (len(r["term"]), r["term"])):
        stem = r["term"][:-1]
        # A stem that hardly says more than one of its words is left to that word.
        single = max((w["t"] for x, w in words.items() if x.startswith(stem)), default=0)
        if r["t"] >= STEM_GAIN * single and not any(stem.startswith(s) for s in stems):
            stems[stem] = r["odds"]
    covered = tuple(stems)
    kept = {x: w["odds"] for x, w in words.items() if not x.startswith(covered)}
    inflected = {r["term"]: r["odds"] for r in rows if r["term"].startswith(covered) and r["term"][:-1] not in stems} if covered else {}
    often = {r["term"]: r["t"] / n[1] for r in rows}
    return Lexicon(kept, stems, inflected, *_clean_neighbours(sample, Lexicon(kept, stems, inflected), often))


def _clean_neighbours(sample: DataFrame, lexicon: Lexicon, often: dict[str, float]) -> tuple[set[str], set[str]]:
    """(tokens near an entry that are no misspellings, entries whose misspellings are not told apart).

    The former are those that clean documents of the sample hold now and then.  The latter are entries to which the rare
    tokens of clean documents are near more often than LEAST_RATIO allows, against how often (by entry) toxic documents
    hold the entry itself.
    """
    shared = sample.sparkSession.sparkContext.broadcast(lexicon.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, known = Lexicon(*shared.value), {}
        for batch in batches:
            tokens, entries = [], []
            for text in batch.column(0).to_pylist():
                for t in {t.lower() for t in _TOKEN.findall(text)}:
                    if t not in known:
                        known[t] = [] if lexicon.exact(t) else lexicon.meant(t)
                    if known[t]:
                        tokens.append(t)
                        entries.append(known[t])
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(entries, pa.list_(pa.string()))], ["token", "entries"])

    size = sample.filter("toxic = 0").count()
    many = max(1, 0.0005 * size)
    near = sample.filter("toxic = 0").select("text").mapInArrow(textkit.ending(run), "token string, entries array<string>").groupBy("token").agg(F.count("*").alias("n"), F.first("entries").alias("entries")).collect()
    rare: dict[str, int] = {}  # near tokens of SAMPLE_ROWS documents at most
    for r in near:
        if r["n"] <= many:
            for e in r["entries"]:
                rare[e] = rare.get(e, 0) + r["n"]
    dense = {e for e, k in rare.items() if k > 1 and k / size * LEAST_RATIO > often.get(e, 0)}
    return {r["token"] for r in near if r["n"] > many}, dense


def _curve(points: list[tuple[float, int, int]], ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, offset) of the logistic curve through (logarithm of evidence, label, rows)."""
    x, y, n = (np.array(v, float) for v in zip(*points, strict=True))
    a, b = 0.0, 0.0
    n = n / n.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([np.sum(n * (p - y) * x) + ridge * a, np.sum(n * (p - y)) + ridge * b])
        w = n * p * (1 - p)
        h = np.array([[np.sum(w * x * x) + ridge, np.sum(w * x)], [np.sum(w * x), np.sum(w) + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, slope: float, offset: float):
        self.lexicon, self.slope, self.offset = lexicon, slope, offset

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.lexicon.words and not self.lexicon.stems:
            return [0.0] * len(texts)
        found = self.lexicon.evidences([t or "" for t in texts])
        return [1 / (1 + math.exp(-(self.slope * math.log1p(e) + self.offset))) for e in found]


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learns from the labelled rows (doc_id, label) for which ``may_learn`` (on doc_id) holds."""
    known = labels.select(labels["doc_id"], labels[label_col].alias("toxic")).filter(may_learn & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Toxic rows are rarer: half of the sample is theirs, if there are as many.
    seeded = lambda label: known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows // 2)
    picked = seeded(0).unionByName(seeded(1))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic")
    distinct = sample.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")
    lexicon = learn(distinct)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*shared.value)
        for batch in batches:
            # The curve is one of the logarithm, which is rounded: it has some hundred values.
            found = [round(math.log1p(e), 2) for e in lexicon.evidences([t or "" for t in batch.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch.column(1).cast(pa.int32())], ["evidence", "toxic"])

    points = sample.mapInArrow(textkit.ending(run), "evidence double, toxic int").groupBy("evidence", "toxic").agg(F.count("*").alias("n")).collect()
    if not points or not (lexicon.words or lexicon.stems):
        return ToxicityModel(lexicon, 0.0, 0.0)
    return ToxicityModel(lexicon, *_curve([(p["evidence"], p["toxic"], p["n"]) for p in points]))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, kept columns, score) of every row; a map without a shuffle."""
    keep = keep or []
    source = docs.select("doc_id", "text", *[docs[c] for c in keep if c not in ("doc_id", "text")])
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.parts, model.slope, model.offset))
    columns = ["doc_id", *keep] if "doc_id" not in keep else list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, slope, offset = shared.value
        model = ToxicityModel(Lexicon(*parts), slope, offset)
        for batch in batches:
            texts = batch.column("text")
            scores = [x for a, b, _, _ in textkit.slices(texts) for x in model.scores(texts.slice(a, b - a).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(scores, pa.float64())], [*columns, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(textkit.ending(run), ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", score double")


def held_out(doc_id: Column) -> Column:
    """Rows never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
