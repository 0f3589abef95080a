"""Toxicity: a learned lexicon matched through Levenshtein automata, with the words around each hit."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stash, table, text_of

#: At most this many labelled rows are used to fit the lexicon and the model.
TRAIN_ROWS = 12_000
#: Lexicon: at most so many entries, each in this share of toxic texts at least, with this log odds ratio at least.
MAX_ENTRIES, MIN_SHARE, MIN_ODDS = 2000, 0.01, 2.5
#: Prefixes of these lengths can be entries of their own, for stems.
STEMS = (4, 5, 6, 7)
#: Words whose neighbourhood quotes or reports, and words that address somebody (fixed values of this operator).
REPORTING = frozenset("said says quote quoted quotes called wrote writes word words term dit disait mot sagte schrieb wort dijo palabra".split())
ADDRESSING = frozenset("you your you're u are is he she they du dich bist ihr sie ist vous tu es toi usted eres ustedes".split())
AROUND = 5
REMEMBERED = 300_000
_PUNCT = "\"'`.,;:!?()[]{}<>«»“”„‚‘’…*_-+=/\\|~#"
_QUOTES = re.compile("[\"“”„«»]")


class FuzzyLexicon:
    """A trie of entries and, intersected with it, an automaton that accepts what is within an entry's edit bound.

    An automaton state is a set of (trie node, edits so far); states and their transitions are made when first
    reached and kept. Words of 5 letters or more may differ by one edit, of 9 or more by two; stems match as
    exact prefixes.
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.children: list[dict[str, int]] = [{}]
        self.entry: list[str | None] = [None]
        for w in words:
            at = 0
            for c in w:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.entry.append(None)
                at = self.children[at][c]
            self.entry[at] = w
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.start = self._state(self._closed({0: 0}))
        self.stem_lengths = sorted({len(s) for s in stems})
        self.known: dict[str, tuple[str, str, int] | None] = {}

    @staticmethod
    def allowed(word: str) -> int:
        return 0 if len(word) < 5 else 1 if len(word) < 9 else 2

    def _closed(self, found: dict[int, int]) -> frozenset:
        """Add the nodes reached by leaving out letters of entries."""
        todo = list(found)
        while todo:
            node = todo.pop()
            if found[node] < 2:
                for child in self.children[node].values():
                    if found[node] + 1 < found.get(child, 3):
                        found[child] = found[node] + 1
                        todo.append(child)
        return frozenset(found.items())

    def _state(self, key: frozenset) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            hits = [(e, self.entry[n]) for n, e in key if self.entry[n] is not None and e <= self.allowed(self.entry[n])]
            self.accepts.append(min(hits) if hits else None)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        found: dict[int, int] = {}
        for node, edits in self.states[state]:
            for letter, child in self.children[node].items():
                cost = edits + (letter != c)
                if cost < found.get(child, 3):
                    found[child] = cost
            if edits + 1 < found.get(node, 3):
                found[node] = edits + 1
        to = self._state(self._closed(found)) if found else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, entry) of the nearest entry within its bound."""
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                to = self._move(state, c)
            if to < 0:
                return None
            state = to
        return self.accepts[state]

    def look_up(self, token: str) -> tuple[str, str, int] | None:
        """(kind, entry, edits) for a token as it stands between blanks."""
        word = token.strip(_PUNCT)
        if word in self.words:
            return ("word", word, 0)
        for n in self.stem_lengths:
            if word[:n] in self.stems:
                return ("stem", word[:n], 0)
        if len(word) < 4 or not (hit := self.match(word)):
            return None
        return ("fuzzy", hit[1], hit[0])

    def hits(self, words: list[str]) -> list[tuple[int, tuple[str, str, int]]]:
        """(position, hit) of all words of a text that hit."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        there = set(words)
        for w in there:
            if w not in known:
                known[w] = self.look_up(w)
        if not any(map(known.__getitem__, there)):
            return []
        return [(i, known[w]) for i, w in enumerate(words) if known[w]]


FEATURES = 10


def features(lexicon: FuzzyLexicon, text: str) -> list[float]:
    """What the model sees of a whole text; nothing but the text counts."""
    words = text.lower().split()
    hits = lexicon.hits(words)
    if not hits:
        return [0.0] * FEATURES
    marks = np.cumsum([len(_QUOTES.findall(w)) for w in words]) if _QUOTES.search(text) else None
    kinds = {"word": set(), "stem": set(), "fuzzy": set()}
    best = {"word": 0.0, "stem": 0.0, "fuzzy": 0.0}
    quoted = addressed = 0
    for i, (kind, entry, _) in hits:
        kinds[kind].add(entry)
        best[kind] = max(best[kind], lexicon.stems[entry] if kind == "stem" else lexicon.words[entry])
        window = [w.strip(_PUNCT) for w in words[max(0, i - AROUND) : i + AROUND + 1]]
        inside = marks is not None and (marks[i] - len(_QUOTES.findall(words[i]))) % 2 == 1 or bool(_QUOTES.match(words[i]))
        if inside or REPORTING.intersection(window):
            quoted += 1
        elif ADDRESSING.intersection(window):
            addressed += 1
    return [len(kinds["word"]) and math.log1p(len(kinds["word"])), best["word"], math.log1p(len(kinds["stem"])), best["stem"], math.log1p(len(kinds["fuzzy"])), best["fuzzy"], math.log1p(quoted), math.log1p(addressed), math.log1p(len(hits)), math.log1p(1000 * len(hits) / len(words))]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps on scaled features: (weights with the constant last, scales)."""
    scale = np.maximum(x.std(0), 1e-9)
    z = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, scale


class Model:
    """A lexicon and the weights over features()."""

    def __init__(self, lexicon: FuzzyLexicon | None, weights: np.ndarray | None = None, scale: np.ndarray | None = None):
        self.lexicon, self.weights, self.scale = lexicon, weights, scale

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.lexicon is None:
            return np.zeros(len(texts))
        x = np.array([features(self.lexicon, t) for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([x / self.scale, np.ones(len(x))]) @ self.weights, -30, 30)))


def held_out(key: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on at most `rows` labelled rows that are not held out, the same ones each time (smallest by hash).

    The lexicon is counted on the executors: words and stems by the number of different texts of either class
    that hold them. The executors make the sample's features, too; only those numbers and the lexicon reach the
    driver, which fits the weights. Without both classes there is no model, and all scores are 0.
    """
    chosen = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).cast("long").alias("id_")).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("id_"), "id_").limit(rows)
    # The broadcast side has `rows` rows at most; equal texts count once.
    labelled = docs.select(F.col(key).cast("long").alias("id_"), text_of(text).alias("text")).join(F.broadcast(chosen), "id_")
    texts = stash(labelled.groupBy("text").agg(F.max("y").alias("y")))
    n1, n0 = texts.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    if not n1 or not n0:
        return Model(None)
    strip = re.escape(_PUNCT)
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, f"^[{strip}]+|[{strip}]+$", "")))
    stems = F.array_distinct(F.flatten(F.transform(words, lambda w: F.filter(F.array(*[F.when(F.length(w) >= n, F.concat(F.left(w, F.lit(n)), F.lit("*"))) for n in STEMS]), lambda s: s.isNotNull()))))
    counts = texts.select("y", F.explode(F.concat(words, stems)).alias("term")).filter(F.length("term") >= 4).groupBy("term").agg(F.sum("y").alias("c1"), F.sum(1 - F.col("y")).alias("c0"))
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    kept = counts.withColumn("odds", odds).filter((F.col("c1") >= max(3, MIN_SHARE * n1)) & (F.col("odds") >= MIN_ODDS)).orderBy(F.desc("c1"), "term").limit(MAX_ENTRIES).collect()
    found = {r.term: r.odds for r in kept}
    best_stems: dict[str, float] = {}
    for stem in sorted((t[:-1] for t in found if t.endswith("*")), key=lambda s: (len(s), s)):
        if not any(stem[:n] in best_stems for n in range(4, len(stem))):
            best_stems[stem] = found[stem + "*"]
    lexicon = FuzzyLexicon({t: o for t, o in found.items() if not t.endswith("*")}, best_stems)
    entries = (lexicon.words, lexicon.stems)

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = FuzzyLexicon(*entries)
        for b in batches:
            x = np.array([features(own, t) for t in b.text]).reshape(-1, FEATURES)
            yield pd.DataFrame(np.column_stack([x, b.y.to_numpy(float)]), columns=names)

    names = [*(f"x{i}" for i in range(FEATURES)), "y"]
    # Numbers only, for `rows` rows at most.
    table_ = np.array(texts.mapInPandas(seen, ", ".join(f"{n} double" for n in names)).collect(), dtype=float).reshape(-1, FEATURES + 1)
    table_ = table_[np.lexsort(table_.T)]
    return Model(lexicon, *fit(table_[:, :-1], table_[:, -1]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """All rows and columns of `docs` and a score from 0 to 1 for every whole text; null and empty ones are scored as texts without a hit.

    Equal texts, repeated rows among them, have equal scores; a text is held whole by its task, however long. An empty table gives an
    empty one with the same columns. A column that is named `name` already is replaced: give another `name` to keep it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon and (model.lexicon.words, model.lexicon.stems), model.weights, model.scale))  # at most MAX_ENTRIES entries

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        entries, weights, scale = shared.value
        own = Model(FuzzyLexicon(*entries) if entries else None, weights, scale)
        for b in batches:
            yield pd.Series(own.scores(b.tolist()))

    return docs.withColumn(name, F.pandas_udf(run, "double")(text_of(text)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's scores of `documents`, learned from `labels` outside the held-out third."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))
