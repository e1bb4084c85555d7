"""Toxicity scores from a lexicon, misspellings included, and the words around each find.

The lexicon holds fixed abusive words and terms (words or word beginnings) that a bounded sample of labelled
training rows singles out. Its trie is intersected with Levenshtein automata: a state is a set of (trie node, edits
spent), made deterministic lazily and shared by all words, so a word runs through at one step a character. Finds inside
quotation marks or next to reporting words count apart from those that are aimed at somebody. A logistic model over these counts, fitted on the same sample, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Labelled training rows that lexicon and model are fitted on at most, by a hash of the identifier.
SAMPLE_ROWS = 8000
LEARNED_TERMS = 64
STEM_LENGTHS = range(4, 9)
THRESHOLD = 0.3
#: Pairs (trie node, edits) in the automaton states that a worker remembers, about 100 bytes each.
MOST_PAIRS = 2_000_000
#: Tokens to each side of a find that are looked at.
CONTEXT = 6
#: Signs that may stand for letters; a word is letters and such signs in any order, with a letter among them.
MASKS = "*@$!0134"
WORD = re.compile(rf"[{MASKS}]*+[^\W\d_](?:[^\W\d_]|[{MASKS}])*+")
#: Abusive words, reporting words, words that address somebody, quotation marks.
ABUSIVE = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile cretin bastard dumbass jackass retard vermin imbécile crétin connard abruti salaud débile dummkopf arschloch trottel mistkerl imbécil estúpido cretino payaso gilipollas".split()
REPORTING = frozenset("said says saying called calls call word words term quote quoted quotes quoting wrote writes phrase mot terme dit wort sagte genannt palabra término dijo llamó".split())
ADDRESS = frozenset("you your youre yourself ur u he she they tu toi vous ton votre du dich dir dein sie ihr usted ustedes tú tus".split())
QUOTES = re.compile(r"[\"“”«»„]")
FEATURES = ("exact", "quoted", "fuzzy", "stems", "weighted", "terms", "rate", "aimed", "words")


def budget(term: str) -> int:
    """Edits that a misspelling of the term may have."""
    return 2 if len(term) >= 8 else 1 if len(term) >= 5 else 0


class Automaton:
    """Levenshtein automata of all terms at once, over the lexicon's trie.

    Edits may be anywhere, the first letter included. A stem is found where some beginning of the word is within its
    budget; a find of a whole word goes before that of a stem.
    """

    def __init__(self, words: list[str], stems: list[str]):
        whole, beginnings = set(words), set(stems)
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        self.allowed = [0]
        for term in dict.fromkeys([*words, *stems]):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], budget(term))
            self.allowed[0] = max(self.allowed[0], budget(term))
            if term in whole:
                self.word[node] = term
            if term in beginnings:
                self.stem[node] = term
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        #: (edits, term) of the closest word that ends and of the closest stem that is complete in a state.
        self.ends: list[tuple[int, str] | None] = []
        self.begun: list[tuple[int, str] | None] = []
        self.pairs = 0
        self.start = self._state({(0, 0)})

    def _closest(self, key: frozenset, terms: list[str | None]) -> tuple[int, str] | None:
        return min(((edits, t) for node, edits in key if (t := terms[node]) and edits <= budget(t)), default=None)

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        todo, seen = list(pairs), set(pairs)
        while todo:  # a term's letter may be missing from the word
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.allowed[child] and (child, edits + 1) not in seen:
                    seen.add((child, edits + 1))
                    todo.append((child, edits + 1))
        least: dict[int, int] = {}
        for node, edits in seen:
            least[node] = min(edits, least.get(node, edits))
        key = frozenset(least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.ends.append(self._closest(key, self.word))
            self.begun.append(self._closest(key, self.stem))
            self.pairs += len(key)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            for letter, child in self.children[node].items():
                if letter == c:
                    out.add((child, edits))
                elif edits < self.allowed[child]:
                    out.add((child, edits + 1))
            if edits < self.allowed[node]:  # a letter too many
                out.add((node, edits + 1))
        return self._state(out)

    def match(self, word: str) -> tuple[str, int, bool] | None:
        """(term, edits, whether it is a stem) that the word is closest to, or nothing."""
        if self.pairs > MOST_PAIRS:  # bound what a worker remembers
            self._forget()
        state, stem = self.start, None
        for c in word:
            at = self.steps[state].get(c)
            if at is None:
                at = self.steps[state][c] = self._step(state, c)
            state = at
            if not self.sets[state]:
                break
            if (begun := self.begun[state]) and (stem is None or begun < stem):
                stem = begun
        if end := self.ends[state]:
            return end[1], end[0], False
        return (stem[1], stem[0], True) if stem else None


def find(token: str, auto: Automaton) -> tuple[str, int, bool] | None:
    """The closest match of a token, whose outer signs may be letters or punctuation: idio*, but idiot! as well."""
    forms = {token, token.lstrip(MASKS), token.rstrip(MASKS), token.strip(MASKS)}
    return min(filter(None, map(auto.match, forms)), key=lambda m: (m[2], m[1], m[0]), default=None)


def _terms(text: str) -> set[str]:
    words = {w.strip(MASKS) for w in WORD.findall(text.lower())}
    return words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n}


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """term -> log odds from sample(text, toxic): words, or beginnings written with a star. At most LEARNED_TERMS."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic, clean = Counter(), Counter()
        n = [0, 0]
        for b in batches:
            for text, label in zip(b["text"], b["toxic"], strict=True):
                (toxic if label else clean).update(_terms(text or ""))
                n[bool(label)] += 1
        terms = list({*toxic, *clean})
        yield pd.DataFrame({"term": ["", *terms], "toxic": [n[1], *(toxic[t] for t in terms)], "clean": [n[0], *(clean[t] for t in terms)]})

    sums = sample.select("text", "toxic").mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    whole = sample.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).head()
    t, c = whole["t"] or 0, (whole["n"] or 0) - (whole["t"] or 0)
    if not t or not c:
        return {}
    odds = F.log(((F.col("toxic") + 0.5) / (t + 1)) / ((F.col("clean") + 0.5) / (c + 1)))
    best = sums.where((F.col("term") != "") & (F.col("toxic") >= 4)).withColumn("odds", odds).where("odds > 1.0")
    best = best.withColumn("gain", F.col("toxic") * F.col("odds")).orderBy(F.desc("gain"), F.desc(F.length(F.rtrim("term", F.lit("*")))), "term").limit(20 * LEARNED_TERMS)  # of equal gain the longest
    out: dict[str, float] = {}
    for r in best.collect():
        stem = r["term"].rstrip("*")
        if r["gain"] >= 12 and not any(stem.startswith(x.rstrip("*")) or x.rstrip("*").startswith(stem) for x in out):
            out[r["term"]] = float(min(4.0, r["odds"]))
        if len(out) >= LEARNED_TERMS:
            break
    return out


def text_features(text: str | None, auto: Automaton, weight: dict[str, float], known: dict[str, tuple | None]) -> list[float]:
    """Counts of one text in the order of FEATURES."""
    low = (text or "").lower()
    tokens = WORD.findall(low)
    if len(known) > 500_000:
        known.clear()
    for w in {*tokens}:
        if w not in known:
            known[w] = find(w, auto)
    finds = [i for i, w in enumerate(tokens) if known[w]]
    exact = quoted = fuzzy = stems = aimed = 0.0
    per: Counter = Counter()
    if finds:
        places = [m.start() for m in WORD.finditer(low)]
        marks = np.array([m.start() for m in QUOTES.finditer(low)], np.int64)
        words = [w.strip(MASKS) for w in tokens]
        for i in finds:
            term, edits, stem = known[tokens[i]]
            per[(term, stem)] += 1
            near = words[max(0, i - CONTEXT) : i + CONTEXT + 1]
            left = int(np.searchsorted(marks, places[i]))
            inside = left % 2 == 1 and left < len(marks) and marks[left] - marks[left - 1] < 200
            aimed += bool(ADDRESS.intersection(near))
            if inside or REPORTING.intersection(near):
                quoted += 1
            elif edits:
                fuzzy += 1
            elif stem:
                stems += 1
            else:
                exact += 1
    weighted = sum(weight.get(t + "*" * s, 2.0) * math.log1p(n) for (t, s), n in per.items())
    return [math.log1p(exact), math.log1p(quoted), math.log1p(fuzzy), math.log1p(stems), weighted, float(min(6, len(per))), 10 * math.log1p(len(finds)) / math.sqrt(len(tokens) + 10), math.log1p(aimed), math.log1p(len(tokens)) / 5]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: coefficients (intercept first), means, scales."""
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    b = np.zeros(z.shape[1])
    if len(np.unique(y)) < 2:  # nothing to learn from: every find counts
        b[0], b[1:6] = -2.0, 1.0
        return b, np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge = np.diag([1e-6, *[1.0] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b, mean, scale


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted per row of docs.

    labels(id, toxic) teach only where crc32(id as text) mod 4 isn't 2; null labels are ignored, contradicting labels of
    one id both count, and of documents that share an id the smallest text teaches. Null and empty texts get the model's score for no words. A null id is never held out. Without
    labels of both kinds, fixed weights apply. Repeated rows are answered each; an empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_col]
    held = lambda c: F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))  # pandas rounds longs beside nulls
    train = labels.select(F.col(id_col).alias("id"), (F.col("toxic") > 0).cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & F.col("id").isNotNull() & ~held(F.col("id")))
    rows = train.distinct().orderBy(F.xxhash64("id"), "id", "toxic").limit(SAMPLE_ROWS).collect()  # ids and labels only
    picked = docs.sparkSession.createDataFrame(rows, train.schema)
    sample = slim.join(F.broadcast(picked), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    sample = written(sample, "labelled")  # SAMPLE_ROWS rows at most, read three times
    terms = learn_terms(sample)
    words = sorted({*ABUSIVE, *(t for t in terms if t[-1] != "*")})
    stems = sorted(t[:-1] for t in terms if t[-1] == "*")

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto, known = Automaton(words, stems), {}
        for b in batches:
            x = [text_features(t, auto, terms, known) for t in b["text"]]
            yield pd.DataFrame(x, columns=list(FEATURES)).assign(toxic=b["toxic"].to_numpy())

    fitted = sample.mapInPandas(featured, ", ".join(f"{f} double" for f in FEATURES) + ", toxic int").toPandas()
    model, mean, scale = fit_logistic(fitted[list(FEATURES)].to_numpy(float), fitted["toxic"].to_numpy(float))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        auto, known = Automaton(words, stems), {}
        for b in batches:
            x = np.array([text_features(t, auto, terms, known) for t in b["text"]]).reshape(len(b), len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(model[0] + ((x - mean) / scale) @ model[1:], -30, 30)))
            yield pd.DataFrame({"id": b["id"], "score": p})

    out = texts.mapInPandas(scored, "id string, score double").withColumn("id", F.col("id").cast(kind))
    return out.select("id", held(F.col("id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    found = score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumnRenamed("id", "doc_id")
