"""Operator 1: toxicity by a weighted lexicon and Aho-Corasick.

Texts are folded (case, homoglyphs, digits for letters, i/l look-alikes) and
matched against lexicon terms: whole words and word beginnings, weighted by
their log-odds in the labelled sample.  Matches of exception phrases take their
terms' weight back.  The summed weight and the weight per word go through a
logistic curve fitted on the same sample.

Null, empty and blank texts score like texts without a match.  Repeated rows
get a row each; documents are scored whole; without positive labels all scores
are 0; if a doc_id has several labels, toxic wins.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import held_out, table, text_slices

#: Bound of the labelled sample that is fitted: documents of each label, by hash order of their ids.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
#: Phrases that use a term harmlessly.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "scum line", "idiot proof", "stupid simple")

# Characters that look like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ɡ": "g", "ɑ": "a", "ı": "i", "ⅼ": "l",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "!": "i"}


def _folding() -> dict[int, str | None]:
    fold: dict[int, str | None] = {}
    for code in range(128):
        c = chr(code)
        fold[code] = c.lower() if c.isalpha() else DIGITS.get(c, " ")
    fold |= {ord(k): v for k, v in HOMOGLYPHS.items()}
    fold |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}  # full width
    fold |= {start + i: chr(97 + i % 26) for start in range(0x1D400, 0x1D6A4, 52) for i in range(52)}  # mathematical letters
    fold |= dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD))  # invisible
    fold |= {k: "i" for k, v in list(fold.items()) if v == "l"}
    return fold


FOLDING = _folding()
_ASCII = "".join(FOLDING[i] for i in range(128)).encode().ljust(256, b" ")


def fold(text: str | None) -> str:
    """Folded words with a space between any two and at both ends, whatever stood between them."""
    if not text:
        return " "
    folded = text.encode().translate(_ASCII).decode() if text.isascii() else text.lower().translate(FOLDING)
    return f" {' '.join(folded.split())} "


def terms(word: str):
    """Lexicon entries that a folded word matches: itself and its beginnings."""
    yield f" {word} "
    for n in (4, 5, 6):
        if len(word) > n:
            yield f" {word[:n]}"


def families(texts: list[str], sketch: int = 6) -> list[int]:
    """A number for each text; texts that share two of their least three-word shingle digests share it."""
    found: dict[int, int] = {}
    out = []
    for i, text in enumerate(texts):
        ws = text.split()
        least = sorted({zlib.crc32(" ".join(ws[k : k + 3]).encode()) for k in range(max(1, len(ws) - 2))})[:sketch]
        known = Counter(found[h] for h in least if h in found)
        family = known.most_common(1)[0][0] if known and known.most_common(1)[0][1] >= min(2, len(least)) else i
        found |= {h: family for h in least if h not in found}
        out.append(family)
    return out


def learn_lexicon(toxic: list[str], clean: list[str], least: int = 3, odds: float = 2.5, evidence: float = 27.0) -> dict[str, float]:
    """Weights (log-odds) of the terms that mark toxic texts.

    Families of copies count once.  A term enters by its log-likelihood ratio;
    for toxic texts that hold no such term, the terms that most of them share
    enter one by one.
    """
    def sets(texts):
        folded = [fold(x) for x in dict.fromkeys(texts)]
        groups = defaultdict(set)
        for family, x in zip(families(folded), folded):
            groups[family] |= {t for w in set(x.split()) if len(w) > 2 for t in terms(w)}
        return list(groups.values())

    bad, good_sets = sets(toxic), sets(clean)
    good = Counter(t for s in good_sets for t in s)
    p, n = len(bad), len(good_sets)
    where = defaultdict(set)
    for i, s in enumerate(bad):
        for t in s:
            where[t].add(i)
    where = {t: d for t, d in where.items() if len(d) >= least}
    weight = {t: math.log((len(d) + 0.5) / (p + 1)) - math.log((good[t] + 0.5) / (n + 1)) for t, d in where.items()}
    where = {t: d for t, d in where.items() if weight[t] >= odds}

    def ratio(t):
        a, b = len(where[t]), good[t]
        share = (a + b) / (p + n)
        return 2 * (a * math.log(a / (p * share)) + (b * math.log(b / (n * share)) if b else 0))

    chosen = {t: weight[t] for t in where if ratio(t) >= evidence}
    covered = set().union(*(where[t] for t in chosen))
    left = {t: d for t, d in where.items() if t not in chosen and len(d - covered) >= least}
    while left:
        gain = lambda t: (len(left[t] - covered) - 2 * good[t], len(left[t]), t)
        best = max(left, key=gain)
        if gain(best)[0] < least:
            break
        chosen[best] = weight[best]
        covered |= left.pop(best)
        left = {t: d for t, d in left.items() if len(d - covered) >= least}
    return chosen


class Scorer:
    """Lexicon and curve; picklable, the automaton is built where it is used."""

    def __init__(self, lexicon: dict[str, float], curve=(0.0, 1.0, 1.0), exceptions=EXCEPTIONS):
        self.lexicon, self.curve, self.exceptions = lexicon, curve, exceptions
        self.automaton = None

    def __getstate__(self):
        return {**self.__dict__, "automaton": None}

    def build(self):
        import ahocorasick

        weights = dict(self.lexicon)
        for phrase in [p + s for p in self.exceptions for s in ("", "s", "es")]:  # with their plurals
            text = fold(phrase)
            # an exception takes back what its words add
            if (held := sum(self.lexicon.get(t, 0) for w in text.split() for t in terms(w))) > 0:
                weights[text] = weights.get(text, 0) - held
        self.automaton = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.automaton.add_word(term, weight)
        if weights:
            self.automaton.make_automaton()
        return self

    def weigh(self, text: str | None) -> tuple[float, float]:
        """Summed weight, and weight per word."""
        if self.automaton is None:
            self.build()
        folded = fold(text)
        total = max(0.0, sum(w for _, w in self.automaton.iter(folded))) if self.lexicon else 0.0
        return total, total / (folded.count(" ") + 20)

    def scores(self, texts) -> list[float]:
        if not self.lexicon:
            return [0.0] * len(texts)
        x = features([self.weigh(t) for t in texts])
        return (1 / (1 + np.exp(-np.clip(x @ np.asarray(self.curve), -30, 30)))).tolist()


def features(weighed) -> np.ndarray:
    w = np.asarray(weighed, float).reshape(-1, 2)
    return np.column_stack([np.ones(len(w)), np.log1p(w[:, 0]), np.log1p(100 * w[:, 1])])


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; coefficients of evidence stay positive."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(b))
        b = b + np.linalg.solve(h, x.T @ (y - p) - penalty * b)
    return np.r_[b[0], np.maximum(b[1:], 1e-3)]


def fit(toxic: list[str], clean: list[str]) -> Scorer:
    lexicon = learn_lexicon(toxic, clean)
    scorer = Scorer(lexicon).build()
    if lexicon:
        x = features([scorer.weigh(t) for t in [*toxic, *clean]])
        y = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
        scorer.curve = tuple(fit_curve(x, y).tolist())
    return scorer


def labelled_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[str]]:
    """Texts of at most SAMPLE_TOXIC toxic and SAMPLE_CLEAN other documents that are not held out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.unionByName(part)
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN ids
    # rows that repeat a doc_id count once
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect()
    return [r["text"] or "" for r in rows if r["toxic"] == 1], [r["text"] or "" for r in rows if r["toxic"] == 0]


def _scored(batches, scorer: Scorer):
    for batch in batches:
        scores = [s for _, texts in text_slices(batch) for s in scorer.scores(texts)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])


def score_toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_scored, scorer=scorer), f"doc_id {kind}, score double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(*labelled_sample(docs, table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
