"""Operator 8: language of words and documents by a linear-chain CRF.

States are the learned languages.  A word's emission score is the sum of the
weights of its hashed features: the word itself (lexicon), its beginnings and
ends (affixes) and all its character trigrams, however long it is; in scripts
without spaces a word is a whole run of letters.  Weights and the transitions
between neighbouring words are learned together by maximum likelihood, and words
are labelled by forward-backward, in chains of up to ``CHAIN`` words; no message
passes from chain to chain.

A document's language has the highest mean posterior, which is its score.
Null texts and texts without a letter are ``und`` with score 0, as is
everything if no labels can be learned.  Repeated rows get a row each; rows that
repeat a doc_id are learned from once.  Other columns pass; those called like
a result give way to it.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import held_out, powers, table, text_slices, tidied

#: Bound of the labelled sample that is fitted: about so many documents of each language, by hash of their ids.
SAMPLE_PER_LANGUAGE = 250
CHAIN = 64
TABLE_BITS = 17
STEPS = 30
#: Words, and characters of words, whose emissions a task keeps at hand; beyond it starts anew.
MEMO, MEMO_CHARS = 100_000, 2_000_000
#: Characters whose features are made at once, bytes of text and chains that are labelled at once.
SLICE_CHARS, SLICE_BYTES, SLICE_CHAINS = 200_000, 500_000, 1024
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters; none if no character of the text is a letter."""
    found = WORD.findall(text.lower()) if text else []
    # \w also has numerals such as superscripts
    return found if found and (found[0].isalpha() or any(w.isalpha() or any(map(str.isalpha, w)) for w in found)) else []


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int32)


def feature_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features, word after word, and each word's first place among them."""
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(n) - n
    rows, found = [], []

    def add(row, ids):
        rows.append(row)
        found.append(ids)

    with np.errstate(over="ignore"):
        prime = np.uint64(0x100000001B3)
        begin, end = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        for k in range(4):
            row = np.flatnonzero(n > k)
            begin[row] = begin[row] * prime + c[start[row] + k]
            end[row] = end[row] * prime + c[start[row] + n[row] - 1 - k]
            add(row, _mixed(begin[row], 1 + k))
            add(row, _mixed(end[row], 11 + k))
        power, inverse = powers(len(c))
        sums = np.r_[np.uint64(0), np.cumsum((c + np.uint64(1)) * power[: len(c)])]
        add(np.arange(len(n)), _mixed((sums[start + n] - sums[start]) * inverse[start] + n.astype(np.uint64), 21))
        of = np.repeat(np.arange(len(n)), n)
        if len(c) > 2:
            at = np.flatnonzero(of[2:] == of[:-2])
            add(of[at], _mixed((c[at] * prime + c[at + 1]) * prime + c[at + 2], 31))
    rows, found = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(rows, kind="stable")
    return found[order], np.searchsorted(rows[order], np.arange(len(n)))


def emission_scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Summed weights of each word's features, some characters at a time."""
    ends = np.cumsum([len(w) for w in words])
    out, at = [], 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_CHARS, side="right")))
        ids, first = feature_ids(words[at:to])
        out.append(np.add.reduceat(weights[ids], first, axis=0))
        at = to
    return np.concatenate(out).astype(np.float32)


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: each chain's text, first word and number of words."""
    per = -(-lengths // CHAIN)
    text = np.repeat(np.arange(len(lengths)), per)
    k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = np.repeat(np.cumsum(lengths) - lengths, per) + k * CHAIN
    return text, first, np.minimum(lengths[text] - k * CHAIN, CHAIN)


def forward_backward(scores: np.ndarray, size: np.ndarray, moves: np.ndarray):
    """Posteriors [chain, word, state] and expected transition counts; ``scores`` are log emissions."""
    n, length, states = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True)).transpose(1, 0, 2).copy()
    a = np.exp(moves - moves.max())
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[0] = e[0] / e[0].sum(1, keepdims=True)
    for t in range(1, length):
        x = (alpha[t - 1] @ a) * e[t]
        alpha[t] = x / x.sum(1, keepdims=True)
    counts = np.zeros_like(a)
    for t in range(length - 2, -1, -1):
        x = e[t + 1] * beta[t + 1]
        y = x @ a.T
        inside = t + 1 < size
        beta[t] = np.where(inside[:, None], y / y.sum(1, keepdims=True), 1.0)
        z = (alpha[t] * y).sum(1)
        counts += a * ((alpha[t] * (inside / np.maximum(z, 1e-300))[:, None]).T @ x)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    return p.transpose(1, 0, 2), counts


class Labeller:
    def __init__(self, languages: list[str], weights: np.ndarray, moves: np.ndarray):
        self.languages, self.weights, self.moves = languages, weights, moves
        self.known: dict[str, int] = {}
        self.known_chars = 0
        self.emissions = np.zeros((0, len(languages)), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = list({w for w in words if w not in known})
        chars = sum(map(len, new))
        if len(known) + len(new) > MEMO or self.known_chars + chars > MEMO_CHARS:
            known.clear()
            self.emissions, new = self.emissions[:0], list(set(words))
            self.known_chars, chars = 0, sum(map(len, new))
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self.known_chars += chars
            self.emissions = np.concatenate([self.emissions, emission_scores(new, self.weights)])
        return np.array([known[w] for w in words], np.int64)

    def posteriors(self, texts: list[list[str]]):
        """Yields (indices of texts, first words, sizes, posteriors), chains of some texts at a time."""
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = self.ids([w for t in texts for w in t])
        text, first, size = chains(lengths)
        for i in range(0, len(text), SLICE_CHAINS):
            f, s = first[i : i + SLICE_CHAINS], size[i : i + SLICE_CHAINS]
            at = np.minimum(f[:, None] + np.arange(s.max()), len(flat) - 1)
            yield text[i : i + SLICE_CHAINS], f, s, forward_backward(self.emissions[flat[at]], s, self.moves)[0]

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in texts]
        if not self.languages or not any(split):
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        total = np.zeros((len(texts), len(self.languages)))
        for text, _, size, p in self.posteriors(split):
            inside = np.arange(p.shape[1]) < size[:, None]
            np.add.at(total, text, (p * inside[:, :, None]).sum(1))
        mean = total / np.maximum(1, np.array([len(t) for t in split]))[:, None]
        best = mean.argmax(1)
        return [self.languages[b] if t else UNKNOWN for b, t in zip(best, split)], [float(min(1.0, mean[i, b])) if t else 0.0 for i, (b, t) in enumerate(zip(best, split))]

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(language, first word, words) of runs of one language: the parts of a code-switched text."""
        words = words_of(text)
        if not words or not self.languages:
            return []
        labels = np.concatenate([p[k, : size[k]].argmax(1) for _, _, size, p in self.posteriors([words]) for k in range(len(size))])
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
        return [(self.languages[labels[a]], a, b - a) for a, b in zip(cuts, cuts[1:])]


def train(texts: list[str], labels: list[str], steps: int = STEPS, penalty: float = 1e-6) -> Labeller:
    """Fits weights and transitions by Adam on the likelihood of the documents' labels for all their words."""
    languages = sorted(set(labels))
    states = len(languages)
    split = [words_of(t) for t in texts]
    split, y = [s for s in split if s], np.array([languages.index(v) for s, v in zip(split, labels) if s])
    if not split:
        return Labeller([], np.zeros((1 << TABLE_BITS, 0), np.float32), np.zeros((0, 0)))
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for s in split for w in s], np.int64)
    features, begins = feature_ids(list(ids))
    per_word = np.diff(np.r_[begins, len(features)])
    text, first, size = chains(np.array([len(s) for s in split], np.int64))
    at = np.minimum(first[:, None] + np.arange(CHAIN), len(flat) - 1)
    inside = np.arange(CHAIN) < size[:, None]
    target = np.eye(states)[y[text]]
    seen = np.zeros((states, states))
    np.add.at(seen, (y[text], y[text]), size - 1)
    weights, moves = np.zeros((1 << TABLE_BITS, states), np.float32), np.zeros((states, states))
    state = [[np.zeros_like(weights), np.zeros_like(weights)], [np.zeros_like(moves), np.zeros_like(moves)]]
    for step in range(1, steps + 1):
        emissions = np.add.reduceat(weights[features], begins, axis=0)
        by_word, expected = np.zeros((len(ids), states)), np.zeros_like(moves)
        for i in range(0, len(text), 4096):
            part = slice(i, i + 4096)
            p, counts = forward_backward(emissions[flat[at[part]]], size[part], moves)
            expected += counts
            error = ((target[part][:, None, :] - p) * inside[part][:, :, None]).reshape(-1, states)
            where = flat[at[part]].ravel()
            for k in range(states):
                by_word[:, k] += np.bincount(where, error[:, k], len(ids))
        g = np.stack([np.bincount(features, np.repeat(by_word[:, k], per_word), 1 << TABLE_BITS) for k in range(states)], 1) / len(flat)
        g -= penalty * weights
        for x, grad, (m, v) in ((weights, g, state[0]), (moves, (seen - expected) / len(flat) - 1e-3 * moves, state[1])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x += (0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(x.dtype)
    return Labeller(languages, weights, moves)


def labelled_sample(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Whole texts and languages of about SAMPLE_PER_LANGUAGE documents of each language that are not held out."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return [], []
    unit = 1 << 30
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id"), F.lit(unit)) < int(unit * min(1.0, SAMPLE_PER_LANGUAGE / n))))
    # rows that repeat a doc_id count once, so the ids bound the sample
    rows = usable.filter(keep).groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("x")).select("x.*").collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def fit(docs: DataFrame) -> Labeller:
    return train(*labelled_sample(docs))


def _sent(spark, labeller: Labeller):
    """The model as a broadcast of plain arrays, at most 2^TABLE_BITS weights a language."""
    return spark.sparkContext.broadcast((labeller.languages, labeller.weights, labeller.moves))


@tidied
def _predicted(batches, model):
    labeller = Labeller(*model.value)
    for batch in batches:
        for at, texts in text_slices(batch, chars=SLICE_BYTES):
            languages, scores = labeller.documents(texts)
            rest = batch.slice(at, len(texts)).columns
            yield pa.RecordBatch.from_arrays([*rest, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, labeller: Labeller, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns of ``keep`` with language and score, called ``names``; of equal names the results stay."""
    keep = [c for c in dict.fromkeys(keep) if c not in names]
    columns = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)]
    kinds = "".join(f"_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = docs.select(*columns, "text").mapInArrow(partial(_predicted, model=_sent(docs.sparkSession, labeller)), f"{kinds}text string, lang_pred string, score double")
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))


def _spans(batches, model):
    labeller = Labeller(*model.value)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
    for batch in batches:
        spans = [[dict(zip(("lang", "first_word", "n_words"), s)) for s in labeller.spans(t)] for _, texts in text_slices(batch) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])


def label_spans(docs: DataFrame, labeller: Labeller) -> DataFrame:
    """doc_id and the runs of words of one language: the parts of code-switched texts."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_spans, model=_sent(docs.sparkSession, labeller)), f"doc_id {kind}, spans array<struct<lang:string,first_word:bigint,n_words:bigint>>")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
