"""Operator 4: substring deduplication by sliding spans of sentences.

Sentences end at . ! ? or a line break, and are cut further after the words of
the lowest hash in any ``WINDOW`` words without such an end; that includes short
ones.  A cut is thus decided by the fewer than ``WINDOW`` words on each side and
the next is at most ``WINDOW`` words away, so equal passages are cut alike but
for their edges, whatever surrounds them.  From every piece a span runs over at
least ``SENTENCES`` of them and ``WORDS`` words; with 3, 20 and a window of 8, any
equal 51 words have a span in common.  All spans are hashed and joined globally;
the first document of a span keeps it, and pieces that any other occurrence
covers are removed.  Chunks of documents find their own copies before spans are
sent, so of a span that many documents have one row a chunk meets the others.

The first document is the one with the smallest doc_id, in it the first place.
Rows that repeat a doc_id count as one document; rows without one stay as they
are and claim no span.  Other columns pass; of equal names the counts stay.  Null and empty texts, and texts of fewer words than a
span, stay as they are.  The case of A-Z and the kind of white space don't matter.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.llm.common import ByteWords, array_slices, arrow_batches, forget, powers, stored, table, tidied

SENTENCES = 3
WORDS = 20
WINDOW = 8
#: Spans among which a task looks for copies before they are sent.
CHUNK = 250_000
#: Bytes of the batches between Spark and Python, and of text whose words are found at once.  Buffers for
#: all the text of a task lie outside the executor's heap, and much of them stays there once they are free.
BATCH_BYTES, SLICE_BYTES = 2_000_000, 500_000

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def _over(x: np.ndarray, f) -> np.ndarray:
    """``f`` over each ``WINDOW`` neighbours, by doubling."""
    k = 1
    while k < WINDOW:
        step = min(k, WINDOW - k)
        x = f(x[:-step], x[step:])
        k += step
    return x


def lowest_in_a_window(key: np.ndarray) -> np.ndarray:
    """Whether a key is the lowest of any ``WINDOW`` neighbours; all of them where keys are equal."""
    if len(key) < WINDOW:
        return np.zeros(len(key), bool)
    edge = np.zeros(WINDOW - 1, key.dtype)
    return _over(np.r_[edge, _over(key, np.minimum), edge], np.maximum) == key


class Sentences:
    """Sentence limits and span hashes of an array of texts."""

    def __init__(self, texts, sentences: int, words: int):
        self.words, self.sentences, self.least = ByteWords(texts), sentences, words
        w = self.words
        lines = np.r_[0, np.cumsum(w.data == 10)]
        gap = np.r_[w.start[1:], len(w.data)] if len(w.start) else w.start
        self.ends = (_ENDS[w.data[w.end - 1]] | (lines[gap] > lines[w.end])) if len(w.start) else np.zeros(0, bool)

    def of(self, i: int):
        """(first word of each sentence and the end, first sentence of each span, its end, hash, second hash)."""
        a, b = self.words.first[i], self.words.first[i + 1]
        n = int(b - a)
        if n < self.least:
            none = np.zeros(0, np.int64)
            return np.array([0, n]) if n else np.array([0]), none, none, none, none
        h, end = self.words.hash[a:b], self.ends[a:b].copy()
        end[-1] = True
        # the end of the text is no end of a sentence: it would tell a passage at the end from others
        key = np.where(self.ends[a:b], np.uint64(0), (h >> np.uint64(1)) + np.uint64(1))
        limits = np.r_[0, np.flatnonzero(end | lowest_in_a_window(key)) + 1]
        first = np.arange(len(limits) - 1)
        last = np.maximum(first + self.sentences, np.searchsorted(limits, limits[:-1] + self.least))
        inside = last < len(limits)
        first, last = first[inside], last[inside]
        power, inverse = powers(n)
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum(h * power[:n])]
            twos = np.r_[np.uint64(0), np.cumsum((h >> np.uint64(17) ^ h << np.uint64(31)) * power[:n])]
            x, y = limits[first], limits[last]
            one = ((sums[y] - sums[x]) * inverse[x]) ^ (y - x).astype(np.uint64)
            two = (twos[y] - twos[x]) * inverse[x]
        return limits, first, last, one.view(np.int64), (two >> np.uint64(32)).astype(np.int64)

    def kept(self, i: int, limits: np.ndarray, gone: np.ndarray) -> str:
        """The text without the sentences ``gone``; white space before the first word goes with them."""
        at = np.r_[self.words.start[self.words.first[i] : self.words.first[i + 1]], self.words.offsets[i + 1]][limits]
        keep = np.r_[False, ~gone, False]
        a, b = np.flatnonzero(keep[1:] & ~keep[:-1]), np.flatnonzero(keep[:-1] & ~keep[1:])
        return b"".join(self.words.data[at[x] : at[y]].tobytes() for x, y in zip(a, b)).decode("utf-8", "replace")


def _told(h1: np.ndarray, h2: np.ndarray, row: np.ndarray, ids, rank: np.ndarray) -> pa.RecordBatch:
    """The spans of a chunk; ``later`` is the row of those that a smaller doc_id of the chunk has too."""
    order = np.lexsort((rank[row], h2, h1))
    h1, h2, row = h1[order], h2[order], row[order]
    start = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])][: len(row)]
    later = rank[row] > rank[row[start]][np.cumsum(start) - 1]
    keep = start | later
    row, later = row[keep], later[keep]
    return pa.RecordBatch.from_arrays([pa.array(h1[keep]), pa.array(h2[keep]), ids.take(pa.array(row)), pa.array(row, mask=~later)], ["h1", "h2", "doc_id", "later"])


@tidied
def _span_rows(batches, sentences: int, words: int):
    held, ids, size, n = [], [], 0, 0

    def told():
        known = pa.concat_arrays(ids)
        rank = pc.rank(known, tiebreaker="dense").to_numpy().astype(np.int64)
        rows = _told(*map(np.concatenate, zip(*held)), known, rank)
        for k in range(0, rows.num_rows, BATCH_BYTES // 32):
            yield rows.slice(k, BATCH_BYTES // 32)

    for batch in batches:
        for at, texts in array_slices(batch, size=SLICE_BYTES):
            made = Sentences(texts, sentences, words)
            found = []
            for i in range(len(texts)):
                *_, one, two = made.of(i)
                if len(one):
                    one, where = np.unique(one, return_index=True)
                    held.append((one, two[where], np.full(len(one), n)))
                    found.append(at + i)
                    size += len(one)
                    n += 1
            if found:
                ids.append(batch.column("doc_id").take(pa.array(found)))
            if size >= CHUNK:
                yield from told()
                held, ids, size, n = [], [], 0, 0
    if size:
        yield from told()


def span_rows(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """h1, h2, doc_id, later: each span of a document once; ``later`` is a number where the document is known not to be its first."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(partial(_span_rows, sentences=sentences, words=words), f"h1 long, h2 long, doc_id {kind}, later long")


@tidied
def _cleaned(batches, sentences: int, words: int):
    for batch in batches:
        rest = [n for n in batch.schema.names if n not in ("text", "_repeated", "_known")]
        lists, known = batch.column("_repeated"), batch.column("_known").to_pylist()
        for at, part in array_slices(batch, size=SLICE_BYTES):
            made = Sentences(part, sentences, words)
            changed, n_sentences, n_removed, words_removed = {}, [], [], []
            for i in range(len(part)):
                limits, first, last, one, _ = made.of(i)
                gone = np.zeros(len(limits) - 1, bool)
                if len(one) and known[at + i]:
                    again = np.ones(len(one), bool)
                    again[np.unique(one, return_index=True)[1]] = False
                    if lists[at + i].is_valid:
                        again |= np.isin(one, lists[at + i].values.to_numpy())
                    if again.any():
                        marks = np.zeros(len(limits), np.int64)
                        np.add.at(marks, first[again], 1)
                        np.add.at(marks, last[again], -1)
                        gone = np.cumsum(marks)[:-1] > 0
                        changed[i] = made.kept(i, limits, gone)
                n_sentences.append(len(gone))
                n_removed.append(int(gone.sum()))
                words_removed.append(int(np.diff(limits)[gone].sum()))
            rows = batch.slice(at, len(part))
            texts = rows.column("text")
            if changed:
                texts = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], pa.string())
            columns = [rows.column(n) for n in rest]
            yield pa.RecordBatch.from_arrays([*columns, texts, *(pa.array(x, pa.int64()) for x in (n_sentences, n_removed, words_removed))], [*rest, "text", "n_sentences", "n_removed", "words_removed"])


def remove_repeated_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, names: tuple[str, str, str] = ("n_sentences", "n_removed", "words_removed")) -> DataFrame:
    """The documents with repeated sentences removed from ``text``, and the numbers of sentences, removed sentences and removed words, called ``names``."""
    # one shuffle of the spans tells each its first document; nulls have gone.  Only the smallest doc_id of each
    # chunk meets those of other chunks, the rest is dealt by its number too: no key gathers the rows of a frequent span
    first = F.min("doc_id").over(Window.partitionBy("h1", "h2", "later"))
    later = span_rows(docs, sentences, words).withColumn("_first", first).filter(F.col("later").isNotNull() | (F.col("doc_id") != F.col("_first")))
    by_doc = later.groupBy("doc_id").agg(F.collect_set("h1").alias("_repeated"))
    # both results are stored, as the bound of the batches holds only for what runs here
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        by_doc = stored(by_doc, "repeated-spans")
    void = [c for c in docs.columns if docs.schema[c].dataType.typeName() == "void"]
    rest = [c for c in docs.columns if c not in ("doc_id", "text", *names, *void)]
    kept = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)])
    out = kept.join(by_doc, "doc_id", "left").withColumn("_known", F.col("doc_id").isNotNull())
    out = out.select("doc_id", *[f"_{i}" for i in range(len(rest))], "text", "_repeated", "_known")
    kinds = "".join(f", _{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest))
    cleaned = out.mapInArrow(partial(_cleaned, sentences=sentences, words=words), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}{kinds}, text string, n_sentences long, n_removed long, words_removed long")
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        cleaned = stored(cleaned, "cleaned-texts")
    forget(by_doc)
    back = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.lit(None).alias(c) for c in void if c not in names} | {c: F.col(f"_{i}").alias(c) for i, c in enumerate(rest)}
    return cleaned.select(*[back[c] for c in docs.columns if c in back], *[F.col(a).alias(b) for a, b in zip(("n_sentences", "n_removed", "words_removed"), names)])


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
