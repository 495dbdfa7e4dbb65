"""Operator 7: token counts through a digest cache.

A count is stored under the SHA-256 of the content and the digest of the
tokenizer's file.  Each run joins the digests of its texts to the stored
counts, encodes one text for each digest that is missing, and appends these.

Null texts count as empty (0 tokens); repeated texts are encoded once; very
long texts are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import new_path, stored, table

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
#: Words whose counts a task keeps at hand; beyond it starts anew.
MEMO = 200_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Token counts of a sentencepiece model.

    If no piece joins a word's end to a following space mark, no merge crosses a
    space, and a text's count is the sum over its space-separated words, each
    with the mark that the model puts before it.  Texts for which this doesn't
    hold (doubled or outer spaces, the mark itself) are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        apart = not any("▁" in p.lstrip("▁") for p in pieces)
        alike = self.model.encode("a b", out_type=str) == self.model.encode("a", out_type=str) + self.model.encode("b", out_type=str)
        self.by_word = apart and alike and self.model.encode(" a") != self.model.encode("a")
        self.known: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.model.encode(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_word or "  " in text or text[0] == " " or text[-1] == " " or "▁" in text:
            return self.whole(text)
        known, words = self.known, text.split(" ")
        try:
            return sum([known[w] for w in words])
        except KeyError:
            new = list({w for w in words if w not in known})
            if len(known) + len(new) > MEMO:
                known.clear()
                new = list(set(words))
            known.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
            return sum([known[w] for w in words])


class BpeCounter:
    """Token counts of a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, text: str | None) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids) if text else 0


def counter(path: str):
    return PieceCounter(path) if path.endswith(".model") else BpeCounter(path)


def _encode(batches, path: str):
    made = counter(path)
    for batch in batches:
        counts = [made.count(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])


def count_tokens(docs: DataFrame, path: str | None = None, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; appends to the table at ``cache`` (None: one for this run)."""
    spark = docs.sparkSession
    path = path or tokenizer_path()
    with open(path, "rb") as f:  # the tokenizer is part of the installation, on the driver as on executors
        version = hashlib.sha256(f.read()).hexdigest()
    cache = cache or new_path(spark, "token-counts")
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("digest"))
    schema = "digest string, n_tokens long, version string"

    def stored_counts():
        # two runs at once may have stored the same digest
        return spark.read.schema(schema).parquet(cache).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    spark.createDataFrame([], schema).write.mode("append").parquet(cache)
    missing = keyed.groupBy("digest").agg(F.first("text").alias("text")).join(stored_counts(), "digest", "left_anti")
    made = missing.select("digest", "text").mapInArrow(partial(_encode, path=path), "digest string, n_tokens long")
    made.withColumn("version", F.lit(version)).write.mode("append").parquet(cache)
    sizes = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("digest"))
    # plain tables on both sides: a digest that many rows have is split
    out = sizes.join(stored(stored_counts(), "token-counts-now"), "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
