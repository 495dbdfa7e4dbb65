"""From raw documents to a training mix, stage by stage.

Each stage takes all that its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strataflow.llm import decontamination, jaccard_join, language, mixing, substring_dedup
from strataflow.llm.common import fresh, stored, table

#: Documents whose best language has a lower mean posterior are rejected, as are those without a letter.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark, docs, sf_dir):
    """Rejects documents of no certain language; ``lang`` becomes the predicted one."""
    predicted, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = language.identify(docs, language.fit(docs), tuple(docs.columns), (predicted, score))
    kept = found.filter((F.col(predicted) != language.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col(predicted)).select(docs.columns)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays."""
    return jaccard_join.one_of_each_group(docs, width=5, percent=80)


def drop_repeated_spans(spark, docs, sf_dir):
    """Repeated passages leave the texts; documents of which nothing is left go."""
    names = tuple(fresh(c, docs.columns) for c in ("n_sentences", "n_removed", "words_removed"))
    cleaned = substring_dedup.remove_repeated_spans(docs, names=names)
    removed = F.col(names[1])
    cleaned = cleaned.filter((removed == 0) | (removed < F.col(names[0])))
    return cleaned.withColumn("n_chars", F.when(removed > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_benchmark_leaks(spark, docs, sf_dir):
    """Documents that contain a test item go."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Words that the training mix takes of each document."""
    return mixing.mix_sources(docs)[0]


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeated_spans),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix),
]

#: SQL expresses neither the language model nor the draws of the mix.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
    return docs
