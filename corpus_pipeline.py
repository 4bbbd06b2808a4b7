"""A training-corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
in the cluster's shared folder and reads it again for the next stage.  All but the last return the
columns of documents.  The stages count over all rows that their predecessor kept.
"""

from __future__ import annotations

from tessera.llm import bpe, exact_dedup, mixing, quality, simhash
from tessera.llm.contract import vocabulary
from tessera.llm.shared import Scratch


def quality_classifier(spark, docs, sf_dir):
    """Documents that the weakly supervised scorer rejects go."""
    return quality.filter_docs(docs, quality.fit(docs))


def exact_duplicates(spark, docs, sf_dir):
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.dedup(docs, keep="min")


def near_duplicates(spark, docs, sf_dir):
    """Of documents that share 0.8 or more of their five-word shingles one stays.

    SimHash fingerprints are linked by the grid range-join and checked exactly; a join of shingles
    then finds those whose fingerprints are too far apart.
    """
    return simhash.dedup(docs)


def mixture(spark, docs, sf_dir):
    """Documents as often as the mixture of sources has them."""
    return mixing.mix(docs)


def tokens(spark, docs, sf_dir):
    """Ids and decoded text of each document, as digests."""
    return bpe.encoded(docs, vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixture),
    ("bpe", tokens),
]

#: SQL can express neither the classifier nor fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows for the documents in sf_dir."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
