"""From raw documents to packed training sequences, one operator a stage; each stage works on all that the last one kept."""

from __future__ import annotations

import public_tokenizers

from packetloom.llm import boosted_rules, minhash, packing, resampling, secrets
from packetloom.llm.shared import ready, table
from packetloom.session import new_path

ORACLE_SQL = None


def quality_rules(spark, docs, sf_dir):
    """Documents that the hard limits or the trees reject go."""
    return boosted_rules.keep_good(docs, table(ready(spark), sf_dir, "labels"))


def quality_classifier(spark, docs, sf_dir):
    """Documents that the resampling leaves out go."""
    return resampling.keep_sampled(docs, table(ready(spark), sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """Of documents linked by five-word shingles and a similarity of 0.8 or more one stays."""
    ready(spark)
    return minhash.keep_one(docs)


def secret_scan(spark, docs, sf_dir):
    """Secrets are masked in the texts; documents stay."""
    ready(spark)
    return secrets.mask_secrets(docs)


def packing_stage(spark, docs, sf_dir):
    """One row per token piece with its place in a training sequence."""
    ready(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_dedup", near_dedup),
    ("secret_scan", secret_scan), ("packing", packing_stage),
]


def run(spark, sf_dir):
    """All stages over the documents, each stage's rows written and read again."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
