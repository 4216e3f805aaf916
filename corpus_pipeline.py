"""From raw documents to packed sequences.

Each stage reads all that its predecessor kept and returns the columns of ``documents``, the last one the pieces of
the packed sequences with their token ids.
"""

from __future__ import annotations

import public_tokenizers

from dataprobe.llm import decontam, linealign, nearcopies, packing, quality
from dataprobe.llm.registry import table
from dataprobe.scratch import materialise


def judge_quality(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark, docs, sf_dir):
    """Line blocks that earlier documents hold go; every document stays, if with an empty text."""
    return linealign.dedup(docs, length="n_chars", whole=True)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return nearcopies.keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold benchmark passages go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """Sequences of at most 4096 tokens: one row per piece with its ids and place."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES = [
    ("quality classifier", judge_quality),
    ("line dedup", dedup_lines),
    ("near-dedup", drop_near_copies),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: the classifier's fit, the alignments and the tokenizer cannot be said in SQL
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
