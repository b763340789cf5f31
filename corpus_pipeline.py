"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing and packing, each on its predecessor's rows."""

from __future__ import annotations

from gneiss.llm import jaccard, langid, lines, mixing, packing
from gneiss.llm.common import Scratch


def language_id(spark, docs, sf_dir):
    """Documents that are not rejected."""
    return langid.keep_recognised(docs)


def line_dedup(spark, docs, sf_dir):
    """All documents, without lines whose template recurs across documents."""
    return lines.drop_templates(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of linked documents."""
    return jaccard.keep_one(docs)


def mix(spark, docs, sf_dir):
    """Documents as often as the mix takes them."""
    return mixing.emit(docs)


def pack(spark, docs, sf_dir):
    """Pieces of all documents in sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """STAGES applied to documents; each stage's rows are written and read again."""
    scratch, docs = Scratch(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, f"{k}_{name}")
    return docs
