"""The corpus pipeline: STAGES in order, each written as Parquet and reread as the next one's documents.

Defined cases, for every stage: all columns stay, whatever their names, up to packing, which returns its pieces; an empty table
stays empty; a null text is an empty one, which the quality rules reject (under 20 words); rows with null ids are judged by
their own text and are no near duplicates of any; rows of a repeated id are judged each by its own text, and of rows that
repeat as a whole one is left after near_dedup; very long texts take part whole. Of equal candidates the row of the
least id, then of the least hash of id and text, stays.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from mnemospark.llm.common import materialize, table
from mnemospark.llm.decontaminate import decontaminate_stage
from mnemospark.llm.near_dedup import STAGE_PERCENT, dedup_stage
from mnemospark.llm.packing import packing_stage
from mnemospark.llm.quality_classifier import classifier_stage
from mnemospark.llm.quality_rules import quality_stage

STAGES = [
    ("quality_rules", quality_stage),
    ("quality_classifier", classifier_stage),
    ("near_dedup", partial(dedup_stage, percent=STAGE_PERCENT)),
    ("decontamination", decontaminate_stage),
    ("packing", packing_stage),
]

#: Robust estimates and trained models are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
