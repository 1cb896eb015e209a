"""The corpus pipeline: documents in, sharded training documents out.

Stages, in order: language ID (documents it rejects go), SimHash near-dedup
(one document of each group stays), benchmark decontamination (documents that
hold a benchmark item go), mixing sources to target weights (rows are laid out
in the order of the mix), sharding (shard of every document, and its slot
there, in the order of the mix). Every stage reads the Parquet its predecessor
wrote.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import fresh, stage, table
from sluice.session import configure


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the model accepts; learn from rows that are not held out."""
    from sluice.llm.langid import detect_language, held_out, train_language_model
    model = train_language_model(docs, learn=~held_out())
    pred, score, accepted = fresh(docs, "pred", "score", "accepted")
    return detect_language(docs, model, pred=pred, score=score, accepted=accepted).filter(accepted).drop(pred, score, accepted)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group (3-word shingles, at most 3 differing bits)."""
    from sluice.llm.simhash import keep_representatives
    return keep_representatives(docs, shingle=3, distance=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item (5-word shingles, containment under 0.8)."""
    from sluice.llm.decontam import remove_contaminated
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of a mix of the sources by the square roots of their sizes."""
    from sluice.llm.mixing import in_mix_order
    return in_mix_order(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with its shard of eight and its slot there; the slots of a shard follow the mix of the sources.

    No column passes the order on and a shuffle loses it, so it is worked out again from the same rows."""
    from sluice.llm.mixing import MAX_SOURCES, mix
    from sluice.llm.sharding import shard, topology
    block, release, deadline, at, place, size, crc, law, grown = fresh(docs, "block", "release", "deadline", "at", "place", "size", "crc", "law", "grown")
    rows, block_rows = docs.count(), 8
    mixed = mix(docs, block_rows=block_rows, block=block, release=release, deadline=deadline, slot=at, place=place)
    out = shard(mixed, topology(8), rows, names=(size, crc, law, "shard", "slot", grown), carry=[c for c in docs.columns if c.lower() not in ("shard", "slot")],
                position=F.col(at) * block_rows + F.col(place), positions=rows + MAX_SOURCES * block_rows)    # a source's last block may be short
    return out.drop(size, crc, law, grown)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mix_sources", mix_sources),
    ("sharding", shards),
]

#: The stages apply a trained model and graph components, which SQL can't express; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each is written and read again before the next."""
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
