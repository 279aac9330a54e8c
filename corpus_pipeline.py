"""A corpus pipeline: language identification, exact de-duplication, near-de-duplication, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All but
the last return the columns of ``docs``. Rows whose id is null are kept by every stage that decides by id; a repeated id goes
only if all its rows are rejected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import langid
from tidewell.llm.exact_dedup import exact_dedup
from tidewell.llm.jaccard_join import jaccard_components
from tidewell.llm.packing import best_fit_pack
from tidewell.llm.scratch import ship, stored, table


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs`` without the ids none of whose rows in ``decided`` (doc_id, kept) is kept; only ids are hashed, texts are not sorted.

    Rows with a null id find no partner, so they are spread over all tasks.
    """
    gone = decided.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id", F.lit(0).alias("_spread"))
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1000)).cast("int")).otherwise(0)
    return docs.withColumn("_spread", spread).join(gone.hint("shuffle_hash"), ["doc_id", "_spread"], "left_anti").select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those that are ``und`` or whose two nearest codewords are as near go."""
    ship(spark)
    model = langid.fit(docs)
    at = docs.columns.index("text")

    def kept(batches):
        judge = langid._predicted(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text = part.column(at).cast(pa.string())
                for answer in judge([pa.record_batch([text, text], ["id", "text"])]):
                    lang, unsure = answer.column("lang_pred").to_pylist(), answer.column("ambiguous").to_pylist()
                    yield part.filter(pa.array([k != langid.UNKNOWN and not u for k, u in zip(lang, unsure, strict=True)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _without(docs, exact_dedup(docs).select("doc_id", "kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links of similarity 0.8 or more over five-word shingles."""
    found = jaccard_components(docs, width=5, num=80, den=100)
    return _without(docs, found.select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("kept")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of the remaining documents lies in which sequence."""
    return best_fit_pack(docs)


STAGES = [("language_id", language_id), ("exact_copies", exact_copies), ("near_copies", near_copies), ("packing", packing)]

#: SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
