"""Score arriving requests with a contract check and a reject path (K2).

``readStream`` -> ``validate_contract`` -> ``PipelineModel.transform`` ->
``writeStream``.  One ``foreachBatch`` writes accepted (scored) rows and
rejected rows (with their violations) to two tables, each batch into its own
``epoch=<id>`` partition with overwrite: a batch that is replayed after a
failure, also one between the two writes, replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho import spec
from tallyho.operators.contract import validate_contract
from tallyho.operators.label import failed_conditions
from tallyho.operators.models import score


def score_batch(model: PipelineModel, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored accepted rows, rejected rows) for one batch; also used by tests."""
    checked = validate_contract(batch)
    accepted = checked.where(F.col("is_valid")).drop("violations", "is_valid")
    # Accepted values are coerced to the contract types (e.g. text "17" -> 17).
    for f, (typ, _, _) in spec.CONTRACT_FIELDS.items():
        if f in accepted.columns and typ in ("int", "float"):
            accepted = accepted.withColumn(f, F.trim(F.col(f).cast("string")).try_cast(
                "bigint" if typ == "int" else "double"))
    rejected = checked.where(~F.col("is_valid"))
    scored = score(model, accepted)
    scored = failed_conditions(scored, label_col="prediction")
    keep = [c for c in scored.columns if not (c.endswith(("__idx", "__ohe")) or c.startswith("_num_")
                                              or c in ("features", "rawPrediction", "probability"))]
    return scored.select(*keep), rejected


def stream_score(model: PipelineModel, stream: DataFrame, accepted_path: str, rejected_path: str,
                 checkpoint: str, trigger: dict | None = None):
    """Start the scoring stream; returns the ``StreamingQuery``."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()  # the source is read once for both sinks
        try:
            ok, bad = score_batch(model, batch)
            ok = ok.withColumn("failed_conditions", F.to_json("failed_conditions"))
            ok.write.mode("overwrite").parquet(f"{accepted_path}/epoch={epoch_id}")
            bad.write.mode("overwrite").parquet(f"{rejected_path}/epoch={epoch_id}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
