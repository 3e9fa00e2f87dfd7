"""Queries of the learned and hybrid categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import classify
from ledgerloom.operators import ml_categorizer as ml
from ledgerloom.plans.registry import query
from ledgerloom.sources.tables import table


@query()
def hybrid_categories(spark: SparkSession, folder: str) -> DataFrame:
    """Each line's category by rules and a model fitted on the stored categories."""
    t = table(spark, folder, "ledger_transactions").select("id", "description", "category")
    known = t.where(~F.lower(F.trim("category")).isin("", "n/a", "unknown", "uncategorized"))
    model = ml.fit(known, "id", "category")
    x = classify.with_category(ml.predict(model, t.select("id", "description")), "description")
    return x.select("id", ml.combined(F.col("category"), F.col("confidence"), F.col("ml_category"), F.col("ml_confidence")).alias("c"), "ml_category").select("id", "c.*", "ml_category")
