"""Learned categories beside the rules.

A perceptron over hashed words and the channel is fitted on a bounded sample of labelled rows and
applied to all rows; the rules' and the model's answers are then combined in one CASE.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import HashingTF, IndexToString, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.classify import UNCATEGORIZED, channel

#: Labelled rows the model is fitted on at most, taken by a hash of their ids.
SAMPLE_ROWS = 5_000
WORDS, CHANNELS, HIDDEN = 256, 16, 48
SURE, ENOUGH, AHEAD, MOST = 0.9, 0.6, 0.15, 0.98


def _prepared(df: DataFrame) -> DataFrame:
    text = F.regexp_replace(F.lower(F.coalesce("description", F.lit(""))), r"\d+", " ")
    kind = F.array(channel(F.coalesce("description", F.lit("")))["type"])
    return df.withColumn("_text", F.concat(F.lit("_ "), text)).withColumn("_kind", kind)


def fit(labelled: DataFrame, id_: str, label: str, rows: int = SAMPLE_ROWS, seed: int = 7) -> PipelineModel:
    """A model from at most `rows` labelled rows; rows without a label do not count."""
    sample = labelled.where(F.col(label).isNotNull()).orderBy(F.xxhash64(id_, F.lit(seed))).limit(rows).select(id_, "description", F.col(label).alias("_label"))
    sample = _prepared(sample).persist()
    classes = sample.select("_label").distinct().count()
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=WORDS, binary=True),
        HashingTF(inputCol="_kind", outputCol="_ch", numFeatures=CHANNELS, binary=True),
        VectorAssembler(inputCols=["_tf", "_ch"], outputCol="_x"),
    ]
    labels = StringIndexer(inputCol="_label", outputCol="_y", handleInvalid="skip").fit(sample)
    net = MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_y", predictionCol="_p", probabilityCol="_prob", layers=[WORDS + CHANNELS, HIDDEN, max(classes, 2)], maxIter=60, seed=seed, blockSize=256)
    # Labels are known only while fitting, so their indexer stays out of the model that is applied.
    fitted = Pipeline(stages=[*stages, net]).fit(labels.transform(sample))
    sample.unpersist()
    return PipelineModel([*fitted.stages, IndexToString(inputCol="_p", outputCol="_named", labels=labels.labels)])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """df with ml_category and ml_confidence; under ENOUGH the category is Uncategorized."""
    out = model.transform(_prepared(df)).withColumn("ml_confidence", F.array_max(vector_to_array("_prob")))
    out = out.withColumn("ml_category", F.when(F.col("ml_confidence") >= ENOUGH, F.col("_named")).otherwise(UNCATEGORIZED))
    return out.select(*df.columns, "ml_category", "ml_confidence")


def combined(rule_category: Column, rule_confidence: Column, ml_category: Column, ml_confidence: Column, override: bool = True) -> Column:
    """A struct of category, confidence and source. Without `override` (the batch form) a surer model does not replace a rule."""
    answer = lambda c, p, s: F.struct(c.alias("category"), p.alias("confidence"), F.lit(s).alias("source"))
    usable = (ml_confidence >= ENOUGH) & (ml_category != UNCATEGORIZED)
    rule = answer(rule_category, rule_confidence, "rules")
    out = F.when(rule_confidence >= SURE, rule).when((rule_category == UNCATEGORIZED) & usable, answer(ml_category, ml_confidence, "ml"))
    out = out.when((rule_category == ml_category) & usable, answer(rule_category, F.least(F.lit(MOST), 0.6 * rule_confidence + 0.4 * ml_confidence), "hybrid"))
    if override:
        out = out.when(usable & (ml_confidence > rule_confidence + AHEAD), answer(ml_category, ml_confidence * 0.9, "ml"))
    return out.otherwise(rule)


def training_rows(spark, rows: int = 5000, seed: int = 7) -> DataFrame:
    """Made-up labelled descriptions with seeded prefixes, stores and traces."""
    kinds = F.array(*[F.struct(F.lit(d).alias("text"), F.lit(c).alias("category")) for d, c in TEMPLATES])
    pick = lambda n, s: (F.floor(F.rand(seed + s) * n) + 1).cast("int")
    base = spark.range(rows).withColumn("t", F.element_at(kinds, pick(len(TEMPLATES), 0)))
    prefix = F.element_at(F.array(F.lit(""), F.lit("CHECKCARD 0102 "), F.lit("PURCHASE "), F.lit("POS ")), pick(4, 1))
    store = F.when(F.rand(seed + 2) < 0.5, F.concat(F.lit(" #"), F.floor(F.rand(seed + 3) * 9999).cast("string"))).otherwise("")
    return base.select("id", F.concat(prefix, "t.text", store).alias("description"), F.col("t.category").alias("category"))


# Seeds of made-up rows.
TEMPLATES = (
    ("PAYROLL DIRECT DEP", "Income"), ("INTEREST EARNED", "Income"), ("RENT PAYMENT", "Housing"), ("MORTGAGE PMT", "Housing"), ("ELECTRIC COMPANY", "Utilities"), ("WATER AND SEWER", "Utilities"),
    ("GROCERY STORE", "Food & Dining"), ("COFFEE SHOP", "Food & Dining"), ("PIZZA RESTAURANT", "Food & Dining"), ("GAS STATION", "Transportation"), ("CITY PARKING", "Transportation"), ("PHARMACY", "Health"),
    ("DENTAL CLINIC", "Health"), ("ONLINE MARKETPLACE", "Shopping"), ("HARDWARE STORE", "Shopping"), ("MOVIE THEATER", "Entertainment"), ("FITNESS CLUB", "Entertainment"), ("AIRLINE TICKET", "Travel"),
    ("HOTEL STAY", "Travel"), ("ATM WITHDRWL", "Financial"), ("MONTHLY MAINTENANCE FEE", "Fees"), ("UNIVERSITY TUITION", "Education"), ("PET SUPPLIES", "Pets"), ("CHARITY DONATION", "Charity"),
)
