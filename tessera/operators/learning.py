"""Weak labels from feedback, feature rows, and an observe-only ranker with Spark ML."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import NEGATIVE_EVENTS, PICK_TYPES, POSITIVE_EVENTS, WEIGHTS
from tessera.operators.tables import written


def weak_labels(events: DataFrame, weak_weight: float = WEIGHTS.weak_negative_weight) -> DataFrame:
    """(request_id, item_id, label, binary, weight, kind): negatives override, else the best positive, else weak."""
    gain = F.lit(0.0)
    for name, value in POSITIVE_EVENTS.items():
        gain = F.when(F.col("event_type") == name, value).otherwise(gain)
    got = events.where(F.col("item_id").isNotNull()).groupBy("request_id", "item_id").agg(F.max(F.col("event_type").isin(*NEGATIVE_EVENTS)).alias("neg"), F.max(gain).alias("gain"))
    pick = lambda neg, pos, weak: F.when(F.col("neg"), neg).when(F.col("gain") > 0, pos).otherwise(weak)
    return got.select("request_id", "item_id", pick(-1.0, F.col("gain"), 0.0).alias("label"), pick(0, 1, 0).alias("binary"), pick(1.0, 1.0, weak_weight).alias("weight"), pick("negative", "positive", "weak_negative").alias("kind"))


def summary(labels: DataFrame) -> DataFrame:
    n = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(k)
    return labels.agg(F.count("*").alias("samples"), n("positive"), n("negative"), n("weak_negative"))


# Features by origin, and the source types behind each flag.
ITEM_FEATURES = ("content", "retrieval", "agreement", "quality", "novelty", "score", "rank_score", "rank")
REQUEST_FEATURES = ("content_weight", "novelty_weight", "diversity")
SOURCE_FLAGS = {
    "has_embedding_source": ("embedding",),
    "has_artist_source": ("artist", "artist_context"),
    "has_genre_source": ("genre", "genre_mood"),
    "has_mood_source": ("mood", "genre_mood"),
    "has_tag_source": ("tag", "tag_combo"),
    "has_seed_song_source": ("seed_song", "seed_album"),
    "has_discovery_source": ("discovery",),
}
OPTIONAL_FEATURES = ("popularity", "authority", "metadata")
BASE_FEATURES = (*(f"f_{c}" for c in (*ITEM_FEATURES, *REQUEST_FEATURES)), "f_n_types", *(f"f_{c}" for c in SOURCE_FLAGS), *(f"f_pick_{p}" for p in PICK_TYPES))


def extract(cards: DataFrame) -> DataFrame:
    """cards, exposed or live, with their features as f_ columns: numbers (null or bad: 0), source flags, pick types.

    Request numbers come from the card's request, or else from the card. Optional ones keep their nulls; see schema().
    One expression for training and inference, so that both see the same features.
    """
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in cards.columns else F.lit(0.0)
    kinds = F.transform(F.coalesce("types", F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    pick = F.lower(F.trim(F.coalesce("pick", F.lit("")))) if "pick" in cards.columns else F.lit("")
    out = {f"f_{c}": number(c) for c in (*ITEM_FEATURES, *REQUEST_FEATURES)}
    out["f_n_types"] = F.size(F.array_distinct(F.filter(kinds, lambda t: t != ""))).cast("double")
    out |= {f"f_{name}": F.arrays_overlap(kinds, F.array(*map(F.lit, of))).cast("double") for name, of in SOURCE_FLAGS.items()}
    out |= {f"f_pick_{p}": (pick == p).cast("double") for p in PICK_TYPES}
    out |= {f"f_{c}": F.col(c).cast("double") if c in cards.columns else F.lit(None).cast("double") for c in OPTIONAL_FEATURES}
    return cards.withColumns(out)


def schema(samples: DataFrame) -> list[str]:
    """The features in their fixed order; optional ones only if a sample has them."""
    seen = samples.agg(*[F.max(F.col(f"f_{c}").isNotNull()).alias(c) for c in OPTIONAL_FEATURES]).first()
    return [*BASE_FEATURES, *(f"f_{c}" for c in OPTIONAL_FEATURES if seen[c])]


def training_data(items: DataFrame, events: DataFrame) -> DataFrame:
    """Features and label of each exposed item: all are samples, whether there are events of theirs or not."""
    kinds = events.where(F.col("item_id").isNotNull()).select("request_id", "item_id", F.lower(F.trim("event_type")).alias("event_type")).where("event_type <> ''")
    labels = weak_labels(kinds)
    none = {"label": F.lit(0.0), "binary": F.lit(0), "weight": F.lit(WEIGHTS.weak_negative_weight), "kind": F.lit("weak_negative")}
    got = extract(items.where(F.col("item_id").isNotNull())).join(labels.hint("merge"), ["request_id", "item_id"], "left")
    return got.withColumns({c: F.coalesce(c, v) for c, v in none.items()})


def write_schema(features: list[str], summary_: dict, path: str) -> None:
    """The features' order and the summary as a JSON file, by Spark's writer: any store will do."""
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps({"features": features, "summary": summary_}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_schema(path: str) -> list[str]:
    return json.loads(SparkSession.active().read.text(path).first()[0])["features"]


def train(rows: DataFrame, features: list[str], kind: str = "logistic", min_samples: int = WEIGHTS.min_samples) -> tuple[PipelineModel | None, str]:
    """(model, reason): fitted on rows with features, binary, weight; no model for few samples or one class."""
    n, classes, total = rows.agg(F.count("*"), F.count_distinct("binary"), F.sum("weight")).first()
    if n < min_samples:
        return None, f"{n} samples, {min_samples} are needed"
    if classes < 2:
        return None, "one class only"
    common = {"featuresCol": "scaled", "labelCol": "binary", "weightCol": "weight"}
    last = {
        "logistic": lambda: LogisticRegression(maxIter=1000, tol=1e-9, standardization=False, regParam=1 / total, **common),
        "boosted": lambda: GBTClassifier(seed=42, **common),
        "forest": lambda: RandomForestClassifier(numTrees=200, seed=42, **common),
    }[kind]()
    steps = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), last]
    return Pipeline(stages=steps).fit(rows.fillna(0.0, features)), "trained"


def predict(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(rows.fillna(0.0, features)).withColumn("learned_score", vector_to_array("probability")[1]).drop("raw", "scaled", "rawPrediction", "probability", "prediction")


def importance(model: PipelineModel, features: list[str]) -> dict[str, float]:
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return dict(zip(features, map(float, values.toArray())))


def auc(rows: DataFrame, score: str = "learned_score", label: str = "binary") -> DataFrame:
    """(n_positive, n_negative, auc): the share of (positive, negative) pairs in which the positive has the higher score, ties half.

    Scores are counted first, and their order is made in two steps: a total for each of the ranges that a sorted shuffle deals
    out, then running totals within a range. So no task sorts all rows; ranges hold distinct scores, so a hot one is one row.
    """
    counts = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    spark = rows.sparkSession
    ranged = written(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "s").withColumn("part", F.spark_partition_id()), "scores")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("all_n"))
    # one row per range: their running total is a small window, whatever the number of rows
    before = parts.withColumn("below_part", F.sum("all_n").over(Window.orderBy("part")) - F.col("all_n")).drop("all_n")
    below = F.sum("n").over(Window.partitionBy("part").orderBy("s")) - F.col("n")
    placed = ranged.join(F.broadcast(before), "part").withColumn("below", F.col("below_part") + below)
    won = F.sum(F.col("p") * (2 * F.col("below") + F.col("n")))
    got = placed.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_positive"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_negative"), won.alias("won"))
    pairs = F.col("n_positive") * F.col("n_negative")
    return got.select("n_positive", "n_negative", F.when(pairs > 0, F.col("won") / (2 * pairs)).alias("auc"))


def train_auc(model: PipelineModel, rows: DataFrame, features: list[str]) -> float | None:
    """Of the samples that the model was trained on."""
    return auc(predict(model, rows, features)).first().auc


def gradient(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, gradient) of the logistic ranker's objective at its coefficients: mean weighted loss and the penalty, by scaled
    feature and for the intercept. At the optimum all are 0."""
    scaler, last = model.stages[-2], model.stages[-1]
    mean, std, beta = scaler.mean.toArray(), scaler.std.toArray(), last.coefficients.toArray()
    miss = F.col("weight") * (F.col("learned_score") - F.col("binary"))
    got = predict(model, rows, features)
    scaled = [(F.coalesce(c, F.lit(0.0)) - float(m)) / float(s) if s > 0 else F.lit(0.0) for c, m, s in zip(map(F.col, features), mean, std)]
    sums = got.agg(F.sum("weight").alias("w"), F.sum(miss).alias("intercept"), *[F.sum(miss * x).alias(f"g{i}") for i, x in enumerate(scaled)])
    terms = [F.struct(F.lit("intercept").alias("feature"), (F.col("intercept") / F.col("w")).alias("gradient"))]
    terms += [F.struct(F.lit(name).alias("feature"), (F.col(f"g{i}") / F.col("w") + F.lit(float(last.getRegParam() * beta[i]))).alias("gradient")) for i, name in enumerate(features)]
    return sums.select(F.explode(F.array(*terms)).alias("t")).select("t.*")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def shadow_positions(cards: DataFrame) -> DataFrame:
    """Position of each card by learned score, then rank; the order shown stays."""
    return cards.withColumn("learned_position", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("learned_score"), "rank")))
