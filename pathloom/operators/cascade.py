"""A cascade of conformal forests over samples: Spark's own random forests, and extremely randomised trees (``extra_trees``).

Each layer has two forests of each kind. A layer's outputs, filtered by uncertainty, are features of the next.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.operators import conformal as C
from pathloom.operators import extra_trees
from pathloom.operators.forests import Forest
from pathloom.shared import written

#: Seeds of the random forests and of the extremely randomised ones.
SEEDS, EXTRA_SEEDS = (10, 20), (30, 44)
DEPTH, TREES, MORE_TREES, LAYERS = 7, 50, 20, 5


@dataclass
class Layer:
    """Fitted forests, the filtered outputs, and each class's forest weights."""

    models: list[RandomForestClassificationModel | Forest]
    filtered: set[tuple[int, int]] = field(default_factory=set)
    weights: DataFrame | None = None
    calibration: DataFrame | None = None


def balanced(df: DataFrame) -> DataFrame:
    """Adds weight: n / (classes * rows of the label), from one small count."""
    counts = C.class_counts(df).collect()
    total, k = sum(r["n"] for r in counts), len(counts)
    w = F.lit(1.0)
    for r in counts:
        w = F.when(F.col("label") == r["label"], total / (k * r["n"])).otherwise(w)
    return df.withColumn("weight", w)


def _with_shares(df: DataFrame, model: RandomForestClassificationModel | Forest, shares: list[str]) -> DataFrame:
    """``df`` with the model's shares of both labels; a forest that knows one label gives 0 for the other."""
    if isinstance(model, Forest):
        df = df.withColumn(shares[1], extra_trees.probability(model, F.col("features")))
        return df.withColumn(shares[0], 1.0 - F.col(shares[1]))
    df = model.transform(df.withColumn("_x", array_to_vector(F.col("features").cast("array<double>"))))
    p = vector_to_array("probability")
    return df.withColumns({n: F.coalesce(F.get(p, F.lit(y)), F.lit(0.0)) for y, n in enumerate(shares)}).drop("_x", "rawPrediction", "probability", "prediction")


def probabilities(df: DataFrame, layer: Layer, *keep: str) -> DataFrame:
    """(forest, sample_id, p0, p1, keep...) for each forest; a forest that knows one class gives 0 for the other."""
    out = None
    for t, model in enumerate(layer.models):
        rows = _with_shares(df, model, ["p0", "p1"]).select(F.lit(t).alias("forest"), "sample_id", "p0", "p1", *keep)
        out = rows if out is None else out.unionByName(rows)
    return out


def augmented(df: DataFrame, layer: Layer) -> DataFrame:
    """``df(sample_id, base, features, ...)`` whose features are the base ones and the layer's filtered outputs."""
    outs = []
    for t, model in enumerate(layer.models):
        own = [f"_o{t}0", f"_o{t}1"]
        df = _with_shares(df, model, own)
        outs += [F.lit(0.0) if (t, y) in layer.filtered else F.col(n) for y, n in enumerate(own)]
    return df.withColumn("features", F.concat(F.col("base").cast("array<double>"), F.array(*outs))).drop(*[f"_o{t}{y}" for t in range(len(layer.models)) for y in (0, 1)])


def fit_layer(df: DataFrame, trees: int, depth: int = DEPTH, tau: float | None = None) -> Layer | None:
    """``df(sample_id, features, label)`` -> a layer: 80 % of each label train it, 10 % calibrate and 10 % validate. None with one label."""
    if df.select("label").distinct().count() < 2:
        return None
    df = written(C.stratified_split(C.upsample_minority(df, ["sample_id"]).select("sample_id", "features", "label"), ["sample_id"], [("train", 0.8), ("calibrate", 0.1), ("validate", 0.1)]), "split")
    train = df.where("split = 'train'")
    held = {r["label"]: r["n"] for r in C.class_counts(train).collect()}
    weights = tuple(sum(held.values()) / (2.0 * max(held.get(y, 0), 1)) for y in (0, 1))
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, weights[1]).otherwise(weights[0])).withColumn("_x", array_to_vector(F.col("features").cast("array<double>")))
    layer = Layer([])
    for seed in SEEDS:
        forest = RandomForestClassifier(featuresCol="_x", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")
        layer.models.append(forest.fit(weighted.withColumn("label", F.col("label").cast("double"))))
    layer.models += extra_trees.grow(train, trees, depth, EXTRA_SEEDS, weights)
    scored = written(C.long_scores(probabilities(df.where("split <> 'train'"), layer, "label", "split"), "label", "split"), "scored")
    layer.calibration = scored.where("split = 'calibrate'").select("forest", "label", "y", "score")
    p = C.p_values(scored.where("split = 'validate'"), layer.calibration, tau)
    wide = p.groupBy("forest", "sample_id", "label").agg(*[F.max(F.when(F.col("y") == y, F.col("p"))).alias(f"p{y}") for y in (0, 1)])
    u = C.normalised(C.cdum(wide))
    layer.filtered = {(r["forest"], r["y"]) for r in u.where("filtered").collect()}  # at most two rows a forest
    layer.weights = written(C.weights(u).select("forest", "y", "u", "weight"), "weights")
    return layer


def fit(samples: DataFrame, trees: int = TREES, more_trees: int = MORE_TREES, layers: int = LAYERS, depth: int = DEPTH, tau: float | None = None) -> list[Layer]:
    """``samples(sample_id, features, label)`` -> layers. One row in five of each label judges the depth by its AUC.

    A layer that does not raise the AUC is the last, and is kept. The number of layers is small; each is a few Spark jobs.
    """
    parts = written(C.stratified_split(samples.select("sample_id", "features", "label"), ["sample_id"], [("fit", 0.8), ("judge", 0.2)], seed=7).withColumn("base", F.col("features")), "samples")
    own, judge, best, out = parts.where("split = 'fit'").drop("split"), parts.where("split = 'judge'").drop("split"), -1.0, []
    for k in range(layers):
        layer = fit_layer(own, trees if k == 0 else more_trees, depth, tau)
        if layer is None:
            break
        out.append(layer)
        w = F.broadcast(layer.weights.where("y = 1").select("forest", "weight"))  # a row a forest
        scores = probabilities(judge, layer, "label").join(w, "forest").groupBy("sample_id", "label").agg(F.sum(F.col("p1") * F.col("weight")).alias("score"))
        auc = C.auc(scores.withColumn("score", F.least("score", F.lit(1.0)))).first()["auc"]
        if auc <= best:
            break
        best = auc
        own, judge = written(augmented(own, layer), "layer"), written(augmented(judge, layer), "layer")
    return out


def predict(pixels: DataFrame, layers: list[Layer], frame: list[str], tau: float | None = None) -> DataFrame:
    """``pixels(sample_id, features, frame...)`` -> (sample_id, frame..., p, field): the last layer's conformal p-values of class 1
    weighted over the forests, and the field scaled within each frame. Without layers p and field are null."""
    keys = ["sample_id", *frame]
    if not layers:
        return pixels.select(*keys, F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("field"))
    df = pixels.select(*keys, "features").withColumn("base", F.col("features"))
    for layer in layers[:-1]:
        df = augmented(df, layer)
    last = layers[-1]
    test = C.long_scores(probabilities(df, last, *frame), *frame).where("y = 1")
    p = C.p_values(test, last.calibration, tau)
    w = F.broadcast(last.weights.where("y = 1").select("forest", "weight"))
    agg = p.join(w, "forest").groupBy(*keys).agg(F.sum(F.col("p") * F.col("weight")).alias("p"))
    return C.probability_field(agg, frame)
