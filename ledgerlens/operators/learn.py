"""Feature tables, training, metrics and attributions."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.flow import both_ends
from ledgerlens.operators.order import sums_before

#: Column names under which labels and accounts are known, in order of preference, and columns that are no features.
LABELS = (
    "is_suspicious",
    "is_suspicious_tx",
    "is_laundering",
    "Is_laundering",
    "label",
    "target",
)
IDS = (
    "account_id",
    "account",
    "node",
    "node_id",
    "Sender_account",
    "sender_account",
)
NO_FEATURES = (
    "row_index",
    "Date",
    "Time",
    "date_transaction",
    "account_id",
    "account",
    "account_number",
    "Sender_account",
    "Receiver_account",
    "sender_account",
    "receiver_account",
    "name",
    "tax_number",
    "report_id",
    "xml_file",
)


def account_table(edges: DataFrame, value_columns: tuple[str, ...] = ("amount", "cb"), volume_columns: tuple[str, ...] = ("amount",), label: str | None = None) -> DataFrame:
    """Per account both sides' statistics of each column, counts, net flow and label: one shuffle for all of them."""
    b = both_ends(edges)
    aggs = []
    for o, side in ((1, "sent"), (0, "received")):
        on = F.col("out") == o
        for c in value_columns:
            x = F.when(on, F.col(c).cast("double"))
            exact = F.sum(F.when(on, F.col(c).cast("decimal(28,6)"))).cast("double")
            stats = {"sum": exact, "mean": exact / F.nullif(F.count(x), F.lit(0)), "max": F.max(x), "std": F.stddev_samp(x)} if c in volume_columns else {"mean": exact / F.nullif(F.count(x), F.lit(0)), "max": F.max(x)}
            aggs += [F.coalesce(v, F.lit(0.0)).alias(f"{side}_{c}_{s}") for s, v in stats.items()]
        aggs.append(F.count_if(on).alias(f"{side}_tx_count"))
    if label:
        aggs.append(F.max(F.coalesce(F.col(label), F.lit(0))).cast("int").alias("is_suspicious"))
    t = b.groupBy("account_id").agg(*aggs)
    v = volume_columns[0]
    return t.withColumn("net_flow", F.col(f"received_{v}_sum") - F.col(f"sent_{v}_sum")).withColumn("inbound_flow_ratio", F.coalesce(F.try_divide(F.col(f"received_{v}_sum"), F.col(f"received_{v}_sum") + F.col(f"sent_{v}_sum")), F.lit(0.0)))


def attach_labels(features: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """features with is_suspicious: their own label column under any known name, else the greatest of ``labels`` per account; missing is 0."""
    own = next((c for c in LABELS if c in features.columns), None)
    if own:
        y, f = F.col(own), features
    else:
        key, name = next(c for c in IDS if c in labels.columns), next(c for c in LABELS if c in labels.columns)
        f = features.join(labels.groupBy(F.col(key).cast("string").alias("account_id")).agg(F.max(name).alias("_y")), "account_id", "left")
        y = F.col("_y")
    return f.withColumn("is_suspicious", F.least(F.greatest(F.coalesce(y.cast("int"), F.lit(0)), F.lit(0)), F.lit(1))).drop("_y")


def feature_columns(df: DataFrame, target: str = "is_suspicious") -> list[str]:
    """Columns that are neither id nor label and take more than one value, found in one pass."""
    cols = [c for c in df.columns if c not in IDS and c not in NO_FEATURES and c not in LABELS and c != target]
    row = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in cols]).first() if cols else {}
    return [c for c in cols if row[c]]


def pipeline(df: DataFrame, cols: list[str], *, trees: int = 350, depth: int = 4, rate: float = 0.04, share: float = 0.9, least: int = 2, seed: int = 42) -> Pipeline:
    """Imputed and one-hot features into boosted trees: their number, depth and step, the share of rows and the least of them that a leaf needs."""
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    other = [c for c in cols if c not in numeric]
    stages = []
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__i" for c in numeric]))
    for c in other:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__x", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}__x", outputCol=f"{c}__v")]
    stages.append(VectorAssembler(inputCols=[f"{c}__i" for c in numeric] + [f"{c}__v" for c in other], outputCol="features", handleInvalid="keep"))
    stages.append(GBTClassifier(labelCol="is_suspicious", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=share, minInstancesPerNode=least, seed=seed))
    return Pipeline(stages=stages)


def train_and_score(labelled: DataFrame, **params) -> tuple[DataFrame, object, list[str]]:
    """(account_id, risk_score for every row; the fitted pipeline; its features). Four fifths of the accounts of each class, those of least hash, train; classes weigh alike."""
    cols = feature_columns(labelled)
    data = model_input(labelled, cols)
    order = data.withColumn("_h", F.pmod(F.xxhash64("account_id", F.lit(42)), F.lit(1_000_000)))
    cut = {r["is_suspicious"]: r["h"] for r in order.groupBy("is_suspicious").agg(F.percentile_approx("_h", 0.8, 1_000_000).alias("h")).collect()}
    train = order.where(F.col("_h") <= F.when(F.col("is_suspicious") == 1, F.lit(cut.get(1))).otherwise(F.lit(cut.get(0)))).drop("_h")
    n = {r["is_suspicious"]: r["count"] for r in train.groupBy("is_suspicious").count().collect()}
    if len(n) < 2:
        raise ValueError("training needs accounts of both classes")
    w = F.when(F.col("is_suspicious") == 1, n[0] / n[1]).otherwise(1.0)
    model = pipeline(data, cols, **params).fit(train.withColumn("weight", w))
    from pyspark.ml.functions import vector_to_array

    return model.transform(data).select("account_id", vector_to_array("probability")[1].alias("risk_score")), model, cols


def pr_metrics(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """average_precision, base_rate, best_f1, best_threshold of scores against labels; equal scores enter together.

    The curve's running counts come from ranges of falling score, so no task orders all scores. A table without positive labels
    has an average precision of 0, an empty one nulls.
    """
    per = scored.groupBy(F.col(score).alias("s")).agg(F.sum(label).cast("long").alias("p"), F.count("*").alias("n"))
    placed, total = sums_before(per, [F.desc("s")], {"tp": F.col("p"), "k": F.col("n")})
    c = placed.select("s", "p", (F.col("tp") + F.coalesce("p", F.lit(0))).alias("tp"), (F.col("k") + F.col("n")).alias("k"))
    positive = F.lit(total["tp"]).cast("long")
    precision, recall = F.col("tp") / F.col("k"), F.try_divide(F.col("tp"), positive)
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    base = F.try_divide(positive, F.nullif(F.lit(total["k"]).cast("long"), F.lit(0)))
    best = F.max_by("s", F.struct("f1", (-F.col("s")).alias("x")))
    average = F.coalesce(F.sum(F.try_divide(F.col("p"), positive) * precision), F.lit(0.0))
    return c.withColumn("f1", f1).agg(average.alias("average_precision"), F.max(base).alias("base_rate"), F.max("f1").alias("best_f1"), best.alias("best_threshold"))


def label_correlations(df: DataFrame, cols: list[str], label: str, top: int = 12) -> DataFrame:
    """feature, correlation: the ``top`` columns of greatest absolute correlation with the label, in one pass."""
    one = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in cols])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("correlation")) for c in cols])).alias("x")).select("x.*")
    return rows.orderBy(F.abs("correlation").desc_nulls_last(), "feature").limit(top)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """feature_a, feature_b, correlation of every two columns, in one pass."""
    two = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(two)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"{i}").alias("correlation")) for i, (a, b) in enumerate(two)])).alias("x")).select("x.*")


def slots(model) -> list[str]:
    """The column that each place of the feature vector comes from."""
    sizes = {s.getOutputCol(): int(s.categorySizes[0]) for s in model.stages if hasattr(s, "categorySizes")}
    kept = {s.getOutputCol(): int(s.getDropLast()) for s in model.stages if hasattr(s, "categorySizes")}
    out: list[str] = []
    for c in model.stages[-2].getInputCols():
        out += [c.rsplit("__", 1)[0]] * (sizes[c] - kept[c] if c in sizes else 1)
    return out


def importance(model, cols: list[str], top: int = 50) -> list[tuple[str, float, int]]:
    """(feature, importance, rank): the trees' gains, one-hot parts summed back to their column."""
    total: dict[str, float] = {}
    for n, g in zip(slots(model), model.stages[-1].featureImportances.toArray()):
        total[n] = total.get(n, 0.0) + float(g)
    return [(n, g, i + 1) for i, (n, g) in enumerate(sorted(total.items(), key=lambda x: (-x[1], x[0]))[:top])]


def linear_shap(features: DataFrame, weights: dict[str, float]) -> DataFrame:
    """account_id, feature, shap_value, abs_shap_value: the exact Shapley values w * (x - mean) of a linear score."""
    mean = features.agg(*[(F.sum(F.col(c).cast("decimal(28,6)")).cast("double") / F.count("*")).alias(f"m_{c}") for c in weights])
    rows = features.join(F.broadcast(mean)).select("account_id", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), (w * (F.col(c) - F.col(f"m_{c}"))).alias("shap_value")) for c, w in weights.items()])).alias("x"))
    return rows.select("account_id", "x.*", F.abs("x.shap_value").alias("abs_shap_value"))


def tree_paths(tree) -> tuple:
    """A fitted regression tree as nested tuples (feature, test, left, right, cover) or (value, cover); a test is a threshold or the tuple of categories that go left."""
    n = tree._call_java("rootNode")

    def walk(node):
        cover = node.impurityStats().count()
        if node.getClass().getSimpleName() == "LeafNode":
            return (node.prediction(), cover)
        s = node.split()
        test = s.threshold() if s.getClass().getSimpleName() == "ContinuousSplit" else tuple(s.leftCategories())
        return (s.featureIndex(), test, walk(node.leftChild()), walk(node.rightChild()), cover)

    return walk(n)


def leaves(tree: tuple, weight: float) -> list[tuple[float, list[tuple[int, list[tuple[float, bool]], float]]]]:
    """Each leaf of a tree: its weighted value, and for every feature on its path the tests passed (test, left) and the share of rows that pass them."""
    out = []

    def walk(t: tuple, path: dict) -> None:
        if len(t) == 2:
            out.append((weight * t[0], [(f, tests, share) for f, (tests, share) in path.items()]))
            return
        for child, left in ((t[2], True), (t[3], False)):
            tests, share = path.get(t[0], ([], 1.0))
            walk(child, {**path, t[0]: ([*tests, (t[1], left)], share * child[-1] / t[-1])})

    walk(tree, {})
    return out


def leaf_shares(o: list, z: list[float]) -> list:
    """Shapley values of the product over features of (o if known else z), for columns o of 0 and 1: polynomial in the path's length."""
    import numpy as np
    from math import factorial

    d, out = len(o), []
    for j in range(d):
        poly = [np.ones_like(o[j])]  # by the number of known features among the others
        for i in range(d):
            if i != j:
                poly = [(poly[k] * z[i] if k < len(poly) else 0) + (poly[k - 1] * o[i] if k else 0) for k in range(len(poly) + 1)]
        out.append((o[j] - z[j]) * sum(c * (factorial(k) * factorial(d - 1 - k) / factorial(d)) for k, c in enumerate(poly)))
    return out


def tree_shap(model, data: DataFrame) -> DataFrame:
    """account_id, feature, shap_value, abs_shap_value of the fitted trees' margin; one-hot parts are summed to their column.

    Path-dependent Shapley values, leaf by leaf in time polynomial in the depth, over columns of Arrow batches; values
    plus the mean prediction add up to the margin.
    """
    gbt = model.stages[-1]
    every = [leaf for t, w in zip(gbt.trees, gbt.treeWeights) for leaf in leaves(tree_paths(t), w)]
    of = slots(model)
    names = list(dict.fromkeys(of))
    place = [names.index(n) for n in of]

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf.x.to_numpy())
            out = np.zeros((len(pdf), len(names)))
            for value, path in every:
                o = [np.logical_and.reduce([(np.isin(x[:, f], t) if isinstance(t, tuple) else x[:, f] <= t) == left for t, left in tests]).astype(float) for f, tests, _ in path]
                for (f, _, _), share in zip(path, leaf_shares(o, [z for *_, z in path])):
                    out[:, place[f]] += value * share
            row, col = np.nonzero(out)
            v = out[row, col]
            yield pd.DataFrame({"account_id": pdf.account_id.to_numpy()[row], "feature": np.array(names)[col], "shap_value": v, "abs_shap_value": np.abs(v)})

    from pyspark.ml.functions import vector_to_array

    ready = model.transform(data).select("account_id", vector_to_array("features").alias("x"))
    return ready.mapInPandas(run, "account_id string, feature string, shap_value double, abs_shap_value double")


def model_input(labelled: DataFrame, cols: list[str]) -> DataFrame:
    """account_id, label and the features as the model takes them: numbers as doubles, others as text."""
    casts = [F.col(c).cast("double").alias(c) if isinstance(labelled.schema[c].dataType, (T.NumericType, T.BooleanType)) else F.col(c).cast("string").alias(c) for c in cols]
    return labelled.select("account_id", "is_suspicious", *casts)
