"""Scores of predicted classes and of clusterings, cross-validation and clustering."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lantern.graph import reindex
from lantern.session import written


def confusion(p: DataFrame) -> DataFrame:
    """(label, pred, n) of (label, pred)."""
    return p.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(p: DataFrame) -> DataFrame:
    """One row: accuracy, micro and macro F1 over the labels seen on either side."""
    c = confusion(p)
    sides = c.select(F.explode(F.array(
        F.struct(F.col("label").alias("k"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).alias("q")),
        F.struct(F.col("pred").alias("k"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.col("n").alias("q")),
    )).alias("x")).select("x.*").groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("q").alias("q"))
    return sides.agg(
        (F.sum("tp") / F.sum("t")).alias("accuracy"), (F.sum("tp") / F.sum("t")).alias("micro_f1"), F.avg(2 * F.col("tp") / (F.col("t") + F.col("q"))).alias("macro_f1"),
    )


def cluster_scores(p: DataFrame) -> DataFrame:
    """One row: Fowlkes-Mallows, mutual information (plain and normalised), Rand and adjusted
    Rand, from the contingency counts of (label, pred)."""
    c = confusion(p)
    rows, cols = c.groupBy("label").agg(F.sum("n").alias("a")), c.groupBy("pred").agg(F.sum("n").alias("b"))
    n = c.agg(F.sum("n").alias("total"))
    cells = c.join(rows, "label").join(cols, "pred").join(F.broadcast(n))  # one row
    share = F.col("n") / F.col("total")
    joint = cells.agg(F.sum(share * F.ln(F.col("n") * F.col("total") / (F.col("a") * F.col("b")))).alias("mi"), F.sum(F.col("n") * F.col("n")).alias("s"), F.max("total").alias("total"))
    def side(df, col, name):
        q = F.col(col) / F.col("total")
        return df.join(F.broadcast(n)).agg((-F.sum(q * F.ln(q))).alias(f"h_{name}"), F.sum(F.col(col) * F.col(col)).alias(f"s_{name}"))
    x = joint.join(side(rows, "a", "a")).join(side(cols, "b", "b"))  # one row each
    t = F.col("total")
    tk, pk, qk = F.col("s") - t, F.col("s_a") - t, F.col("s_b") - t
    pairs = t * (t - 1)
    return x.select(
        F.when(pk * qk > 0, tk / F.sqrt(pk.cast("double") * qk)).otherwise(0.0).alias("fmi"), "mi",
        F.when(F.col("h_a") + F.col("h_b") > 0, 2 * F.col("mi") / (F.col("h_a") + F.col("h_b"))).otherwise(1.0).alias("nmi"),
        ((pairs + 2 * tk - pk - qk) / pairs).alias("rand"),
        ((tk - pk.cast("double") * qk / pairs) / ((pk + qk) / 2 - pk.cast("double") * qk / pairs)).alias("ari"),
    )


def expected_information(a: np.ndarray, b: np.ndarray) -> float:
    """Mutual information that two clusterings of these sizes have by chance: for each pair of
    sizes, the hypergeometric mean of n/N ln(n N / (a b))."""
    n = int(a.sum())
    ln = np.cumsum(np.log(np.arange(1, n + 1)))
    fact = lambda x: np.where(x > 0, ln[np.maximum(x, 1) - 1], 0.0)
    total = 0.0
    for x in a.tolist():
        for y in b.tolist():
            k = np.arange(max(1, x + y - n), min(x, y) + 1)
            p = fact(np.array(x)) + fact(np.array(y)) + fact(np.array(n - x)) + fact(np.array(n - y)) - fact(np.array(n)) - fact(k) - fact(x - k) - fact(y - k) - fact(n - x - y + k)
            total += float((k / n * np.log(n * k / (x * y)) * np.exp(p)).sum())
    return total


def adjusted_information(p: DataFrame) -> DataFrame:
    """One row, ami: mutual information of (label, pred) less what chance gives, by the mean
    entropy less the same. Only the classes' sizes come to the driver."""
    sizes = [np.array([r["n"] for r in p.groupBy(c).agg(F.count(F.lit(1)).alias("n")).collect()], dtype=np.int64) for c in ("label", "pred")]
    if min(map(len, sizes)) == 0 or max(map(len, sizes)) == 1:
        return cluster_scores(p).select(F.lit(1.0).alias("ami"))
    chance = expected_information(*sizes)
    entropy = sum(-float((s / s.sum() * np.log(s / s.sum())).sum()) for s in sizes) / 2
    rest = entropy - chance
    rest = math.copysign(max(abs(rest), 2.0**-52), rest)
    return cluster_scores(p).select(((F.col("mi") - chance) / rest).alias("ami"))


def geometry_scores(x: DataFrame) -> DataFrame:
    """One row: Davies-Bouldin and Calinski-Harabasz of (node, features, label). Long form:
    sums per (label, coordinate)."""
    long = x.select("node", "label", F.posexplode("features").alias("i", "v"))
    centre = long.groupBy("label", "i").agg(F.avg("v").alias("c"), F.count(F.lit(1)).alias("n"))
    spread = long.join(centre, ["label", "i"]).groupBy("label", "node").agg(F.sum(F.pow(F.col("v") - F.col("c"), F.lit(2))).alias("d2"))
    per = spread.groupBy("label").agg(F.avg(F.sqrt("d2")).alias("s"), F.sum("d2").alias("w"), F.count(F.lit(1)).alias("n"))
    a, b = centre.select(F.col("label").alias("la"), "i", F.col("c").alias("ca")), centre.select(F.col("label").alias("lb"), "i", F.col("c").alias("cb"))
    gap = a.join(b, "i").filter("la <> lb").groupBy("la", "lb").agg(F.sqrt(F.sum(F.pow(F.col("ca") - F.col("cb"), F.lit(2)))).alias("m"))
    s = per.select("label", "s")
    r = gap.join(s.select(F.col("label").alias("la"), F.col("s").alias("sa")), "la").join(s.select(F.col("label").alias("lb"), F.col("s").alias("sb")), "lb")
    db = r.groupBy("la").agg(F.max((F.col("sa") + F.col("sb")) / F.col("m")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    whole = long.groupBy("i").agg(F.avg("v").alias("g"))
    between = centre.join(whole, "i").agg(F.sum(F.col("n") * F.pow(F.col("c") - F.col("g"), F.lit(2))).alias("between"))
    within = per.agg(F.sum("w").alias("within"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    ch = F.col("between") / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))
    return db.join(between).join(within).select("davies_bouldin", ch.alias("calinski_harabasz"))  # one row each


def standardised(x: DataFrame) -> DataFrame:
    """(node, i, value): each coordinate less its mean, over its population deviation (1
    where that is 0)."""
    long = x.select("node", F.posexplode("features").alias("i", "v"))
    s = long.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return long.join(s, "i").select("node", "i", ((F.col("v") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("value"))


def scaled(x: DataFrame) -> DataFrame:
    """(node, features): the standardised features of a row as an array again."""
    return standardised(x).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda v: v["value"]).alias("features"))


def folds(labels: DataFrame, n: int, seed: int) -> DataFrame:
    """(node, label, fold): nodes of each label dealt to n folds in a seeded order, as evenly
    as may be. All nodes are numbered by label in ranges, so that no task has a label whole."""
    key = F.struct("label", F.xxhash64("node", F.lit(seed)).alias("h"), "node")
    index = written(reindex(labels.select(key.alias("k")), "k").select("k.label", "k.node", "index"), "folds")
    first = index.groupBy("label").agg(F.min("index").alias("first"))
    return index.join(F.broadcast(first), "label").select("node", "label", F.pmod(F.col("index") - F.col("first") + 1, F.lit(n)).cast("int").alias("fold"))  # a row a label


def _vectors(x: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return x.withColumn("vector", array_to_vector(F.col("features")))


def classify(x: DataFrame, n_folds: int = 3, repeats: int = 1, seed: int = 113) -> DataFrame:
    """(repeat, fold, node, label, pred): cross-validated multinomial logistic regression on
    standardised features, labels (numbers) weighted to balance."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    x = _vectors(x.withColumn("label", F.col("label").cast("double")))
    x = StandardScaler(withMean=True, inputCol="vector", outputCol="z").fit(x).transform(x)
    out = None
    for r in range(repeats):
        f = x.join(folds(x.select("node", "label"), n_folds, seed + r).select("node", "fold"), "node")
        for k in range(n_folds):
            train = f.filter(F.col("fold") != k)
            size = train.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
            total = train.count()
            train = train.join(F.broadcast(size), "label").withColumn("w", F.lit(float(total)) / (size.count() * F.col("c")))
            model = LogisticRegression(featuresCol="z", weightCol="w", family="multinomial", regParam=1.0 / total, elasticNetParam=0.0, standardization=False).fit(train)
            got = model.transform(f.filter(F.col("fold") == k)).select(F.lit(r).alias("repeat"), F.lit(k).alias("fold"), "node", "label", F.col("prediction").alias("pred"))
            out = got if out is None else out.unionByName(got)
    return out


def evaluate_clusters(x: DataFrame, k: int | None = None, seed: int = 113) -> DataFrame:
    """One row of eight scores of k-means on standardised (node, features, label): six of the
    clusters against the labels, two of the labels' own geometry. Rows without a label are
    clustered and not scored; k: by default the number of labels."""
    z = scaled(x)
    z = written(z.join(x.select("node", "label"), "node"), "scaled")
    known = z.filter("label IS NOT NULL")
    k = k or known.select("label").distinct().count()
    got = written(cluster(z, k, seed).filter("label IS NOT NULL").select("node", "label", "pred"), "clusters")
    return cluster_scores(got).join(adjusted_information(got)).join(geometry_scores(known))  # one row each


def principal(x: DataFrame, k: int = 2) -> DataFrame:
    """(node, features): the first k principal components of the standardised features."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array

    v = _vectors(x)
    v = StandardScaler(withMean=True, inputCol="vector", outputCol="z").fit(v).transform(v)
    return PCA(k=k, inputCol="z", outputCol="pc").fit(v).transform(v).select("node", vector_to_array("pc").alias("features"))


def train_and_predict(x: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """(node, label, pred) of test (node, label): multinomial logistic regression on
    standardised features (node, features), fitted on train (node, label), labels weighted to
    balance. Labels are any text; there are as many as train has."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer

    v = _vectors(x.select("node", "features"))
    v = StandardScaler(withMean=True, inputCol="vector", outputCol="z").fit(v).transform(v).select("node", "z")
    names = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(train)
    own = names.transform(v.join(train, "node"))
    size = own.groupBy("y").agg(F.count(F.lit(1)).alias("c"))
    total, k = own.count(), size.count()
    own = own.join(F.broadcast(size), "y").withColumn("w", F.lit(float(total)) / (k * F.col("c")))  # a row a label
    model = LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", family="multinomial", regParam=1.0 / total, elasticNetParam=0.0, standardization=False).fit(own)
    got = model.transform(v.join(test, "node"))
    return IndexToString(inputCol="prediction", outputCol="pred", labels=names.labels).transform(got).select("node", "label", "pred")


def cluster(x: DataFrame, k: int, seed: int = 113) -> DataFrame:
    """(node, label, pred) by k-means."""
    from pyspark.ml.clustering import KMeans

    v = _vectors(x)
    return KMeans(k=k, seed=seed, featuresCol="vector").fit(v).transform(v).select("node", "label", F.col("prediction").alias("pred"))
