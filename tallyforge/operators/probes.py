"""Difficulty probes: reproducible splits with a floor for rare classes, AUC by ranks, and a text model on pyspark.ml."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyforge.operators.prefix import running


def shuffled(key: Column, seed: str) -> Column:
    """A reproducible order: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def split_with_floor(rows: DataFrame, key: str, group: str, train: int, test: int, floor: int, seed: str = "split") -> DataFrame:
    """Adds split: train, test or null. Train is the first rows in shuffled order and, for each group, at least ``floor``
    of its rows; test is drawn from the rest. The cuts are top-n ranks, so partial limits run before the shuffle."""
    order = [shuffled(F.col(key), seed), F.col(key)]
    ranked = rows.withColumn("in_group", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    first = rows.select(key).orderBy(*order).limit(train).withColumn("base", F.lit(True))
    marked = ranked.join(first, key, "left").withColumn("split", F.when(F.col("base") | (F.col("in_group") <= floor), "train"))
    rest = marked.where("split IS NULL").select(key).orderBy(*order).limit(test).withColumn("held", F.lit(True))
    out = marked.join(rest, key, "left").withColumn("split", F.when(F.col("held"), "test").otherwise(F.col("split")))
    return out.drop("in_group", "base", "held")


def prefixes(rows: DataFrame, order: list[Column], fractions: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0), digits: int = 3) -> DataFrame:
    """Adds fraction: every row once for each learning-curve prefix that it belongs to.

    The first order column is a hex digest (``shuffled``). Its first digits deal the rows to 16**digits ranges, which are counted and
    then ranked apart from each other, so no task sees all rows. Equal rows share a rank, as in percent_rank.
    """
    keyed = rows.withColumn("_range", F.substring(order[0], 1, digits))
    sizes = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_k"))  # 16**digits rows at most
    offsets = sizes.select("_range", F.coalesce(F.sum("_k").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_k").over(W.partitionBy(F.lit(1))).alias("_n"))
    rank = F.col("_before") + F.rank().over(W.partitionBy("_range").orderBy(*order)) - 1
    placed = keyed.join(F.broadcast(offsets), "_range").withColumn("_place", F.when(F.col("_n") > 1, rank / (F.col("_n") - 1)).otherwise(0.0))
    wanted = F.array(*[F.lit(f) for f in fractions])
    return placed.withColumn("fraction", F.explode(F.filter(wanted, lambda f: (F.col("_place") < f) | (f >= 1.0)))).select(*rows.columns, "fraction")


def auc(rows: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by rank sums; ties share the average rank. Scores are counted first, so the ranks run
    over distinct scores only, by a two-level scan where there are no groups; a group of one class gives null."""
    by = by or []
    counts = rows.groupBy(*by, score).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    if by:
        below = F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("_below", below)
    else:
        counts = running(counts, [score], "n", "_below")
    ranked = counts.withColumn("rank", F.col("_below") + (F.col("n") + 1) / 2)
    agg = ranked.groupBy(*by).agg(F.sum(F.col("rank") * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("t"))
    negatives = F.col("t") - F.col("p")
    return agg.select(*by, F.col("t").alias("n"), ((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / F.nullif(F.col("p") * negatives, F.lit(0))).alias("auc"))


def tfidf_model(rows: DataFrame, text: str, label: str, extra: list[str], vocabulary: int = 5000, min_df: int = 3):  # noqa: ANN201
    """A fitted pyspark.ml pipeline: words and word pairs, sublinear counts, smoothed idf, unit length, logistic regression
    with balanced class weights. Returns the fitted model and the prepared rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, VectorAssembler

    shares = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = shares.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    weighted = shares.join(F.broadcast(total)).select(label, (F.col("t") / (F.col("k") * F.col("n"))).alias("weight"))
    prepared = rows.join(F.broadcast(weighted), label)
    stages = [
        RegexTokenizer(inputCol=text, outputCol="w1", pattern=r"[^\w]+", minTokenLength=2),
        NGram(inputCol="w1", outputCol="w2", n=2),
        SQLTransformer(statement="SELECT *, concat(w1, w2) AS grams FROM __THIS__"),
        CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=vocabulary, minDF=float(min_df)),
        IDF(inputCol="tf", outputCol="raw"),
        Normalizer(inputCol="raw", outputCol="unit"),
        VectorAssembler(inputCols=extra, outputCol="hand"),
        StandardScaler(inputCol="hand", outputCol="scaled", withMean=True),
        VectorAssembler(inputCols=["unit", "scaled"], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=50, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(prepared), prepared


def pairwise_drift(rows: DataFrame, label: str, position: str, value: str, distance) -> DataFrame:  # noqa: ANN001
    """(a, b, n, worst, mean): distances between every two labels at equal positions; labels are few."""
    one = rows.select(F.col(label).alias("a"), F.col(position).alias("pos"), F.col(value).alias("va"))
    two = rows.select(F.col(label).alias("b"), F.col(position).alias("pos"), F.col(value).alias("vb"))
    met = one.join(two, (one["pos"] == two["pos"]) & (one["a"] < two["b"])).withColumn("d", distance(F.col("va"), F.col("vb")))
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("worst"), F.avg("d").alias("mean"))
