"""A learned rank for signals: robust scaling and a class-weighted logistic model."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Statistics of a pair for which none are stored.
PAIR_DEFAULTS = {"correlation": 0.5, "half_life": 30.0, "cointegration_pvalue": 0.05, "quality_score": 0.8}


def with_pair_stats(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """rows (s1, s2, ...) with the stored statistics of their pair, or the defaults where one is missing."""
    known = stats.select("s1", "s2", *PAIR_DEFAULTS)
    return rows.join(known, ["s1", "s2"], "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in PAIR_DEFAULTS.items()})


def action(z: Column, least_z: float = 2.0, least_strength: float = 0.65) -> Column:
    """0 buys the spread, 2 sells it, 1 waits; a null z waits."""
    strong = F.least(F.abs(z) / 2.5, F.lit(1.0)) > least_strength
    return F.when((z > least_z) & strong, 2).when((z < -least_z) & strong, 0).otherwise(1)


def reward(act: Column, gain: Column, z: Column, acts: Column, waits: Column) -> Column:
    """Reward of an action: direction, a bonus for far spreads, and one for how often the `acts` so far, `waits` of them 1, took a side; within 500."""
    toward = F.when(act == 0, gain).when(act == 2, -gain)
    direction = F.when(act == 1, F.when(F.abs(z) > 1.75, -50.0).otherwise(-5.0)).when(toward > 0, toward * 10000 + 200.0).otherwise(toward * 2500)
    right = ((z > 1.75) & (act == 2) & (gain < 0)) | ((z < -1.75) & (act == 0) & (gain > 0))
    bonus = F.when(F.abs(z) <= 1.75, 0.0).when(right, 200.0).when(act != 1, 20.0).otherwise(0.0)
    waited, sided = waits / acts, (acts - waits) / acts
    steady = F.when(acts <= 20, 0.0).when((sided > 0.15) & (sided < 0.5), 100.0).when(sided > 0.05, 50.0).when(waited > 0.85, -100.0).otherwise(0.0)
    return F.greatest(F.lit(-500.0), F.least(F.lit(500.0), direction + bonus + steady))


def quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...] = (0.25, 0.5, 0.75), accuracy: int = 100_000) -> DataFrame:
    """One row: for each column an array of its quantiles, linear between neighbours; null without values.

    A sketch brackets each quantile; then only values between the brackets, some 8 rows in `accuracy`, are ranked, with equal
    ones counted together, so no task holds a column. Should the sketch miss a bracket, its own value stands.
    """
    pad = 4 / accuracy
    points = [x for p in at for x in (max(0.0, p - pad), p, min(1.0, p + pad))]
    names = {c: f"_q{i}" for i, c in enumerate(columns)}
    sketch = df.agg(*[F.percentile_approx(F.col(c).cast("double"), points, accuracy).alias(names[c]) for c in columns])
    x = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).crossJoin(F.broadcast(sketch))  # one row
    spots = [(c, j, F.col(names[c])[3 * j], F.col(names[c])[3 * j + 2]) for c in columns for j in range(len(at))]
    edge = lambda c, j, lo, hi: F.struct(F.lit(c).alias("c"), F.lit(j).alias("j"), F.count(c).alias("n"), F.count_if(F.col(c) < lo).alias("below"), F.max(F.when(F.col(c) < lo, F.col(c))).alias("prev"), F.min(F.when(F.col(c) > hi, F.col(c))).alias("next"), F.first(F.col(names[c])[3 * j + 1]).alias("rough"))
    edges = x.agg(F.array(*[edge(*s) for s in spots]).alias("e")).select(F.inline("e"))  # a row a quantile
    held = F.array(*[F.when(F.col(c).between(lo, hi), F.struct(F.lit(c).alias("c"), F.lit(j).alias("j"), F.col(c).alias("v"))) for c, j, lo, hi in spots])
    counts = x.select(F.explode(F.filter(held, lambda h: h.isNotNull())).alias("h")).select("h.*").groupBy("c", "j", "v").count()
    ranked = counts.withColumn("cum", F.sum("count").over(W.partitionBy("c", "j").orderBy("v")))  # values between brackets alone
    rank = F.element_at(F.array(*[F.lit(p) for p in at]), F.col("j") + 1) * (F.col("n") - 1)
    reach = F.col("below") + F.col("cum")
    low, high = (F.min(F.when(reach > f(F.col("rank")), F.col("v"))) for f in (F.floor, F.ceil))
    found = F.broadcast(edges.withColumn("rank", rank)).join(ranked, ["c", "j"], "left").groupBy("c", "j").agg(*[F.first(k).alias(k) for k in ("rank", "below", "prev", "next", "rough")], low.alias("low"), high.alias("high"))
    low, high = F.when(F.floor("rank") < F.col("below"), F.col("prev")).otherwise(F.coalesce("low", "next")), F.coalesce("high", "next")
    value = F.coalesce(low + (high - low) * (F.col("rank") - F.floor("rank")), "rough")
    made = found.select("c", "j", value.alias("v"))
    return made.agg(*[F.array(*[F.max(F.when((F.col("c") == c) & (F.col("j") == j), F.col("v"))) for j in range(len(at))]).alias(c) for c in columns])


def robust_scale(df: DataFrame, columns: list[str], learn_from: DataFrame | None = None) -> DataFrame:
    """(x - median) / (q75 - q25) by column, both of the whole table or of another one; a range of 0 counts as 1."""
    q = quantiles(df if learn_from is None else learn_from, columns).toDF(*[f"_{c}" for c in columns])
    out = df.crossJoin(F.broadcast(q))  # one row
    scaled = {c: (F.col(c) - F.col(f"_{c}")[1]) / F.coalesce(F.nullif(F.col(f"_{c}")[2] - F.col(f"_{c}")[0], F.lit(0.0)), F.lit(1.0)) for c in columns}
    return out.withColumns(scaled).drop(*[f"_{c}" for c in columns])


def rank_signals(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with score: 1 where there is too little to learn from, else the model's probability."""
    n, up = train.agg(F.count("*"), F.sum("label")).first()
    if n < 400 or not 0.02 <= (up or 0) / n <= 0.98:
        return rows.withColumn("score", F.lit(1.0))
    made = VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip")
    weighted = train.withColumn("_w", F.when(F.col("label") == 1, (n - up) / up).otherwise(1.0))
    model = LogisticRegression(featuresCol="_x", labelCol="label", weightCol="_w", maxIter=30, regParam=0.01).fit(made.transform(weighted))
    return model.transform(made.transform(rows)).withColumn("score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")
