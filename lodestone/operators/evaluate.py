"""Measuring retrieval: metrics, rewards, group advantages, objectives, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _hits(found: Column, truth: Column) -> Column:
    return F.size(F.array_intersect(found, truth)).cast("double")


def recall_at(retrieved: Column, truth: Column, k: int) -> Column:
    """Distinct hits among the first k, by the length of the truth; 0 without truth."""
    return F.when(F.size(truth) > 0, _hits(F.slice(retrieved, 1, k) if k else F.array().cast("array<long>"), truth) / F.size(truth)).otherwise(0.0)


def precision_at(retrieved: Column, truth: Column, k: int) -> Column:
    """Hits among the first k, by how many there are (1 at least); 0 for k of 0."""
    if k <= 0:
        return F.lit(0.0)
    return _hits(F.slice(retrieved, 1, k), truth) / F.greatest(F.least(F.size(retrieved), F.lit(k)), F.lit(1))


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall < 1e-12, 0.0).otherwise(2 * precision * recall / (precision + recall))


def reciprocal_rank(retrieved: Column, truth: Column) -> Column:
    """1 / rank of the first hit in the whole list, 0 without one."""
    at = F.filter(F.transform(retrieved, lambda d, i: F.when(F.array_contains(truth, d), i + 1)), lambda r: r.isNotNull())
    return F.when(F.size(at) > 0, 1.0 / F.array_min(at)).otherwise(0.0)


def metrics(samples: DataFrame, k: int, retrieved: str = "retrieved", truth: str = "ground_truth") -> DataFrame:
    """Add ``recall``, ``precision``, ``f1``, ``mrr`` to samples of arrays of ids."""
    r, t = (F.coalesce(F.col(c), F.array().cast("array<long>")) for c in (retrieved, truth))
    out = samples.withColumns({"recall": recall_at(r, t, k), "precision": precision_at(r, t, k), "mrr": reciprocal_rank(r, t)})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def metrics_from_rows(results: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same from ``(query_id, doc_id, rank)`` and ``(query_id, doc_id)``; truths may be of any size.

    Truth is joined and counted, never gathered in one row.
    """
    size = truth.groupBy("query_id").agg(F.count("*").alias("n_truth"))
    hit = results.join(truth.distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.sum((F.col("rank") <= k).cast("int")).alias("hits"), F.min("rank").alias("first"))
    got = results.groupBy("query_id").agg(F.count("*").alias("n"))
    base = queries.join(size, "query_id", "left").join(hit, "query_id", "left").join(got, "query_id", "left")
    hits, n, t = (F.coalesce(c, F.lit(0)) for c in ("hits", "n", "n_truth"))
    out = base.withColumns({"recall": F.when(t > 0, hits / t).otherwise(0.0), "precision": hits / F.greatest(F.least(n, F.lit(k)), F.lit(1)), "mrr": F.coalesce(1.0 / F.col("first"), F.lit(0.0))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).select(*queries.columns, t.alias("n_truth"), "recall", "precision", "f1", "mrr")


def report(measured: DataFrame, *by: str) -> DataFrame:
    """Macro-averages, by the given columns or over all."""
    means = [F.avg(c).alias(c) for c in ("recall", "precision", "f1", "mrr")]
    return measured.groupBy(*by).agg(F.count("*").alias("n"), *means)


def report_with_overall(measured: DataFrame, by: str) -> DataFrame:
    """``report`` by a column, and one row over all (its ``by`` is null)."""
    means = [F.avg(c).alias(c) for c in ("recall", "precision", "f1", "mrr")]
    return measured.rollup(by).agg(F.count("*").alias("n"), *means)


def recovery(retrieved: Column, truth: Column) -> Column:
    """Hits counted over the list, repeats too, by the length of the truth."""
    hits = F.size(F.filter(retrieved, lambda d: F.array_contains(truth, d))).cast("double")
    return F.when(F.size(truth) > 0, hits / F.size(truth)).otherwise(0.0)


def list_precision(retrieved: Column, truth: Column) -> Column:
    hits = F.size(F.filter(retrieved, lambda d: F.array_contains(truth, d))).cast("double")
    return F.when(F.size(retrieved) > 0, hits / F.size(retrieved)).otherwise(0.0)


def repetition_penalty(triples: DataFrame, *by: str) -> DataFrame:
    """Share of triples (src, rel, dst) that repeat others of their group."""
    counts = triples.groupBy(*by, "src", "rel", "dst").agg(F.count("*").alias("c"))
    return counts.groupBy(*by).agg(F.sum("c").alias("n"), ((F.sum("c") - F.count("*")) / F.sum("c")).alias("penalty"))


def task_reward(rec: Column, pre: Column, ded: Column, alpha: float = 0.4, beta: float = 0.3, gamma: float = 0.3) -> Column:
    """Weighted mean of recovery, precision and deduction; 0 if the weights vanish."""
    total = alpha + beta + gamma
    return F.lit(0.0) if abs(total) < 1e-12 else (alpha * rec + beta * pre + gamma * ded) / total


def trajectory_reward(task: Column, repetition: Column, form: Column, penalty: float = 0.2, bonus: float = 0.05) -> Column:
    return task - penalty * repetition + bonus * form


def unit_interval(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rewards(samples: DataFrame) -> DataFrame:
    """Add ``rec, pre, task, reward`` to rows with ``retrieved, ground_truth, repetition, ded, form``; judges are clamped."""
    out = samples.withColumns({"rec": recovery(F.col("retrieved"), F.col("ground_truth")), "pre": list_precision(F.col("retrieved"), F.col("ground_truth"))})
    out = out.withColumn("task", task_reward(F.col("rec"), F.col("pre"), unit_interval(F.col("ded"))))
    return out.withColumn("reward", trajectory_reward(F.col("task"), F.col("repetition"), unit_interval(F.col("form"))))


def group_advantage(rewards_: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    """Add ``advantage``: (reward - mean) / population deviation of the group, 0 where that is under 1e-9.

    Means and deviations come from partial sums and are joined back, so a large group is not gathered.
    """
    s = rewards_.groupBy(group).agg(F.avg(reward).alias("mean_"), F.stddev_pop(reward).alias("dev_"))
    out = rewards_.join(s, group)
    return out.withColumn("advantage", F.when(F.col("dev_") < 1e-9, 0.0).otherwise((F.col(reward) - F.col("mean_")) / F.col("dev_"))).drop("mean_", "dev_")


def clipped_ratio(new: Column, old: Column, eps: float) -> Column:
    return F.greatest(F.least(F.exp(new - old), F.lit(1 + eps)), F.lit(1 - eps))


def objective(rows: DataFrame, eps: float = 0.2, *by: str) -> DataFrame:
    """Mean of min(ratio * advantage, clipped ratio * advantage) of ``new_logp, old_logp, advantage``."""
    ratio, clipped = F.exp(F.col("new_logp") - F.col("old_logp")), clipped_ratio(F.col("new_logp"), F.col("old_logp"), eps)
    term = F.least(ratio * F.col("advantage"), clipped * F.col("advantage"))
    return rows.groupBy(*by).agg(F.coalesce(F.avg(term), F.lit(0.0)).alias("objective"), F.count("*").alias("n"))


def habituation(weight: Column, hits: Column, rate: float) -> Column:
    return weight / (1 + max(rate, 0.0) * hits)


def forgetting(weight: Column, age: Column, decay: float) -> Column:
    return weight * F.exp(-max(decay, 0.0) * age)


def z_scores(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``group_advantage`` by a window, for groups that are known to be small."""
    by = W.partitionBy(group)
    dev = F.stddev_pop(value).over(by)
    return rows.withColumn("z", F.when(dev < 1e-9, 0.0).otherwise((F.col(value) - F.avg(value).over(by)) / dev))
