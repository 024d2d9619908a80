"""Rows of the sampling pipeline: fetching, columns for training, ranks, and small steps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattika.functions import arrays as A
from lattika.operators.ordered import numbered

STATUS = ["pending", "completed", "truncated", "aborted", "failed"]


def wrap_fetch(rows: DataFrame, order: str, offset: int, n: int) -> DataFrame:
    """Adds epoch and place: n rows from an offset on, starting over at the end once at most."""
    total = rows.count()
    if n > 2 * total:
        raise ValueError("a fetch starts over once at most")
    place = F.explode(F.filter(F.array(F.col("__k") - offset, F.col("__k") - offset + total), lambda x: (x >= 0) & (x < n)))
    out = numbered(rows, [F.col(order)], "__k").withColumn("place", place)
    return out.withColumn("epoch", F.floor((F.col("place") + offset) / total).cast("int")).drop("__k")


def pop_first(rows: DataFrame, group: str, order: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the n groups that came first, and the others."""
    first = rows.groupBy(group).agg(F.min(order).alias("__at")).orderBy("__at", group).limit(n).select(group)
    return rows.join(first, group, "left_semi"), rows.join(first, group, "left_anti")


def buffer_then_data(buffered: DataFrame, data: DataFrame, order: str, n: int) -> DataFrame:
    """n rows: the buffer's first, then those of the data."""
    both = buffered.withColumn("__from", F.lit(0)).unionByName(data.withColumn("__from", F.lit(1)))
    return both.orderBy("__from", order).limit(n).drop("__from")


def inverse_index(rows: DataFrame, by: str, place: str, index: str) -> DataFrame:
    """by, order: for each index the place that holds it."""
    return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(place).alias("p")))), lambda x: x["p"]).alias("order"))


def advantage(kind: str, reward: Column, rewards: Column, values: Column, kl: Column, mask: Column, gamma: float = 1.0, lam: float = 1.0, kl_coef: float = 0.0) -> Column:
    """The advantages of an estimator by name."""
    if kind in ("grpo", "gspo"):
        return A.broadcast_reward(reward, kl)
    if kind == "reinforce_plus_plus_baseline":
        return A.broadcast_reward(reward, kl, kl_coef)
    if kind == "reinforce_plus_plus":
        return A.discounted_returns(reward, kl, mask, kl_coef, gamma)
    if kind == "ppo":
        return A.advantages(rewards, values, gamma, lam)
    raise ValueError(f"unknown estimator: {kind}")


def train_columns(rows: DataFrame, tokens: str, mask: str, reward: str, removed: str) -> DataFrame:
    """Adds response_length, loss_mask, total_length, truncated: what training reads of a sample."""
    n = F.size(tokens)
    return rows.select("*", n.alias("total_length"), A.mask_or_ones(F.col(mask), n, F.col(removed)).alias("loss_mask"), F.col(reward).cast("double").alias("raw_reward")).withColumn("response_length", A.response_length(F.col("loss_mask")))


def split_ranks(rows: DataFrame, order: str, ranks: int) -> DataFrame:
    """Adds rank: rows in turn, and their number within the rank."""
    return numbered(rows, [F.col(order)], "__k").withColumn("rank", F.pmod("__k", F.lit(ranks)).cast("int")).withColumn("place", F.floor(F.col("__k") / ranks)).drop("__k")


def task_sample(result: Column, mask: Column, tokens: Column) -> tuple[Column, Column]:
    """Status and response length of a task's result; the mask's length, else the tokens', else 0."""
    status = F.when(result.isin(STATUS), result).when(result == "max_turns", "truncated").when(result == "error", "failed").otherwise("completed")
    return status, F.coalesce(F.when(mask.isNotNull(), F.size(mask)), F.when(tokens.isNotNull(), F.size(tokens)), F.lit(0))


def outcome_scaling(rewards: DataFrame, selected: DataFrame, problem: str, up: float = 1.2, down: float = 0.8) -> DataFrame:
    """Rewards of a problem's samples, times `up` where its selected solution is right, else `down`."""
    return rewards.join(selected.select(problem, F.col("right").alias("__right")), problem, "left").withColumn("reward", F.col("reward") * F.when(F.coalesce("__right", F.lit(False)), up).otherwise(down)).drop("__right")


def quantile_bins(rows: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    """bin, n: rows by the share of the largest value that they exceed."""
    top = rows.agg(F.max(value).alias("__top"))  # one row
    share = F.col(value) / F.col("__top")
    bin_ = sum((F.when(share > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return rows.crossJoin(F.broadcast(top)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def format_triples(rows: DataFrame, by: str) -> DataFrame:
    """by, prompt: [head, relation, tail] lines in order."""
    line = F.concat(F.lit("["), F.concat_ws(", ", "head_name", "relation", "tail_name"), F.lit("]"))
    return rows.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("prompt"))


def reselect(candidates: DataFrame, picked: DataFrame, by: str, most: int = 8) -> DataFrame:
    """Pending candidates of a question that a later choice names, in its order, the first few."""
    names = picked.select(by, F.posexplode("names").alias("at", "name"))
    out = candidates.join(names, [by, "name"]).withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy("at", "name")))
    return out.filter(F.col("rank") <= most).drop("at")


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


# -- sampling and batches --------------------------------------------------------------------------------------------------


def sample_without(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group (all of a smaller one), none twice, by a hash of seed and key: the same again whatever the partitions."""
    at = F.row_number().over(W.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    return rows.withColumn("__at", at).filter(F.col("__at") <= n).drop("__at")


def order_groups(rows: DataFrame, group: str, index: str) -> DataFrame:
    """Adds place: the groups' order by their first sample's index."""
    first = rows.groupBy(group).agg(F.min(index).alias("__first"))
    return rows.join(numbered(first, [F.col("__first"), F.col(group)], "place").drop("__first"), group)


def dynamic_batch(rows: DataFrame, order: str, ranks: int) -> DataFrame:
    """The first rows of the order, a multiple of the number of ranks of them: the batch is as large as the data allows."""
    n = rows.count()
    return numbered(rows, [F.col(order)], "__k").filter(F.col("__k") < n - n % ranks).drop("__k")


def fixed_slices(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Adds micro_batch and steps: slices of `size` rows of each rank, and the number that every rank has to run, the most of any."""
    sliced = rows.withColumn("micro_batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / size).cast("int"))
    most = sliced.agg((F.max("micro_batch") + 1).alias("steps"))
    return sliced.join(F.broadcast(most))  # one row


def micro_batch(rows: DataFrame, order: str, columns: list[str], offset: int = 0, size: int | None = None, indices: list[int] | None = None) -> DataFrame:
    """place and the named columns of a slice from an offset on, or of the rows at some indices in their order; columns that are not there are null."""
    held = [F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns]
    at = numbered(rows, [F.col(order)], "__k")
    if indices is None:
        return at.filter((F.col("__k") >= offset) & (F.col("__k") < offset + size)).select((F.col("__k") - offset).alias("place"), *held)
    wanted = at.sparkSession.createDataFrame([(k, i) for k, i in enumerate(indices)], "place long, __k long")
    return at.join(F.broadcast(wanted), "__k").select("place", *held)


def reindexed(rows: DataFrame, rank: str, order: str, length: str) -> DataFrame:
    """Adds place and total: the number of a row within its rank, and the sum of the rank's lengths up to it."""
    w = W.partitionBy(rank).orderBy(order)
    return rows.withColumn("place", F.row_number().over(w) - 1).withColumn("total", F.sum(length).over(w.rowsBetween(W.unboundedPreceding, 0)))


def requeue(rows: DataFrame, status: str, waiting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finished rows, and the queue with the aborted ones back in it, marked as pending."""
    aborted = rows.filter(F.col(status) == "aborted").withColumn(status, F.lit("pending"))
    return rows.filter(F.col(status) != "aborted"), waiting.unionByName(aborted.select(*waiting.columns))


def repeat_epochs(rows: DataFrame, epochs: int) -> DataFrame:
    """Adds epoch: every row once for each epoch."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


# -- metrics of ranks and phases -------------------------------------------------------------------------------------------


def mean_over_ranks(metrics: DataFrame, name: str, value: str, prefix: str) -> DataFrame:
    """metric, mean: the mean of each scalar over the ranks."""
    return metrics.groupBy(F.concat(F.lit(prefix + "/"), F.col(name)).alias("metric")).agg(F.avg(value).alias("mean"))


def phase_times(timers: DataFrame, name: str, seconds: str, total: str) -> DataFrame:
    """phase, seconds, share: the times of each phase, and their part of the phase that holds all."""
    summed = timers.groupBy(F.col(name).alias("phase")).agg(F.sum(seconds).alias("seconds"))
    whole = summed.filter(F.col("phase") == total).select(F.col("seconds").alias("__all"))  # one row
    return summed.join(F.broadcast(whole), how="left").select("phase", "seconds", (F.col("seconds") / F.col("__all")).alias("share"))
