"""Numbers along sequences, as expressions over array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _floats() -> Column:
    return F.array().cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def masked_sum(a: Column, mask: Column) -> Column:
    return total(F.zip_with(a, mask, lambda x, m: x * m))


def masked_mean(a: Column, mask: Column) -> Column:
    """Mean over the mask; the mask counts as one at least."""
    return masked_sum(a, mask) / F.greatest(total(F.transform(mask, lambda m: m.cast("double"))), F.lit(1.0))


def backward(values: Column, factor: float) -> Column:
    """out[t] = values[t] + factor * out[t + 1]."""
    step = lambda s, x: F.array_append(s, x + factor * F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0.0)))
    return F.reverse(F.aggregate(F.reverse(values), _floats(), step))


def discounted_returns(reward: Column, kl: Column, mask: Column, kl_coef: float, gamma: float) -> Column:
    """Discounted sums of -kl_coef * kl under the mask; the reward stands at its last unmasked place."""
    n = F.size(mask)
    last = n - F.array_position(F.reverse(F.transform(mask, lambda m: m.cast("int"))), 1) + 1
    at = F.sequence(F.lit(1), n)
    own = F.zip_with(F.zip_with(kl, mask, lambda k, m: -kl_coef * k * m), at, lambda x, i: x + F.when(i == last, reward).otherwise(0.0))
    return F.when(n > 0, backward(own, gamma)).otherwise(_floats())


def advantages(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates."""
    after = F.concat(F.slice(values, 2, F.size(values)), F.array(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(rewards, values, lambda r, v: r - v), after, lambda d, n: d + gamma * n)
    return backward(delta, gamma * lam)


def broadcast_reward(reward: Column, kl: Column, kl_coef: float = 0.0) -> Column:
    return F.transform(kl, lambda k: reward - kl_coef * k)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low)))


def approximate_kl(log_probs: Column, base: Column, kind: str, ratio: Column | None = None) -> Column:
    """k1, k2, k3 or low_var_kl (k3 within ten either way) of each token; ratio weights it before the bounds."""

    def one(a: Column, b: Column) -> Column:
        d = a - b
        if kind == "k1":
            return d
        if kind == "k2":
            return d * d / 2
        if kind in ("k3", "low_var_kl"):
            return F.exp(-d) - 1 + d
        raise ValueError(f"unknown kind: {kind}")

    kl = F.zip_with(log_probs, base, one)
    if ratio is not None:
        kl = F.zip_with(kl, ratio, lambda k, r: k * r)
    return F.transform(kl, lambda k: clamp(k, -10, 10)) if kind == "low_var_kl" else kl


def sequence_kl(log_probs: Column, old: Column, mask: Column) -> Column:
    return masked_mean(F.zip_with(old, log_probs, lambda a, b: a - b), mask)


def off_policy_mask(advantage: Column, kl: Column, delta: float) -> Column:
    """0 where the advantage is negative and the sequence went further than delta, else 1."""
    return F.transform(advantage, lambda a: F.when((a < 0) & (kl > delta), 0.0).otherwise(1.0))


def policy_loss(kl: Column, advantage: Column, low: float, high: float, dual: float | None = None) -> Column:
    """Array of struct(loss, clipped)."""

    def one(k: Column, a: Column) -> Column:
        ratio = F.exp(-k)
        plain, bound = -ratio * a, -clamp(ratio, 1 - low, 1 + high) * a
        loss = F.greatest(plain, bound)
        if dual is not None:
            loss = F.when(a < 0, F.least(-dual * a, loss)).otherwise(loss)
        return F.struct(loss.alias("loss"), (bound > plain).cast("double").alias("clipped"))

    return F.zip_with(kl, advantage, one)


def value_loss(values: Column, old: Column, returns: Column, clip: float) -> Column:
    """Larger of the squared errors of the value and of the value kept within clip of the old one."""
    near = F.zip_with(values, old, lambda v, o: o + clamp(v - o, -clip, clip))
    return F.zip_with(F.zip_with(values, returns, lambda v, r: (v - r) * (v - r)), F.zip_with(near, returns, lambda v, r: (v - r) * (v - r)), lambda a, b: F.greatest(a, b))


def ratio_clamp(train: Column, rollout: Column, low: float, high: float) -> Column:
    return F.zip_with(train, rollout, lambda a, b: clamp(F.exp(a - b), low, high))


def ratio_inside(train: Column, rollout: Column, low: float, high: float) -> Column:
    """The ratio, or 0 where it leaves the bounds."""
    ratio = F.zip_with(train, rollout, lambda a, b: F.exp(a - b))
    return F.transform(ratio, lambda r: F.when((r >= low) & (r <= high), r).otherwise(0.0))


def log_ratio(train: Column, rollout: Column, mask: Column, level: str) -> Column:
    """Of each token, or the sum or mean under the mask at every token."""
    diff = F.zip_with(train, rollout, lambda a, b: a - b)
    if level == "token":
        return diff
    one = masked_sum(diff, mask) if level == "sequence" else masked_mean(diff, mask)
    return F.transform(diff, lambda _: one)


def importance_weights(rows: DataFrame, train: str, rollout: str, mask: str, *, level: str = "token", mode: str = "truncate", low: float | None = None, high: float = 2.0, reject: bool = False, reject_level: str = "token", reject_low: float | None = None, reject_high: float | None = None, veto: float | None = None, normalize: bool = False) -> DataFrame:
    """Adds weights and new_mask. normalize: to a mean of one over all tokens (or sequences), by one aggregate over the table."""
    low = 1.0 / high if low is None else low
    a, b, m = F.col(train), F.col(rollout), F.transform(mask, lambda x: x.cast("double"))
    weight = lambda lv: F.transform(log_ratio(a, b, m, lv), lambda x: F.exp(clamp(x, -20, 20)))
    inside = lambda w, m, lo, hi: F.zip_with(w, m, lambda x, y: F.when((x >= lo) & (x <= hi), y).otherwise(0.0))
    w, new = weight(level), m
    if mode == "mask":
        new = inside(w, m, low, high)
    elif mode == "truncate":
        w = F.transform(w, lambda x: clamp(x, 0, high))
    elif mode == "clip":
        w = F.transform(w, lambda x: clamp(x, low, high))
    else:
        raise ValueError(f"unknown mode: {mode}")
    w = F.zip_with(w, m, lambda x, y: x * y)
    if reject:
        new = inside(weight(reject_level), new, low if reject_low is None else reject_low, high if reject_high is None else reject_high)
        if veto is not None:
            bad = F.exists(F.zip_with(F.zip_with(a, b, lambda x, y: x - y), m, lambda d, y: (d < math.log(veto)) & (y > 0)), lambda x: x)
            new = F.transform(new, lambda x: F.when(bad, 0.0).otherwise(x))
    out = rows.withColumns({"weights": w, "new_mask": new})
    if normalize:
        if level == "token":
            mean = F.sum(masked_sum(F.col("weights"), m)) / F.greatest(F.sum(total(m)), F.lit(1.0))
        else:
            mean = F.avg(masked_mean(F.col("weights"), m))
        scale = out.agg(mean.alias("__mean"))  # one row
        out = out.crossJoin(F.broadcast(scale)).withColumn("weights", F.when(F.col("__mean") > 1e-8, F.transform("weights", lambda x: x / F.col("__mean"))).otherwise(F.col("weights"))).drop("__mean")
    return out


def whiten(rows: DataFrame, values: str, mask: str, shift: bool = True, epsilon: float = 1e-8) -> DataFrame:
    """Values less the mean over the whole table's mask, divided by its deviation (n - 1 if there are two at least); raises on an empty mask."""
    v, m = F.col(values), F.transform(mask, lambda x: x.cast("double"))
    sums = rows.agg(F.sum(masked_sum(v, m)).alias("s"), F.sum(masked_sum(F.transform(v, lambda x: x * x), m)).alias("q"), F.sum(total(m)).alias("n"))
    n = F.nullif(F.col("n"), F.lit(0.0))
    mean = F.col("s") / n
    var = (F.col("q") / n - mean * mean) * F.when(F.col("n") >= 2, F.col("n") / (F.col("n") - 1)).otherwise(1.0)
    stats = sums.select(F.when(F.col("n") > 0, mean).otherwise(F.raise_error(F.lit("the mask is empty"))).alias("__mean"), var.alias("__var"))
    back = F.col("__mean") if not shift else F.lit(0.0)
    return rows.crossJoin(F.broadcast(stats)).withColumn(values, F.transform(v, lambda x: (x - F.col("__mean")) / F.sqrt(F.col("__var") + epsilon) + back)).drop("__mean", "__var")


def mask_or_ones(mask: Column, length: Column, removed: Column) -> Column:
    """The mask, ones where there is none, zeros for removed samples; raises if its length is wrong."""
    out = F.when(removed, F.array_repeat(F.lit(0), length)).otherwise(F.coalesce(mask, F.array_repeat(F.lit(1), length)))
    return F.when(F.size(out) == length, out).otherwise(F.raise_error(F.lit("mask and response differ in length")))


def response_length(mask: Column) -> Column:
    """From the first 1 to the end; 0 without one."""
    at = F.array_position(F.transform(mask, lambda m: m.cast("int")), 1)
    return F.when(at > 0, F.size(mask) - at + 1).otherwise(0).cast("int")


def mask_segments(tokens: Column, mask: Column) -> Column:
    """Texts of the runs of tokens under 1."""
    joined = F.aggregate(F.zip_with(tokens, mask, lambda t, m: F.when(m == 1, F.concat(F.lit("\u0001"), t)).otherwise(F.lit("\u0002"))), F.lit(""), lambda s, x: F.concat(s, x))
    return F.transform(F.filter(F.split(joined, "\u0002+"), lambda x: x != ""), lambda x: F.replace(x, F.lit("\u0001"), F.lit("")))


def pad_to(tokens: Column, multiple: int, pad: int = 0) -> Column:
    return F.concat(tokens, F.array_repeat(F.lit(pad), F.pmod(-F.size(tokens), F.lit(multiple)).cast("int")))


def last_part(a: Column, n: Column) -> Column:
    """The last n entries."""
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), n)


def token_delta(old: Column, new: Column) -> Column:
    return F.slice(new, F.size(old) + 1, F.size(new))
