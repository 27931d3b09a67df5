"""Time series: hourly windows, autocorrelation, backtests, projections, drift."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators.marts import HOURLY, hourly
from ledgerloom.plans.catalog import query
from ledgerloom.plans.exact import quantiles
from ledgerloom.plans.stored import stored
from ledgerloom.sources.adapters import EV, events_by_hour

PERIOD = 24
HORIZON = 24
#: Last train steps of the backtest windows, and the drift windows.
TRAIN_ENDS = (624, 648, 672, 696)
REFERENCE, OBSERVED = (601, 660), (661, 720)
#: Kinds of events.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
DRIFT_QUANTILES = [0.25, 0.5, 0.75, 0.9, 0.99]


def by_step() -> WindowSpec:
    """All hours in order: one row per hour, so one task sorts little."""
    return Window.orderBy("step")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(events_by_hour(spark, sf_dir))


G = f"WITH {EV}, {HOURLY}"


@query("win01_win03_series", f"{G} SELECT step, transaction_count, round(avg(transaction_count) OVER (ORDER BY step ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS moving_average, CAST((step - min(step) OVER ()) % 24 AS BIGINT) AS simulated_hour FROM gold")
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    moving = F.avg("transaction_count").over(by_step().rowsBetween(1 - PERIOD, 0))
    hour = (F.col("step") - F.min("step").over(Window.partitionBy())) % PERIOD
    return gold(spark, sf_dir).select("step", "transaction_count", F.round(moving, 6).alias("moving_average"), hour.alias("simulated_hour"))


@query("agg32_hourly_cycle", f"{G}, h AS (SELECT *, (step - min(step) OVER ()) % 24 AS hour FROM gold) SELECT CAST(hour AS BIGINT) AS simulated_hour, count(*) AS n, round(avg(transaction_count), 6) AS mean_count, round(avg(total_amount), 4) AS mean_amount FROM h GROUP BY hour")
def cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gold(spark, sf_dir).withColumn("simulated_hour", (F.col("step") - F.min("step").over(Window.partitionBy())) % PERIOD)
    return rows.groupBy("simulated_hour").agg(F.count("*").alias("n"), F.round(F.avg("transaction_count"), 6).alias("mean_count"), F.round(F.avg("total_amount"), 4).alias("mean_amount"))


@query("win02_autocorrelation", f"{G}, l AS (SELECT transaction_count AS y, lag(transaction_count, 1) OVER (ORDER BY step) AS a, lag(transaction_count, 24) OVER (ORDER BY step) AS b, lag(transaction_count, 168) OVER (ORDER BY step) AS c FROM gold) SELECT round(corr(y, a), 6) AS lag_1, round(corr(y, b), 6) AS lag_24, round(corr(y, c), 6) AS lag_168 FROM l")
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lags = (1, PERIOD, 7 * PERIOD)
    rows = gold(spark, sf_dir).select("transaction_count", *[F.lag("transaction_count", k).over(by_step()).alias(f"y{k}") for k in lags])
    return rows.agg(*[F.round(F.corr("transaction_count", f"y{k}"), 6).alias(f"lag_{k}") for k in lags])


@query("agg31_metric_summary", f"{G} SELECT round(avg(transaction_count), 6) AS mean, median(transaction_count) AS median, round(stddev_samp(transaction_count), 6) AS deviation, min(transaction_count) AS least, max(transaction_count) AS most FROM gold")
def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = "transaction_count"
    return gold(spark, sf_dir).agg(F.round(F.avg(c), 6).alias("mean"), F.median(c).alias("median"), F.round(F.stddev_samp(c), 6).alias("deviation"), F.min(c).alias("least"), F.max(c).alias("most"))


@query("agg09_agg40_fraud_tail", f"{G}, o AS (SELECT max(step) FILTER (WHERE NOT (transaction_count > 0 AND transaction_count = fraud_count)) AS last_other FROM gold) SELECT max(step) FILTER (WHERE fraud_count < transaction_count) AS last_genuine_step, max(step) FILTER (WHERE fraud_count > 0) AS last_fraud_step, count(*) FILTER (WHERE transaction_count > 0 AND fraud_count = transaction_count) AS fraud_only_steps, coalesce(min(step) FILTER (WHERE step > coalesce((SELECT last_other FROM o), -1)), -1) AS tail_start FROM gold")
def fraud_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last genuine and last fraud step, and where the run of fraud-only steps at the end starts (-1: there is none)."""
    rows = gold(spark, sf_dir).withColumn("only", (F.col("transaction_count") > 0) & (F.col("transaction_count") == F.col("fraud_count")))
    last = rows.agg(F.max(F.when(~F.col("only"), F.col("step"))).alias("other"))
    return rows.crossJoin(F.broadcast(last)).agg(
        F.max(F.when(F.col("fraud_count") < F.col("transaction_count"), F.col("step"))).alias("last_genuine_step"),
        F.max(F.when(F.col("fraud_count") > 0, F.col("step"))).alias("last_fraud_step"),
        F.count_if("only").alias("fraud_only_steps"),
        F.coalesce(F.min(F.when(F.col("step") > F.coalesce("other", F.lit(-1)), F.col("step"))), F.lit(-1)).alias("tail_start"),
    )


@query("agg41_missing_steps", f"WITH {EV.replace('FROM events)', 'FROM events WHERE value > 60)')} SELECT s.step FROM (SELECT unnest(generate_series((SELECT min(step) FROM ev), (SELECT max(step) FROM ev))) AS step) s WHERE s.step NOT IN (SELECT step FROM ev)")
def missing_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_by_hour(spark, sf_dir).where("amount > 60").select("step")
    every = rows.agg(F.min("step").alias("a"), F.max("step").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("step"))
    return every.join(rows.distinct(), "step", "left_anti")


ENDS = ", ".join(f"({e})" for e in TRAIN_ENDS)
BACKTEST = f"""{G}, w(train_end) AS (VALUES {ENDS}), long AS (SELECT step, 'count' AS target, transaction_count::DOUBLE AS y FROM gold UNION ALL SELECT step, 'amount', total_amount FROM gold),
f AS (SELECT train_end, t.target, t.step, t.y, n.y AS naive, s.y AS seasonal FROM w JOIN long t ON t.step > train_end AND t.step <= train_end + {HORIZON}
 JOIN long n ON n.target = t.target AND n.step = train_end JOIN long s ON s.target = t.target AND s.step = train_end - {PERIOD} + 1 + (t.step - train_end - 1) % {PERIOD}),
m AS (SELECT train_end, target, y, step, 'naive' AS model, naive AS p FROM f UNION ALL SELECT train_end, target, y, step, 'seasonal_naive', seasonal FROM f)"""


def backtest_rows(series: DataFrame, ends: tuple[int, ...] = TRAIN_ENDS, horizon: int = HORIZON, period: int = PERIOD) -> DataFrame:
    """Actual values and both naive forecasts for every expanding window: (train_end, target, model, step, y, p).

    Each row of the series finds the windows that it belongs to by arithmetic on their few ends.
    """
    spark = series.sparkSession
    long = series.select("step", F.explode(F.array(F.struct(F.lit("count").alias("target"), F.col("transaction_count").cast("double").alias("y")), F.struct(F.lit("amount").alias("target"), F.col("total_amount").alias("y")))).alias("v")).select("step", "v.*")
    windows = spark.createDataFrame([(e, h) for e in ends for h in range(1, horizon + 1)], "train_end long, h long")
    places = F.broadcast(windows.withColumns({"step": F.col("train_end") + F.col("h"), "last": F.col("train_end"), "same": F.col("train_end") - period + 1 + (F.col("h") - 1) % period}))
    actual = long.join(places, "step")
    last = F.broadcast(long.join(places.select("last").distinct(), F.col("step") == F.col("last")).select("last", "target", F.col("y").alias("naive")))
    same = F.broadcast(long.join(places.select("same").distinct(), F.col("step") == F.col("same")).select("same", "target", F.col("y").alias("seasonal")))
    joined = actual.join(last, ["last", "target"]).join(same, ["same", "target"])
    models = F.array(F.struct(F.lit("naive").alias("model"), F.col("naive").alias("p")), F.struct(F.lit("seasonal_naive").alias("model"), F.col("seasonal").alias("p")))
    return joined.select("train_end", "target", "step", "y", F.inline(models))


def forecast_errors(digits: int | None = 6) -> list:
    """MAE, RMSE and sMAPE of y and p, the last 0 where both are 0."""
    a, p = F.col("y"), F.col("p")
    smape = F.when(F.abs(a) + F.abs(p) == 0, 0.0).otherwise(200 * F.abs(a - p) / (F.abs(a) + F.abs(p)))
    found = {"mae": F.avg(F.abs(a - p)), "rmse": F.sqrt(F.avg((a - p) * (a - p))), "smape": F.avg(smape)}
    return [(x if digits is None else F.round(x, digits)).alias(name) for name, x in found.items()]


@query("fc04_agg28_win11_backtest", f"{BACKTEST} SELECT train_end, target, model, count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 200 * abs(y - p) / (abs(y) + abs(p)) END), 6) AS smape FROM m GROUP BY train_end, target, model".replace("train_end, target, model, count", "CAST(train_end AS BIGINT) AS train_end, target, model, count"))
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest_rows(gold(spark, sf_dir)).groupBy("train_end", "target", "model").agg(F.count("*").alias("n"), *forecast_errors())


@query("fc01_fc02_win10_forecasts", f"{BACKTEST} SELECT CAST(train_end AS BIGINT) AS train_end, target, model, step, round(p, 4) AS forecast FROM m")
def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest_rows(gold(spark, sf_dir)).select("train_end", "target", "model", "step", F.round("p", 4).alias("forecast"))


@query("fc05_win09_projection", f"{G}, h AS (SELECT unnest(generate_series(1, {HORIZON})) AS h), d AS (SELECT h, a.transaction_count - b.transaction_count AS c FROM h, gold a JOIN gold b ON true WHERE b.step = a.step - h), l AS (SELECT max(step) AS s, arg_max(transaction_count, step) AS y FROM gold), q AS (SELECT h, quantile_cont(c, 0.1) AS lo, quantile_cont(c, 0.9) AS hi FROM d GROUP BY h) SELECT CAST(s + h AS BIGINT) AS step, y AS forecast, round(greatest(0.0, least(y, y + lo)), 6) AS lower, round(greatest(y, y + hi), 6) AS upper FROM q, l")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value carried on, with quantiles of past changes over the same distance; series joined on shifted steps."""
    rows = gold(spark, sf_dir).select("step", F.col("transaction_count").alias("y"))
    shifted = rows.select(F.explode(F.sequence(F.lit(1), F.lit(HORIZON))).alias("h"), "step", F.col("y").alias("before")).withColumn("step", F.col("step") + F.col("h"))
    changes = rows.join(shifted, "step").groupBy("h").agg(F.percentile(F.col("y") - F.col("before"), F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    last = rows.agg(F.max("step").alias("s"), F.max_by("y", "step").alias("y"))
    lower, upper = F.col("y") + F.get("q", 0), F.col("y") + F.get("q", 1)
    return changes.crossJoin(F.broadcast(last)).select((F.col("s") + F.col("h")).alias("step"), F.col("y").alias("forecast"), F.round(F.greatest(F.lit(0.0), F.least(F.col("y").cast("double"), lower)), 6).alias("lower"), F.round(F.greatest(F.col("y").cast("double"), upper), 6).alias("upper"))


def validated_series(rows: DataFrame, target: str) -> DataFrame:
    """(step, y) of a series whose steps are whole, follow one another and occur once, and whose values are finite and not below 0; else a ValueError."""
    y, step = F.col("y"), F.col("step")
    if missing := sorted({"step", target} - set(rows.columns)):
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    found = rows.select(F.col("step").try_cast("double").alias("step"), F.col(target).try_cast("double").alias("y"))
    good = F.coalesce(step.isNotNull() & (step % 1 == 0) & ~F.isnan(y) & (y >= 0) & (y < float("inf")), F.lit(False))
    seen = found.agg(F.count("*").alias("n"), F.count_if(~good).alias("bad"), F.count_distinct("step").alias("steps"), F.min("step").alias("a"), F.max("step").alias("b")).first()
    if not seen["n"] or seen["bad"] or seen["steps"] != seen["n"] or seen["b"] - seen["a"] + 1 != seen["n"]:
        raise ValueError("the series has to have consecutive whole steps, each once, and finite values of 0 or more")
    return found.select(step.cast("long").alias("step"), "y")


def projected(series: DataFrame, target: str, horizon: int = HORIZON, history: int = 7 * PERIOD) -> DataFrame:
    """The last ``history`` values of a series and, after them, its last value carried on for ``horizon`` steps with quantiles of past changes over the same distance."""
    if not 1 <= horizon <= 168 or not 1 <= history <= 718:
        raise ValueError("horizon or history is out of range")
    rows = validated_series(series, target)
    if rows.count() <= horizon:
        raise ValueError("the history is too short for the horizon")
    shifted = rows.select(F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "step", F.col("y").alias("before")).withColumn("step", F.col("step") + F.col("h"))
    # One row a step, so a horizon's changes are few.
    changes = rows.join(shifted, "step").groupBy("h").agg(F.percentile(F.col("y") - F.col("before"), F.array(F.lit(0.1), F.lit(0.9))).alias("q"))
    last = F.broadcast(rows.agg(F.max("step").alias("s"), F.max_by("y", "step").alias("v")))
    none = F.lit(None).cast("double")
    past = rows.crossJoin(last).where(F.col("step") > F.col("s") - history).select(F.lit("history").alias("kind"), "step", F.col("y").alias("value"), none.alias("lower"), none.alias("upper"))
    lower, upper = F.greatest(F.lit(0.0), F.least(F.col("v"), F.col("v") + F.get("q", 0))), F.greatest(F.col("v"), F.col("v") + F.get("q", 1))
    ahead = changes.crossJoin(last).select(F.lit("forecast"), (F.col("s") + F.col("h")).alias("step"), "v", lower, upper)
    return past.union(ahead)


def _projection_sql(target: str) -> str:
    return f"SELECT '{target}' AS target, 'history' AS kind, step, {target}::DOUBLE AS value, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM gold WHERE step > (SELECT max(step) FROM gold) - {7 * PERIOD} UNION ALL SELECT '{target}', 'forecast', s + h, y::DOUBLE, greatest(0.0, least(y, y + lo)), greatest(y, y + hi) FROM (SELECT h, quantile_cont(a.{target} - b.{target}, 0.1) AS lo, quantile_cont(a.{target} - b.{target}, 0.9) AS hi FROM (SELECT unnest(generate_series(1, {HORIZON})) AS h) hs, gold a JOIN gold b ON true WHERE b.step = a.step - h GROUP BY h) q, (SELECT max(step) AS s, arg_max({target}, step) AS y FROM gold) l"


@query("fc05_projection_with_history", f"{G}, p AS ({' UNION ALL '.join(_projection_sql(t) for t in ('transaction_count', 'total_amount'))}) SELECT target, kind, CAST(step AS BIGINT) AS step, round(value, 4) AS value, round(lower, 4) AS lower, round(upper, 4) AS upper FROM p")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both targets."""
    rows = stored(gold(spark, sf_dir), "gold")
    found = [projected(rows, t).select(F.lit(t).alias("target"), "kind", "step", *[F.round(c, 4).alias(c) for c in ("value", "lower", "upper")]) for t in ("transaction_count", "total_amount")]
    return found[0].union(found[1])


def smoothed(y: np.ndarray, weights: np.ndarray, period: int, horizon: int, trend: bool) -> tuple[np.ndarray, np.ndarray]:
    """Errors of one step ahead, squared and summed, and forecasts, for each row (alpha, beta, gamma, phi) of ``weights``: additive season, trend damped by phi or none."""
    a, b, g, phi = weights.T if trend else (*weights.T[:1], np.zeros(len(weights)), weights.T[2], np.zeros(len(weights)))
    # The first period, freed of the trend to the second, gives the season; the level stands at its end.
    first, rise = y[:period].mean(), (y[period : 2 * period].mean() - y[:period].mean()) / period if trend else 0.0
    line = first + rise * (np.arange(period) - (period - 1) / 2)
    level, slope = np.full(len(weights), line[-1]), np.full(len(weights), rise)
    season, error = [np.full(len(weights), v) for v in y[:period] - line], np.zeros(len(weights))
    for t in range(period, len(y)):
        s, ahead = season[t - period], level + phi * slope
        error += (y[t] - ahead - s) ** 2
        new = a * (y[t] - s) + (1 - a) * ahead
        slope = b * (new - level) + (1 - b) * phi * slope
        level = new
        season.append(g * (y[t] - level) + (1 - g) * s)
    steps = np.cumsum(phi[:, None] ** np.arange(1, horizon + 1), axis=1)
    last = np.stack([season[len(y) - period + (h - 1) % period] for h in range(1, horizon + 1)], axis=1)
    return error, level[:, None] + steps * slope[:, None] + last


#: Least and greatest smoothing weights, and the range of the damping factor.
WEIGHTS, DAMPED = (1e-4, 0.9999), (0.8, 0.9999)
#: Steps of the estimation at most, and the share by which a step has to lessen the error for another one.
ESTIMATES, GAIN = 80, 1e-10


def recursion(y: np.ndarray, at: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Errors of one step ahead from the second period on, their derivatives by all parameters, and the states at the end, for each row of ``at``.

    Parameters are alpha, beta, gamma, phi, level, slope and one season a step of the period, as they stand after the first period. A slope's
    derivatives go along with the states from step to step.
    """
    n, size = at.shape
    unit = np.eye(size)
    a, b, g, phi = (at[:, [k]] for k in range(4))
    level, slope, season = at[:, [4]], at[:, [5]], at[:, 6:].copy()
    d_level, d_slope = np.tile(unit[4], (n, 1)), np.tile(unit[5], (n, 1))
    d_season = np.tile(unit[6:], (n, 1, 1))
    errors, jacobian = np.empty((n, len(y) - period)), np.empty((n, len(y) - period, size))
    for t in range(period, len(y)):
        k = t % period
        ahead, d_ahead = level + phi * slope, d_level + phi * d_slope + slope * unit[3]
        e, d = y[t] - ahead - season[:, [k]], -d_ahead - d_season[:, k]
        errors[:, t - period], jacobian[:, t - period] = e[:, 0], d
        level, d_level = ahead + a * e, d_ahead + a * d + e * unit[0]
        d_slope = phi * d_slope + slope * unit[3] + a * b * d + e * (b * unit[0] + a * unit[1])
        slope = phi * slope + a * b * e
        d_season[:, k] += g * (1 - a) * d + e * ((1 - a) * unit[2] - g * unit[0])
        season[:, [k]] += g * (1 - a) * e
    return errors, jacobian, np.concatenate([level, slope, season], axis=1)


def first_states(y: np.ndarray, period: int, trend: bool) -> np.ndarray:
    """Level, slope and seasons after the first period, freed of the trend to the second."""
    first, rise = y[:period].mean(), (y[period : 2 * period].mean() - y[:period].mean()) / period if trend else 0.0
    line = first + rise * (np.arange(period) - (period - 1) / 2)
    return np.r_[line[-1], rise, y[:period] - line]


def estimated(y: np.ndarray, start: np.ndarray, free: np.ndarray, low: np.ndarray, high: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters of least summed squared error, for each row of ``start`` on its own: (parameters, errors, states).

    Damped Gauss-Newton steps along the derivatives of all errors, cut at the bounds; one that doesn't lessen the error is tried shorter, so it never grows.
    """
    at, damping = np.clip(start, low, high), np.full(len(start), 1e-3)
    errors, jacobian, states = recursion(y, at, period)
    sums, open_ = (errors**2).sum(axis=1), np.ones(len(at), bool)
    for _ in range(ESTIMATES):
        # A parameter at its bound that would leave it stays there.
        slope = np.einsum("nt,ntp->np", errors, jacobian)
        moves = free & ~((at <= low) & (slope > 0)) & ~((at >= high) & (slope < 0))
        each = jacobian * moves[:, None, :]
        square = np.einsum("ntp,ntq->npq", each, each)
        scale = np.einsum("npp->np", square) + 1e-12 * (1 + np.einsum("npp->n", square))[:, None]
        square[:, np.arange(at.shape[1]), np.arange(at.shape[1])] += damping[:, None] * scale + ~moves
        step = -np.linalg.solve(square, (slope * moves)[:, :, None])[:, :, 0] * moves
        trial = np.where(open_[:, None], np.clip(at + step, low, high), at)
        found = recursion(y, trial, period)
        after = (found[0] ** 2).sum(axis=1)
        better = open_ & np.isfinite(after) & (after < sums)
        damping = np.where(better, damping / 4, damping * 5)
        open_ &= np.where(better, sums - after > GAIN * sums, damping < 1e12)
        for now, new in ((at, trial), (errors, found[0]), (jacobian, found[1]), (states, found[2]), (sums, after)):
            now[better] = new[better]
        if not open_.any():
            break
    return at, errors, states


def holt_winters_forecast(y: np.ndarray, horizon: int, period: int = PERIOD, trend: bool = True, damped: bool = False) -> np.ndarray:
    """Forecasts of one series: weights and states of least error, estimated from the best weights of a grid; at least 0."""
    if len(y) < 2 * period:
        raise ValueError("two periods of history are needed")
    if not np.isfinite(y).all():
        raise ValueError("the history has to be finite")
    at, _, states = fitted(y, period, trend, damped)
    steps = np.cumsum(at[3] ** np.arange(1, horizon + 1)) if trend else np.zeros(horizon)
    ahead = states[0] + steps * states[1] + np.array([states[2 + (len(y) + h) % period] for h in range(horizon)])
    if not np.isfinite(ahead).all():
        raise ValueError("the fit does not converge")
    return ahead.clip(0.0)


def fitted(y: np.ndarray, period: int, trend: bool, damped: bool) -> tuple[np.ndarray, float, np.ndarray]:
    """Parameters, summed squared error and states at the end."""
    weights = grid_weights(y, period, trend, damped)
    start = np.r_[weights, first_states(y, period, trend)]
    if not trend:
        start[[1, 3]] = 0.0
    size = len(start)
    free = np.ones(size, bool)
    free[[1, 5]], free[3] = trend, trend and damped
    low, high = np.full(size, -np.inf), np.full(size, np.inf)
    low[:3], high[:3] = WEIGHTS
    if free[3]:
        low[3], high[3] = DAMPED
    low[~free], high[~free] = start[~free], start[~free]
    at, errors, states = estimated(y, start[None], free[None], low, high, period)
    return at[0], float((errors[0] ** 2).sum()), states[0]


def grid_weights(y: np.ndarray, period: int, trend: bool, damped: bool) -> np.ndarray:
    """The weights of least error of a coarse grid, narrowed around its best once."""
    centre, width = np.array([0.5, 0.5, 0.5, 0.9 if damped else 1.0]), np.array([0.5, 0.5 if trend else 0.0, 0.5, 0.1 if trend and damped else 0.0])
    for _ in range(2):
        axes = [np.unique(np.clip(np.linspace(c - w, c + w, 5), 1e-4, 1.0 if i == 3 else 0.9999)) for i, (c, w) in enumerate(zip(centre, width, strict=True))]
        weights = np.stack([x.ravel() for x in np.meshgrid(*axes)], axis=1)
        error, _ = smoothed(y, weights, period, 1, trend)
        centre, width = weights[int(np.nanargmin(error))], width / 2.5
    return centre


def holt_winters(series: DataFrame, ends: tuple[int, ...] = TRAIN_ENDS, horizon: int = HORIZON, period: int = PERIOD, trend: bool = True, damped: bool = False) -> DataFrame:
    """Forecasts per (target, train_end). There is no built-in recursion, so each window, which is one short series, is one pandas group."""
    spark = series.sparkSession
    windows = F.broadcast(spark.createDataFrame([(e,) for e in ends], "train_end long"))
    train = by_target(series).join(windows, F.col("step") <= F.col("train_end"))

    def forecast(group: pd.DataFrame) -> pd.DataFrame:
        ahead = holt_winters_forecast(group.sort_values("step")["y"].to_numpy(float), horizon, period, trend, damped)
        end = int(group["train_end"].iloc[0])
        return pd.DataFrame({"train_end": end, "target": group["target"].iloc[0], "step": [end + h for h in range(1, horizon + 1)], "p": ahead})

    return train.groupBy("train_end", "target").applyInPandas(forecast, "train_end long, target string, step long, p double")


def by_target(series: DataFrame) -> DataFrame:
    """(step, target, y): counts and amounts of a series one below the other."""
    return series.select("step", F.explode(F.create_map(F.lit("count"), F.col("transaction_count").cast("double"), F.lit("amount"), F.col("total_amount"))).alias("target", "y"))


@query("fc03_holt_winters")
def holt_winters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors per window of the three variants: no trend, trend, damped trend; fits have no SQL, a test holds goldens."""
    rows = gold(spark, sf_dir)
    guesses = reduce(DataFrame.union, [holt_winters(rows, trend=t, damped=d).withColumn("model", F.lit(m)) for m, (t, d) in VARIANTS.items()])
    return guesses.join(by_target(rows), ["step", "target"]).groupBy("train_end", "target", "model").agg(F.count("*").alias("n"), *forecast_errors())


#: Models from the simplest to the least simple: of equal errors the first is chosen.
MODELS = ("naive", "seasonal_naive", "holt_winters_level", "holt_winters", "holt_winters_damped")
VARIANTS = {"holt_winters_level": (False, False), "holt_winters": (True, False), "holt_winters_damped": (True, True)}


def all_errors(rows: DataFrame, ends: tuple[int, ...] = TRAIN_ENDS, horizon: int = HORIZON, period: int = PERIOD) -> DataFrame:
    """Metrics of every model on every window of each target."""
    smooth = reduce(DataFrame.union, [holt_winters(rows, ends, horizon, period, t, d).withColumn("model", F.lit(m)) for m, (t, d) in VARIANTS.items()])
    guesses = smooth.join(by_target(rows), ["step", "target"]).select("train_end", "target", "step", "y", "model", "p")
    every = backtest_rows(rows, ends, horizon, period).unionByName(guesses)
    return every.groupBy("train_end", "target", "model").agg(F.count("*").alias("n"), *forecast_errors(None))


def chosen_models(errors: DataFrame) -> DataFrame:
    """Means of each model's metrics over the windows of a target, and whether it has the least mean absolute error, of equal ones the simplest."""
    means = errors.groupBy("target", "model").agg(F.count("*").alias("windows"), *[F.avg(c).alias(c) for c in ("mae", "rmse", "smape")])
    place = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    first = Window.partitionBy("target").orderBy(F.round("mae", 9), place)  # a row a model
    return means.withColumn("chosen", F.row_number().over(first) == 1)


@query("fc04_model_choice")
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models' means over the windows and the choice for each target."""
    return chosen_models(all_errors(stored(gold(spark, sf_dir), "gold")))


@query("fc04_agg28_backtest_means", f"{BACKTEST}, e AS (SELECT train_end, target, model, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, avg(CASE WHEN abs(y) + abs(p) = 0 THEN 0 ELSE 200 * abs(y - p) / (abs(y) + abs(p)) END) AS smape FROM m GROUP BY train_end, target, model) SELECT target, model, count(*) AS windows, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(smape), 6) AS smape FROM e GROUP BY target, model")
def backtest_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of each window's metrics, by target and model."""
    by_window = backtest_rows(gold(spark, sf_dir)).groupBy("train_end", "target", "model").agg(*forecast_errors(None))
    return by_window.groupBy("target", "model").agg(F.count("*").alias("windows"), *[F.round(F.avg(c), 6).alias(c) for c in ("mae", "rmse", "smape")])


def _window(name: str, bounds: tuple[int, int]) -> str:
    return f"SELECT '{name}' AS span, * FROM ev WHERE step BETWEEN {bounds[0]} AND {bounds[1]}"


SPANS = f"WITH {EV}, s AS ({_window('reference', REFERENCE)} UNION ALL {_window('observed', OBSERVED)})"


def spans(rows: DataFrame) -> DataFrame:
    return rows.withColumn("span", F.when(F.col("step").between(*REFERENCE), "reference").when(F.col("step").between(*OBSERVED), "observed")).where("span is not null")


LENGTH = f"CASE WHEN span = 'reference' THEN {REFERENCE[1] - REFERENCE[0] + 1} ELSE {OBSERVED[1] - OBSERVED[0] + 1} END"


@query("agg18_window_summary", f"{SPANS} SELECT span, count(*) AS n, count(DISTINCT step) AS steps, CAST({LENGTH} - count(DISTINCT step) AS BIGINT) AS missing_steps, round(count(*) / {LENGTH}, 6) AS n_per_step, round(round(sum(amount), 2) / {LENGTH}, 6) AS total_per_step, round(sum(amount), 2) AS total, round(avg(amount), 6) AS mean, round(avg(isFraud), 9) AS fraud_rate, concat_ws(',', {', '.join(f"CASE WHEN count(*) FILTER (WHERE type = '{t}') > 0 THEN '{t}=' || round(count(*) FILTER (WHERE type = '{t}') / count(*), 6)::DECIMAL(8,6)::VARCHAR END" for t in EVENT_TYPES)}) AS type_mix, " + ", ".join(f"round(quantile_cont(amount, {q}), 6) AS p{int(q * 100)}" for q in DRIFT_QUANTILES) + " FROM s GROUP BY span")
def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(events_by_hour(spark, sf_dir))
    found = quantiles(rows, "amount", DRIFT_QUANTILES, "span")
    kinds = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in EVENT_TYPES]
    sums = rows.groupBy("span").agg(F.count("*").alias("n"), F.count_distinct("step").alias("steps"), F.round(F.sum("amount"), 2).alias("total"), F.round(F.avg("amount"), 6).alias("mean"), F.round(F.avg("isFraud"), 9).alias("fraud_rate"), *kinds)
    length = F.when(F.col("span") == "reference", REFERENCE[1] - REFERENCE[0] + 1).otherwise(OBSERVED[1] - OBSERVED[0] + 1)
    values = [F.coalesce(*[F.when(F.col("span") == k, F.lit(v[i]).cast("double")) for k, v in found.items()]) for i in range(len(DRIFT_QUANTILES))] if found else [F.lit(None).cast("double")] * len(DRIFT_QUANTILES)
    mix = F.concat_ws(",", *[F.when(F.col(f"n_{t}") > 0, F.concat(F.lit(f"{t}="), F.round(F.col(f"n_{t}") / F.col("n"), 6).cast("decimal(8,6)").cast("string"))) for t in EVENT_TYPES])
    return sums.select("span", "n", "steps", (length - F.col("steps")).cast("long").alias("missing_steps"), F.round(F.col("n") / length, 6).alias("n_per_step"), F.round(F.col("total") / length, 6).alias("total_per_step"), "total", "mean", "fraud_rate", mix.alias("type_mix"), *[F.round(v, 6).alias(f"p{int(q * 100)}") for v, q in zip(values, DRIFT_QUANTILES, strict=True)])


def total_variation(rows: DataFrame, key: str) -> DataFrame:
    """Half the summed difference of both spans' shares of a key."""
    counts = rows.groupBy(key).agg(F.count_if(F.col("span") == "reference").alias("r"), F.count_if(F.col("span") == "observed").alias("o"))
    totals = counts.agg(F.sum("r").alias("tr"), F.sum("o").alias("to"))
    return counts.crossJoin(F.broadcast(totals)).agg((F.sum(F.abs(F.col("r") / F.col("tr") - F.col("o") / F.col("to"))) / 2).alias("tvd"))


DRIFT = f"{SPANS}, e AS (SELECT list_sort(list_distinct(quantile_cont(amount, {DRIFT_QUANTILES}))) AS edges FROM s WHERE span = 'reference'), b AS (SELECT s.*, len(list_filter(edges, lambda x: x <= amount)) AS bin FROM s, e), n AS (SELECT count(*) FILTER (WHERE span = 'reference')::DOUBLE AS r, count(*) FILTER (WHERE span = 'observed')::DOUBLE AS o, avg(isFraud) FILTER (WHERE span = 'reference') AS fr, avg(isFraud) FILTER (WHERE span = 'observed') AS fo, sum(amount) FILTER (WHERE span = 'reference') AS ar, sum(amount) FILTER (WHERE span = 'observed') AS ao FROM s), ta AS (SELECT sum(abs(x / r - y / o)) / 2 AS v FROM (SELECT bin, count(*) FILTER (WHERE span = 'reference') AS x, count(*) FILTER (WHERE span = 'observed') AS y FROM b GROUP BY bin), n), tt AS (SELECT sum(abs(x / r - y / o)) / 2 AS v FROM (SELECT type, count(*) FILTER (WHERE span = 'reference') AS x, count(*) FILTER (WHERE span = 'observed') AS y FROM b GROUP BY type), n), m AS (SELECT 'count' AS metric, (o - r) / abs(r) AS value, 0.5 AS threshold FROM n UNION ALL SELECT 'amount', (ao - ar) / abs(ar), 0.5 FROM n UNION ALL SELECT 'amount_tvd', v, 0.2 FROM ta UNION ALL SELECT 'type_tvd', v, 0.2 FROM tt UNION ALL SELECT 'fraud_rate', (fo - fr), 0.2 FROM n)"


@query("agg19_agg20_agg21_drift", f"{DRIFT} SELECT metric, round(value, 6) AS value, threshold::DOUBLE AS threshold, (value IS NULL OR abs(value) >= threshold) AS alert FROM m")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two equal spans and whether each is an alert: counts, amounts, shares of amounts and types, fraud rate."""
    rows = spans(events_by_hour(spark, sf_dir))
    edges = sorted({q for q in quantiles(rows.where("span = 'reference'"), "amount", DRIFT_QUANTILES)[None] if q is not None})
    binned = rows.withColumn("bin", C.bin_left(F.col("amount"), F.array(*[F.lit(e) for e in edges]).cast("array<double>")))
    amounts, types = total_variation(binned, "bin").withColumnRenamed("tvd", "a"), total_variation(rows, "type").withColumnRenamed("tvd", "t")
    both = rows.groupBy().pivot("span", ["reference", "observed"]).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("amount").alias("s"), F.avg("isFraud").alias("f"))
    one = both.crossJoin(amounts).crossJoin(types)

    def change(c: str):
        r, o = F.col(f"reference_{c}"), F.col(f"observed_{c}")
        return F.when(r == 0, F.when(o == 0, 0.0)).otherwise((o - r) / F.abs(r))

    metrics = [("count", change("n"), 0.5), ("amount", change("s"), 0.5), ("amount_tvd", F.col("a"), 0.2), ("type_tvd", F.col("t"), 0.2), ("fraud_rate", F.col("observed_f") - F.col("reference_f"), 0.2)]
    listed = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value"), F.lit(t).alias("threshold")) for n, v, t in metrics])))
    return listed.select("metric", F.round("value", 6).alias("value"), "threshold", (F.col("value").isNull() | (F.abs("value") >= F.col("threshold"))).alias("alert"))


STATUS = "SELECT CAST(count(*) FILTER (WHERE alert) AS BIGINT) AS alert_count, string_agg(metric, ',' ORDER BY metric) FILTER (WHERE alert) AS alerts, CASE WHEN bool_or(alert) THEN 'change_detected' ELSE 'stable' END AS status FROM d"


def monitoring_summary(changes: DataFrame) -> DataFrame:
    """One row of a drift run's (metric, value, threshold, alert): how many alerts, which, and the status; a run without metrics is refused."""
    if missing := sorted({"metric", "value", "threshold", "alert"} - set(changes.columns)):
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    # As many rows as metrics.
    names = F.array_join(F.array_sort(F.collect_list(F.when(F.col("alert"), F.col("metric")))), ",")
    found = changes.agg(F.count_if("alert").alias("alert_count"), F.nullif(names, F.lit("")).alias("alerts"), F.when(F.max("alert"), "change_detected").otherwise("stable").alias("status"), F.count("*").alias("metrics"))
    if not found.first()["metrics"]:
        raise ValueError("the run has no metrics")
    return found.drop("metrics")


@query("fc06_monitoring_summary", DRIFT + ", d AS (SELECT metric, (value IS NULL OR abs(value) >= threshold) AS alert FROM m) " + STATUS)
def monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring_summary(drift(spark, sf_dir))
