"""Counterfactuals: weighted donors imitate a treated entity before an intervention.

One way at every size. Each entity's pre-period values become one array. A unit's weights solve a small problem over a
working set of donors, from their Gram matrix, in a task of its own; a pricing pass then compares every unit
with every donor, block by block as matrix products, and each unit takes in the donors that would
improve it most. A unit is done when no donor is left that would, which is the optimality condition of the whole problem: the
result does not depend on the size of the working set or of a block. Real and placebo units go through the same passes.

Only (unit, donor) pairs that improve a fit and the series leave a pass; no panel, pool or matrix comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.tails import t_tail
from panelwise.operators.ordered import with_row
from panelwise.session import materialize

#: donors that a unit takes in at once, entities in a block of the pricing pass
TAKEN, BLOCK = 256, 1024
ROUNDS = 100
#: pricing tolerance and the gap up to which a fit counts as converged, as shares of the unit's sum of squares
TOL, GAP = 1e-11, 1e-8
RIDGE = 0.1


def donor_pool(panel: DataFrame, treated: str, exclude: Sequence[str] = ()) -> DataFrame:
    """All entities but the treated and the excluded ones."""
    spark = panel.sparkSession
    out = spark.createDataFrame([(e,) for e in [treated, *exclude]], "entity string")
    return panel.select("entity").distinct().join(out, "entity", "left_anti")


def donor_pairs(panel: DataFrame, treated: Sequence[str], value: str) -> DataFrame:
    """Treated rows beside every donor's row of the same period.

    Linear in the panel for a given list of treated entities.
    """
    t = panel.where(F.col("entity").isin(list(treated))).select(F.col("entity").alias("treated"), "period", F.col(value).alias("y"))
    d = panel.select(F.col("entity").alias("donor"), "period", F.col(value).alias("x"))
    return t.join(d, "period").where(F.col("treated") != F.col("donor"))


def active_set(g: np.ndarray, b: np.ndarray, affine: bool = True) -> np.ndarray:
    """min w'Gw/2 - b'w with w >= 0, and sum 1 if ``affine``.

    The passive set gains the donor with the steepest slope and loses those that its own optimum would make
    negative; a donor that gains strictly is affinely independent of the passive ones, so the small systems can be solved.
    """
    n = len(b)
    if n == 0:
        return np.zeros(0)
    w, held = np.zeros(n), []
    if affine:
        held = [int(np.argmin(np.diag(g) / 2 - b))]
        w[held] = 1.0
    size = max(np.abs(np.diag(g)).max(), np.abs(b).max(), 1e-300)
    for _ in range(20 * n + 100):
        slope = g @ w - b
        level = float(w @ slope) if affine else 0.0
        slope[held] = np.inf
        j = int(np.argmin(slope))
        if not slope[j] < level - 1e-14 * size:
            break
        before = held.copy()
        held.append(j)
        while True:
            k = len(held)
            if affine:
                system = np.ones((k + 1, k + 1))
                system[:k, :k], system[k, k] = g[np.ix_(held, held)] / size, 0.0
                z = np.linalg.lstsq(system, np.append(b[held] / size, 1.0), rcond=1e-15)[0][:k]
            else:
                z = np.linalg.solve(g[np.ix_(held, held)], b[held])
            low = z <= 0
            if not low.any():
                w[held] = z
                break
            own = w[held]
            share = min(float((own[low] / np.maximum(own[low] - z[low], 1e-300)).min()), 1.0)
            own = np.maximum(own + share * (z - own), 0.0)
            own[low & (own <= 1e-15)] = 0.0
            if not (own == 0).any():
                own[np.flatnonzero(low)[int(np.argmin(own[low]))]] = 0.0
            w[held] = own
            held = [h for h, v in zip(held, own) if v > 0]
            if not held:
                break
        if affine and held:
            w /= w.sum()
        if held == before:
            break
    return w


def _dense(at, values, n: int) -> np.ndarray:
    out = np.full(n, np.nan)
    out[np.asarray(at, dtype=int)] = np.asarray(values, dtype=float)
    return out


def _solver(n: int, method: str, alpha: float):
    """Grouped solve of one unit over its working set: rows (unit, y_at, y, donor, x)."""

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        y = _dense(pdf["y_at"].iloc[0], pdf["y"].iloc[0], n)
        shared = ~np.isnan(y)
        pdf = pdf.sort_values("donor")
        x = np.array([np.asarray(v, dtype=float) for v in pdf["x"]])[:, shared].T
        y = y[shared]
        scale = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0)) or 1.0
        gram, cross = x.T @ x / scale**2, x.T @ y / scale**2
        if method == "ridge":
            w = active_set(gram + alpha / scale**2 * np.eye(len(cross)), cross, affine=False)
        else:
            w = active_set(gram, cross)
        rest = np.zeros(n)
        rest[shared] = x @ w - y
        slope = x.T @ rest[shared]
        level = float(w @ slope) if method == "simplex" else 0.0
        donors, used = pdf["donor"].to_numpy(), w > 0
        return pd.DataFrame([{
            "unit": key[0], "donors": list(donors[used]), "weights": list(w[used]), "tried": list(donors),
            "rest": list(rest), "shared": list(shared), "level": level, "energy": float(y @ y), "n_periods": int(shared.sum()),
        }])

    return solve


_STATE = "unit string, donors array<string>, weights array<double>, tried array<string>, rest array<double>, shared array<boolean>, level double, energy double, n_periods int"
_PRICED = "unit string, donor string, gain double"


def _gains(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["unit", "donor", "gain"]).astype({"unit": object, "donor": object, "gain": float})


def _pricer(first: bool, taken: int, method: str):
    """Best donors of a block for a block of units: by slope, or by distance where no donor is taken yet."""

    def price(units: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        if units.empty or donors.empty:
            return _gains([])
        x = np.array([np.asarray(v, dtype=float) for v in donors["x"]])
        rest = np.array([np.asarray(v, dtype=float) for v in units["rest"]])
        slope = rest @ x.T
        if first:
            slope += np.array([np.asarray(v, dtype=float) for v in units["shared"]]) @ (x * x).T / 2
        names = donors["entity"].to_numpy(dtype=object)
        out: list[tuple] = []
        for k, (unit, level, energy, tried) in enumerate(zip(units["unit"], units["level"], units["energy"], units["tried"])):
            gain = np.where(names == unit, -np.inf, level - slope[k])
            if not first:
                fresh = ~np.isin(names, np.asarray(tried, dtype=object))
                if method == "ridge":  # under the penalty the slopes of the donors taken are not level
                    gain = np.where(fresh, gain, -np.inf)
                if (gain > -np.inf).any():  # the gap of the block, under no donor's name
                    out.append((unit, None, float(gain.max())))
                gain = np.where(fresh & (gain > TOL * energy), gain, -np.inf)
            open_ = gain > -np.inf
            picked = np.flatnonzero(open_)
            picked = picked[np.argsort(-gain[picked], kind="stable")[:taken]]
            out += [(unit, names[p], float(gain[p])) for p in picked]
        return _gains(out)

    return lambda key, left, right: price(left, right)


def _blocks(df: DataFrame, key: str, own: str, own_count: int, other: str, other_count: int) -> DataFrame:
    """Each row under its own block, beside every block of the other side."""
    own_block = F.pmod(F.xxhash64(key), F.lit(own_count)).cast("int")
    return df.withColumn(own, own_block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_count - 1))))


def _price(state: DataFrame, series: DataFrame, units: int, donors: int, first: bool, taken: int, block: int, method: str) -> DataFrame:
    """(unit, donor, gain): every unit against every donor, in blocks."""
    n_u, n_d = -(-max(units, 1) // block), -(-max(donors, 1) // block)
    left = _blocks(state.select("unit", "rest", "shared", "level", "energy", "tried"), "unit", "ub", n_u, "db", n_d)
    right = _blocks(series, "entity", "db", n_d, "ub", n_u)
    return left.groupBy("ub", "db").cogroup(right.groupBy("ub", "db")).applyInPandas(_pricer(first, taken, method), _PRICED)


def fit(
    panel: DataFrame,
    treated: Sequence[str] | DataFrame,
    value: str,
    intervention: str,
    method: str = "simplex",
    exclude: Sequence[str] = (),
    alpha: float = RIDGE,
    taken: int = TAKEN,
    block: int = BLOCK,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(treated, donors, weights, gap, converged, n_periods): donors with a positive weight for each treated entity.

    ``treated`` is a list or a one-column table ``entity``. Donors are all entities but the excluded ones and the treated entity
    itself; values are those of the periods before ``intervention`` that all donors and the treated entity hold. Excluded
    entities shorten no one's periods. ``method`` is ``simplex`` (w >= 0, sum 1) or ``ridge`` (w >= 0 under the
    penalty ``alpha``, then scaled to sum 1). ``gap`` bounds, as a share of the treated entity's sum of squares, how far the fit is from
    the optimum (for ridge: how steep the best donor left out still is); ``converged`` says that it is below ``GAP``.
    A treated entity without shared periods or without donors has no row.
    """
    spark = panel.sparkSession
    pre = materialize(panel.where(F.col("period") < F.to_date(F.lit(intervention))).select("entity", "period", F.col(value).cast("double").alias("v")).where("v IS NOT NULL"))
    pool = pre if not exclude else pre.where(~F.col("entity").isin([*exclude]))
    units = treated.select(F.col(treated.columns[0]).alias("unit")) if isinstance(treated, DataFrame) else spark.createDataFrame([(t,) for t in treated], "unit string")
    units = units.distinct()
    n_donors, n_units = pool.select("entity").distinct().count(), units.count()
    whole = pool.groupBy("period").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") == n_donors)
    # one row a period of the calendar
    numbered = materialize(whole.select("period", (F.row_number().over(Window.orderBy("period")) - 1).alias("at")))
    n = numbered.count()
    pairs = F.array_sort(F.collect_list(F.struct("at", "v")))
    wide = materialize(pre.join(numbered, "period").groupBy("entity").agg(pairs.alias("s")).select("entity", F.col("s.at").alias("y_at"), F.col("s.v").alias("y")))
    donors = wide if not exclude else wide.where(~F.col("entity").isin([*exclude]))
    donors = donors.select("entity", F.col("y").alias("x"))
    own = wide.join(units, wide["entity"] == units["unit"]).select("unit", "y_at", "y")

    places = F.sequence(F.lit(0), F.lit(max(n, 1) - 1))
    value_at = F.map_from_arrays("y_at", "y")
    start = own.select(
        "unit",
        F.transform(places, lambda p: -F.coalesce(F.element_at(value_at, p), F.lit(0.0))).alias("rest"),
        F.transform(places, lambda p: F.element_at(value_at, p).isNotNull()).alias("shared"),
        F.lit(0.0).alias("level"), F.lit(0.0).alias("energy"), F.array().cast("array<string>").alias("tried"),
    )
    best = Window.partitionBy("unit").orderBy(F.desc("gain"), "donor")
    top = lambda priced: priced.where("donor IS NOT NULL").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= taken).select("unit", "donor")
    working = top(_price(start, donors, n_units, n_donors, True, taken, block, method))
    solver = _solver(n, method, alpha)
    done = []
    for turn in range(rounds):
        cells = working.join(own, "unit").join(donors.withColumnRenamed("entity", "donor"), "donor").select("unit", "y_at", "y", "donor", "x")
        state = materialize(cells.groupBy("unit").applyInPandas(solver, _STATE))
        priced = materialize(_price(state, donors, n_units, n_donors, False, taken, block, method))
        fresh = materialize(top(priced))
        open_units = fresh.select("unit").distinct()
        gaps = priced.groupBy("unit").agg(F.max("gain").alias("gain"))
        ready = state.join(gaps, "unit", "left")
        if turn + 1 == rounds or fresh.isEmpty():
            done.append(ready)
            break
        done.append(ready.join(open_units, "unit", "left_anti"))
        active = state.join(open_units, "unit", "left_semi").select("unit", F.explode("donors").alias("donor"))
        working = active.union(fresh)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    gap = F.coalesce(F.try_divide(F.greatest("gain", F.lit(0.0)), F.col("energy")), F.lit(0.0))
    total = F.aggregate("weights", F.lit(0.0), lambda acc, w: acc + w)
    scaled = F.transform("weights", lambda w: w / total) if method == "ridge" else F.col("weights")
    return out.select(F.col("unit").alias("treated"), "donors", scaled.alias("weights"), gap.alias("gap"), (gap <= GAP).alias("converged"), "n_periods")


def weights_of(fitted: DataFrame) -> DataFrame:
    """(treated, donor, weight), positive weights only."""
    pairs = F.explode(F.arrays_zip("donors", "weights")).alias("p")
    return fitted.select("treated", pairs).select("treated", F.col("p.donors").alias("donor"), F.col("p.weights").alias("weight"))


def fit_weights(panel: DataFrame, treated: Sequence[str] | DataFrame, value: str, intervention: str, method: str = "simplex", exclude: Sequence[str] = (), **how) -> DataFrame:
    """Weights ``(treated, donor, weight)`` of :func:`fit`."""
    return weights_of(fit(panel, treated, value, intervention, method, exclude, **how))


def optimality(panel: DataFrame, weights: DataFrame, value: str, intervention: str, exclude: Sequence[str] = (), alpha: float | None = None) -> DataFrame:
    """(treated, n_donors, n_periods, total, least, gap) of any weights, from the panel alone.

    For the simplex, ``gap`` is sum(w slope) - min(slope) over all donors as a share of the treated entity's sum of squares: 0 at the optimum
    and nowhere else. With ``alpha`` the weights are first scaled back to the best multiple under the penalty.
    """
    pre = materialize(panel.where(F.col("period") < F.to_date(F.lit(intervention))).select("entity", "period", F.col(value).cast("double").alias("v")).where("v IS NOT NULL"))
    pool = pre if not exclude else pre.where(~F.col("entity").isin([*exclude]))
    held = F.count_distinct("entity")
    whole = with_row(pool.groupBy("period").agg(held.alias("c")), pool.agg(held.alias("all"))).where("c = all").select("period")
    units = weights.select("treated").distinct()
    y = materialize(pre.join(whole, "period").join(units, pre["entity"] == units["treated"]).select("treated", "period", F.col("v").alias("y")))
    x = pool.join(whole, "period").select(F.col("entity").alias("donor"), "period", F.col("v").alias("x"))
    made = weights.join(x, "donor").groupBy("treated", "period").agg(F.sum(F.col("weight") * F.col("x")).alias("s"))
    both = y.join(made, ["treated", "period"])
    if alpha is not None:
        squares = weights.groupBy("treated").agg(F.sum(F.col("weight") * F.col("weight")).alias("ww"))
        factor = both.groupBy("treated").agg(F.sum(F.col("s") * F.col("y")).alias("sy"), F.sum(F.col("s") * F.col("s")).alias("ss")).join(squares, "treated")
        factor = factor.select("treated", (F.col("sy") / (F.col("ss") + alpha * F.col("ww"))).alias("factor"))
    else:
        factor = units.select("treated", F.lit(1.0).alias("factor"))
    rest = both.join(factor, "treated").select("treated", "period", "factor", (F.col("s") * F.col("factor") - F.col("y")).alias("rest"), "y")
    slope = rest.join(x, "period").where("treated <> donor").groupBy("treated", "donor", "factor").agg(F.sum(F.col("rest") * F.col("x")).alias("slope"))
    slope = slope.join(weights, ["treated", "donor"], "left").fillna({"weight": 0.0})
    pull = F.col("slope") if alpha is None else F.col("slope") + alpha * F.col("factor") * F.col("weight")
    energy = y.groupBy("treated").agg(F.sum(F.col("y") * F.col("y")).alias("energy"), F.count(F.lit(1)).alias("n_periods"))
    out = slope.groupBy("treated").agg(
        F.count(F.lit(1)).alias("n_donors"), F.sum("weight").alias("total"), F.min("weight").alias("least"), F.sum(F.col("weight") * pull).alias("level"), F.min(pull).alias("steepest")
    )
    return out.join(energy, "treated").select("treated", "n_donors", "n_periods", "total", "least", ((F.col("level") - F.col("steepest")) / F.col("energy")).alias("gap"))


def effect_series(panel: DataFrame, weights: DataFrame, value: str, intervention: str) -> DataFrame:
    """Actual, synthetic, effect and post flag per treated entity and period.

    Periods in which a weighted donor is missing have no synthetic value.
    """
    used = weights.where(F.col("weight") > 0)
    p = panel.select("entity", "period", F.col(value).cast("double").alias("v"))
    made = used.join(p.withColumnRenamed("entity", "donor"), "donor").groupBy("treated", "period").agg(
        F.sum(F.col("weight") * F.col("v")).alias("synthetic"), F.count(F.lit(1)).alias("_c")
    )
    need = used.groupBy("treated").agg(F.count(F.lit(1)).alias("_need"))
    made = made.join(need, "treated").where(F.col("_c") == F.col("_need")).select("treated", "period", "synthetic")
    own = p.select(F.col("entity").alias("treated"), "period", F.col("v").alias("actual"))
    return own.join(made, ["treated", "period"]).select(
        "treated", "period", "actual", "synthetic", (F.col("actual") - F.col("synthetic")).alias("effect"),
        (F.col("period") >= F.to_date(F.lit(intervention))).alias("post"),
    )


def fit_quality(effects: DataFrame) -> DataFrame:
    return effects.where(~F.col("post")).groupBy("treated").agg(F.sqrt(F.avg(F.col("effect") * F.col("effect"))).alias("pre_rmse"))


def average_effect(effects: DataFrame, post_only: bool = True, with_p: bool = True) -> DataFrame:
    """Mean effect with standard error, t statistic, p-value and total per treated entity."""
    rows = effects.where("post") if post_only else effects
    out = rows.groupBy("treated").agg(
        F.avg("effect").alias("ate"), F.stddev_samp("effect").alias("ate_std"), F.sum("effect").alias("cumulative"), F.count(F.lit(1)).alias("n_periods")
    )
    out = out.withColumn("ate_se", F.col("ate_std") / F.sqrt(F.col("n_periods").cast("double")))
    out = out.withColumn("t_statistic", F.try_divide(F.col("ate"), F.col("ate_se")))
    if with_p:
        out = out.withColumn("p_value", t_tail(F.col("t_statistic"), F.col("n_periods") - 1))
        out = out.withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
    return out


def placebo_effects(panel: DataFrame, treated: str, value: str, intervention: str, exclude: Sequence[str] = ()) -> DataFrame:
    """(treated, ate, n_periods, pre_rmse, gap, converged, real): the treated entity and every donor in its place.

    Both have the donors of the treated entity, a placebo without itself; all are fitted in the same passes.
    """
    panel = materialize(panel.select("entity", "period", value))
    out = [treated, *exclude]
    units = panel.where(~F.col("entity").isin([*exclude])).select("entity").distinct()
    fitted = materialize(fit(panel, units, value, intervention, exclude=out))
    effects = materialize(effect_series(panel, weights_of(fitted), value, intervention))
    means = average_effect(effects, with_p=False).select("treated", "ate", "n_periods")
    quality = fitted.select("treated", "gap", "converged").join(fit_quality(effects), "treated", "left")
    return quality.join(means, "treated", "left").select("treated", "ate", "n_periods", "pre_rmse", "gap", "converged", (F.col("treated") == treated).alias("real"))


def placebo_test(panel: DataFrame, treated: str, value: str, intervention: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Share of the placebos whose mean effect is at least as large as the real one.

    ``n_placebos`` counts placebos with an effect, ``n_without`` those that have none (no period with all their donors).
    """
    return placebo_share(materialize(placebo_effects(panel, treated, value, intervention, exclude)))


def placebo_share(effects: DataFrame) -> DataFrame:
    actual = effects.where("real").select(F.max("ate").alias("actual_ate"))
    return with_row(effects.where("NOT real"), actual).agg(
        F.first("actual_ate").alias("actual_ate"),
        F.avg("ate").alias("placebo_mean"),
        F.stddev_pop("ate").alias("placebo_std"),
        F.avg((F.abs("ate") >= F.abs("actual_ate")).cast("double")).alias("p_value"),
        F.count("ate").alias("n_placebos"),
        F.count_if(F.col("ate").isNull()).alias("n_without"),
    ).withColumn("significant", F.col("p_value") < 0.05)
