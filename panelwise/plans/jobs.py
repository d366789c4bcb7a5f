"""Jobs that assemble the operators: cleaning, core analysis, advanced modules, checks.

A job returns lazy named outputs over tables written once to the shared folder (the
panel and the profiles), so writing many outputs does not repeat the fact joins.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from panelwise.operators import anomaly, attribution, causal, clean, cluster, drift, forecast, indices, quality, robust, rollup, stats, synthetic
from panelwise.operators.rollup import BANDS_OF
from panelwise.session import materialize

log = logging.getLogger(__name__)


def clean_job(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Clean three raw feeds; b and c keep only entities known to a.

    ``raw`` maps feed letters to frames with ``date, entity, area, site`` and bands.
    """
    cleaned = {
        feed: clean.clean_rows(df.select("date", "entity", "area", "site", *BANDS_OF[feed]), BANDS_OF[feed]) for feed, df in raw.items()
    }
    out = {feed: clean.dedupe(df) for feed, df in cleaned.items()}
    if len(out) > 1:
        # written once: feed a is not cleaned again for each other feed
        known = materialize(cleaned["a"].select("entity").distinct())
        out |= {feed: clean.keep_known(df, known, "entity") for feed, df in out.items() if feed != "a"}
    return out


def core_job(a: DataFrame, b: DataFrame, c: DataFrame, ensemble: bool = False) -> dict[str, DataFrame]:
    """Fifteen named outputs from three cleaned fact tables."""
    ready = {f"{n}_ready": rollup.row_totals(rollup.calendar(df), n) for n, df in (("a", a), ("b", b), ("c", c))}
    panel = materialize(rollup.build_panel(a, b, c))
    profile = materialize(indices.index_profile(rollup.entity_profile(panel)))
    scores = anomaly.detect(profile) if ensemble else None
    flagged = materialize(indices.anomaly_flags(profile, scores))
    focus = indices.focus_summary(flagged)
    ranks = profile.select("entity", "a_total", "b_total", "c_total", "a_rank", "b_rank", "c_rank")
    return ready | {
        "panel": panel,
        "stability": rollup.variation_by_entity(panel),
        "lag_features": rollup.lag_correlation(panel),
        "rank_persistence": ranks,
        "rank_correlations": stats.spearman(materialize(ranks), [("rho_a_b", "a_rank", "b_rank"), ("rho_a_c", "a_rank", "c_rank")]),
        "profile": focus,
        "anomalies": flagged.orderBy(*indices.anomaly_order()),
        "focus_summary": focus.orderBy(*indices.focus_order()),
        "period_summary": rollup.period_summary(panel).orderBy("period"),
        "pareto": indices.pareto(profile),
        "activity_correlation": stats.corr_matrix(panel, ["a_total", "b_total", "c_total", "update_ratio", "a1_share", "b2_share", "c2_share"]),
        "index_correlation": stats.corr_matrix(profile, indices.INDICES),
    }


def robust_job(profile: DataFrame, panel: DataFrame) -> dict[str, DataFrame]:
    detail = materialize(robust.entropy_predictability(panel))
    return {"robust": robust.robust_indices(profile, detail), "entropy": detail}


def causal_job(panel: DataFrame, max_lag: int = 3) -> dict[str, DataFrame]:
    return {"granger": causal.granger(panel, max_lag=max_lag), "cusum": causal.cusum_test(panel)}


def advanced_job(core: Mapping[str, DataFrame], baseline: DataFrame | None = None, k_range=(2, 8), trees: int = 100) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """All advanced modules in a fixed order; a failing one is reported and skipped.

    Every module's outputs are written when it runs, so its failure shows here.
    """
    panel, profile = core["panel"], materialize(core["profile"])
    modules: list[tuple[str, Callable[[], Mapping[str, DataFrame]]]] = [
        ("robust", lambda: robust_job(profile, panel)),
        ("cluster", lambda: cluster.run(profile, k_range=k_range)),
        ("causal", lambda: causal_job(panel)),
        ("forecast", lambda: dict(zip(("forecast", "forecast_summary"), forecast.run_trend(panel, "b_total")))),
        ("anomaly", lambda: {"ensemble": anomaly.detect(profile)}),
        ("attribution", lambda: attribution.run(profile, trees=trees)),
        ("drift", lambda: {"drift_report": drift.baseline_check(baseline, profile, indices.INDICES)}),
    ]
    done: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for name, run in modules:
        try:
            done |= {k: materialize(v) for k, v in run().items()}
        except Exception as e:  # noqa: BLE001 - one module must not stop the others
            log.warning("module %s failed: %s", name, e)
            failed[name] = f"{type(e).__name__}: {e}"
    return done, failed


def validate_job(feeds: Mapping[str, DataFrame], profile: DataFrame | None = None, keys: Sequence[str] = ("entity", "date", "area", "site"), run_date: str | None = None) -> DataFrame:
    """Checks for whichever tables are given, one pass per table, one report. ``run_date`` is the latest date allowed."""
    parts = []
    for name, df in feeds.items():
        checks = [quality.not_null("entity"), quality.not_null("date"), quality.date_range("date", high=run_date), *quality.all_non_negative(df)]
        unique = [k for k in keys if k in df.columns]
        checks.append(quality.unique(unique, "unique_key"))
        parts.append(quality.as_report(quality.run_checks(df, name, checks)))
    if profile is not None:
        checks = [quality.not_null("entity"), quality.unique(["entity"]), *quality.index_bounds(indices.INDICES), *[quality.not_null(i) for i in indices.INDICES]]
        parts.append(quality.as_report(quality.run_checks(profile, "profile", checks)))
    return stats.union_all(parts)


def counterfactual_job(panel: DataFrame, treated: str, value: str, intervention: str, exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
    p = materialize(panel.select("entity", "period", value))
    fitted = materialize(synthetic.fit(p, [treated], value, intervention, exclude=exclude))
    weights = synthetic.weights_of(fitted)
    effects = materialize(synthetic.effect_series(p, weights, value, intervention))
    placebos = materialize(synthetic.placebo_effects(p, treated, value, intervention, exclude))
    return {
        "weights": weights,
        "effects": effects,
        "fit": synthetic.fit_quality(effects).join(fitted.select("treated", "gap", "converged", "n_periods"), "treated", "right"),
        "average_effect": synthetic.average_effect(effects),
        "placebo_effects": placebos,
        "placebo": synthetic.placebo_share(placebos),
    }


def scoped_job(a: DataFrame, b: DataFrame, c: DataFrame, start: str | None, end: str | None, entities: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The core job on filtered facts: indices become relative to the scope."""
    cut = [stats.in_scope(f, start, end, entities) for f in (a, b, c)]
    stats.require_rows(a=cut[0], b=cut[1], c=cut[2])
    return core_job(*cut)
