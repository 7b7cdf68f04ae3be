"""Row-wise derived columns by name.

Inputs are bound by role, so the same formulas serve any table that has them:
daily, social, gaming, work, weekend, sleep, notifications, opens, stress.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import semantics as S

PARTS = ("social", "gaming", "work")
STRESS = {"Low": 0, "Medium": 1, "High": 2}
DEC_COLUMNS = ("daily", "social", "gaming", "work", "sleep", "weekend")
IDENTITY_COLUMNS = (*DEC_COLUMNS, "notifications", "opens", "age")


def _slack() -> Column:
    return F.col("daily") - S.skipna_sum(*PARTS)


def ordinal(c: str = "stress") -> Column:
    return F.coalesce(*[F.when(F.col(c) == k, F.lit(float(v))) for k, v in STRESS.items()])


DERIVED: dict[str, Callable[[], Column]] = {
    "other_screen": lambda: F.col("daily") - S.strict_sum(*PARTS),
    "screen_slack": _slack,
    "screen_slack_n_obs": lambda: F.when(F.col("daily").isNotNull(), S.observed(*PARTS)),
    "sgw_sum": lambda: S.skipna_sum(*PARTS),
    "sgw_frac": lambda: S.skipna_sum(*PARTS) / S.at_least("daily", 0.1),
    "slack_frac": lambda: _slack() / S.at_least("daily", 0.1),
    "wk_minus_sgw": lambda: F.col("weekend") - S.skipna_sum(*PARTS),
    "wk_other": lambda: F.col("weekend") - _slack(),
    "gaming_minus_work": lambda: F.col("gaming") - F.col("work"),
    "screen_minus_work": lambda: F.col("daily") - F.col("work"),
    "weekend_minus_daily": lambda: F.col("weekend") - F.col("daily"),
    "social_share": lambda: S.ratio("social", "daily"),
    "gaming_share": lambda: S.ratio("gaming", "daily"),
    "work_share": lambda: S.ratio("work", "daily"),
    "screen_per_sleep": lambda: S.ratio("daily", "sleep"),
    "total_screen": lambda: F.col("daily") + F.col("weekend"),
    "activity_total": lambda: S.strict_sum(*PARTS),
    "engagement_total": lambda: S.strict_sum("notifications", "opens"),
    "activity_share_screen": lambda: S.ratio(S.strict_sum(*PARTS), "daily"),
    "notif_per_app": lambda: S.ratio("notifications", "opens"),
    "screen_per_app": lambda: S.ratio(F.col("daily") * 60, "opens"),
    "sleep_deficit": lambda: S.at_least(9 - F.col("sleep"), 0.0),
    "log_notifications": lambda: F.log1p("notifications"),
    "log_app_opens": lambda: F.log1p("opens"),
    "screen_x_stress": lambda: F.col("daily") * ordinal(),
    "social_x_stress": lambda: F.col("social") * ordinal(),
    "sleep_x_stress": lambda: F.col("sleep") * ordinal(),
    **{f"{c}_dec1": (lambda c=c: F.floor(S.floor_mod(S.round_even(F.col(c) * 10, 6), 10))) for c in DEC_COLUMNS},
}


def derive(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with the named columns, in one projection; unknown names are an error."""
    unknown = [n for n in names if n not in DERIVED]
    if unknown:
        raise ValueError(f"unknown derived columns: {unknown}")
    return df.select("*", *[DERIVED[n]().alias(n) for n in names])


def identity_digits(c: str) -> dict[str, Column]:
    """Rounded values, distances to them and decimal digits of one column."""
    x = F.col(c)
    r = {d: S.round_even(x, d) for d in (0, 1, 2)}
    digit = lambda scale: F.floor(S.floor_mod(S.round_even(F.abs(x) * scale, 6), 10))
    return {
        **{f"{c}_round{d}": v for d, v in r.items()},
        **{f"{c}_absdiff{d}": F.abs(x - v) for d, v in r.items()},
        **{f"{c}_is_round{d}": (F.abs(x - r[d]) < 1e-9).cast("int") for d in (0, 1)},
        f"{c}_tenths": digit(10),
        f"{c}_hundredths": digit(100),
    }


def constraint_parts() -> dict[str, Column]:
    """Each of daily and its parts as the other three imply it (two decimals)."""
    total = S.round_even(S.strict_sum(*PARTS), 2)
    rest = {p: S.round_even(F.col("daily") - S.strict_sum(*[q for q in PARTS if q != p]), 2) for p in PARTS}
    return {"fake_daily": total, **{f"fake_{p}": v for p, v in rest.items()}}


def missing_flags(cols: Sequence[str]) -> list[Column]:
    return [F.col(c).isNull().cast("float").alias(f"{c}_missing") for c in cols]


def rule_margin(daily: str = "daily", social: str = "social") -> Column:
    """A known rule as a probability: 1, 0, or 0.5 where it doesn't decide."""
    d, s = F.col(daily), F.col(social)
    return F.when((d > 8) | (s > 4), 1.0).when((d <= 6) & (s <= 4), 0.0).otherwise(0.5)


def compositions() -> dict[str, Column]:
    """Unguarded compositions of imputed columns; a division by zero is NULL."""
    d, s, g, w, wk, sl, n, o = (F.col(c) for c in ("daily", "social", "gaming", "work", "weekend", "sleep", "notifications", "opens"))
    leisure, div = s + g, F.try_divide
    return {
        "imp_resid": d - (s + g + w),
        "imp_leisure": leisure,
        "imp_social_frac": div(s, d),
        "imp_work_frac": div(w, d),
        "imp_leisure_frac": div(leisure, d),
        "imp_resid_frac": div(d - (s + g + w), d),
        "imp_wk_ratio": div(wk, d),
        "imp_week_total": 5 * d + 2 * wk,
        "imp_awake_screen_frac": div(d, 24 - sl),
        "imp_free_time": 24 - sl - d,
        "imp_notif_per_open": div(n, o),
        "imp_min_per_open": div(60 * d, o),
        "imp_over_9h": (sl > 9).cast("int"),
        "imp_under_3h": (d < 3).cast("int"),
        "imp_screen_over_sleep": div(d, sl),
        "imp_screen_minus_sleep": d - sl,
        "imp_gaming_over_daily": div(g, d),
        "imp_weekend_minus_daily": wk - d,
        "imp_screen_mean_dw": (d + wk) / 2,
    }
