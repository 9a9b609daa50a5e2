"""How large a position is: leverage by a policy, whole shares, states of sessions, costs of prices, names of cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIZINGS, NULL_VOL, ROUNDINGS = ("flat", "vol"), ("skip", "max"), ("floor", "round")
#: States whose result isn't part of a performance figure.
OUTSIDE = ("warmup_no_prev_close", "warmup_no_band", "unknown_exit", "after_unknown_exit", "absent_session")


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} {value!r} isn't one of {allowed}")


def leverage(vol: Column, sizing: str = "vol", flat: float = 1.0, target: float = 0.02, most: float = 4.0, null_vol: str = "skip") -> Column:
    """Flat, or target over vol and at most `most`. Without a vol: none (skip) or the most; a vol of 0 has the most."""
    _one_of("sizing", sizing, SIZINGS)
    _one_of("null_vol", null_vol, NULL_VOL)
    if most <= 0 or target <= 0 or flat <= 0:
        raise ValueError("leverage, target and cap have to be above 0")
    if sizing == "flat":
        return F.lit(flat)
    known = vol.isNotNull() & ~F.isnan(vol)
    return F.when(known, F.coalesce(F.least(F.try_divide(F.lit(target), vol), F.lit(most)), F.lit(most))).otherwise(F.lit(0.0 if null_vol == "skip" else most))


def shares(aum: Column, price: Column, lev: Column, rounding: str = "floor") -> Column:
    """Whole shares, cut or rounded with halves to even."""
    _one_of("rounding", rounding, ROUNDINGS)
    raw = F.try_divide(aum, price) * lev
    return (F.floor(raw) if rounding == "floor" else F.bround(raw, 0)).cast("long")


def state(prev_close: Column, band: Column, vol: Column, n_shares: Column, sizing: str = "vol", null_vol: str = "skip") -> Column:
    """The first that holds: no close before, no band, no vol where one is needed, no share, active."""
    lost = (vol.isNull() | F.isnan(vol)) if sizing == "vol" and null_vol == "skip" else F.lit(False)
    return F.when(prev_close.isNull(), "warmup_no_prev_close").when(band.isNull(), "warmup_no_band").when(lost, "invalid_feature_dvol").when(F.coalesce(n_shares, F.lit(0)) <= 0, "zero_size").otherwise("active")


def evaluated(status: Column) -> Column:
    return ~status.isin(*OUTSIDE)


def held_leverage(notional_minutes: Column, aum: Column, minutes: Column) -> Column:
    """Null where nothing was held."""
    return F.when((aum > 0) & (minutes > 0), notional_minutes / (aum * minutes))


def per_share(bps: Column | float, price: Column) -> Column:
    return price * (bps if isinstance(bps, Column) else F.lit(float(bps))) / 10_000


def cell_id(*parts: Column, slip: Column) -> Column:
    """Parts by two underscores, slippage with four places and p for the point."""
    return F.concat_ws("__", *parts, F.concat(F.lit("slip_"), F.replace(F.format_string("%.4f", slip), F.lit("."), F.lit("p"))))
