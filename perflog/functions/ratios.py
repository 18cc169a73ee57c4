"""Efficiency ratios and ratings.

Zero-denominator policies differ between the reference's code paths (T16);
each is kept and selected with ``on_zero``:

* ``"null"``      -- result is null (player service path)
* ``"zero"``      -- result is 0 (training-set path)
* ``"denom_one"`` -- divide by 1 instead (team path)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num: Column, den: Column, on_zero: str = "null") -> Column:
    if on_zero == "null":
        return F.when(den > 0, num / den)
    if on_zero == "zero":
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))
    if on_zero == "denom_one":
        return num / F.when(den > 0, den).otherwise(F.lit(1.0))
    raise ValueError(on_zero)


def true_shooting(pts, fga, fta, on_zero: str = "null") -> Column:
    """PTS / (2 (FGA + 0.44 FTA))."""
    attempts = _c(fga) + 0.44 * _c(fta)
    return safe_div(_c(pts), 2 * attempts, on_zero) if on_zero != "null" else \
        F.when(attempts > 0, _c(pts) / (2 * attempts))


def effective_fg(fgm, fg3m, fga, on_zero: str = "null") -> Column:
    """(FGM + 0.5 FG3M) / FGA."""
    return safe_div(_c(fgm) + 0.5 * _c(fg3m), _c(fga), on_zero)


def usage(fga, fta, tov, negative_to_zero: bool = False) -> Column:
    """FGA + 0.44 FTA + TOV (a volume, not a percentage).

    Service form: null if any input is null.  Training form
    (``negative_to_zero``): 0 unless every input is present and non-negative.
    """
    total = _c(fga) + 0.44 * _c(fta) + _c(tov)
    if not negative_to_zero:
        return total
    ok = (_c(fga) >= 0) & (_c(fta) >= 0) & (_c(tov) >= 0)
    return F.when(F.coalesce(ok, F.lit(False)), total).otherwise(F.lit(0.0))


def ast_to_tov(ast, tov) -> Column:
    """AST/TOV; with no turnovers, AST itself when positive, else null."""
    return F.when(_c(tov) > 0, _c(ast) / _c(tov)).when(_c(ast) > 0, _c(ast).cast("double"))


def offensive_rating(fgm, ft_pct, fta, fga, tov, oreb) -> Column:
    """100 * scoring possessions / possessions, null when possessions <= 0."""
    scoring = _c(fgm) + (1 - F.pow(1 - _c(ft_pct), 2)) * _c(fta) * 0.5
    poss = _c(fga) + 0.44 * _c(fta) + _c(tov) - _c(oreb)
    return F.when(poss > 0, 100 * scoring / poss)


def shooting_pct(made, attempted) -> Column:
    """C11: per-row FG% / FG3% / FT%, 0 when there were no attempts."""
    return F.when(_c(attempted) > 0, _c(made) / _c(attempted)).otherwise(F.lit(0.0))


def team_ratios(fgm="FGM", fg3m="FG3M", fga="FGA", fta="FTA", tov="TOV", oreb="OREB",
                dreb="DREB") -> dict[str, Column]:
    """C7 (team form) and C12, all with the divide-by-one policy."""
    poss_like = _c(fga) + 0.44 * _c(fta) + _c(tov)
    return {
        "EFG_PCT": safe_div(_c(fgm) + 0.5 * _c(fg3m), _c(fga), "denom_one"),
        "TOV_PCT": safe_div(_c(tov), poss_like, "denom_one"),
        "OREB_PCT": safe_div(_c(oreb), _c(oreb) + _c(dreb), "denom_one"),
        "FTR": safe_div(_c(fta), _c(fga), "denom_one"),
    }


def possessions(fga="FGA", fta="FTA", oreb="OREB", tov="TOV") -> Column:
    """FGA + 0.44 FTA - OREB + TOV."""
    return _c(fga) + 0.44 * _c(fta) - _c(oreb) + _c(tov)


def team_ratings(pts="PTS", plus_minus="PLUS_MINUS", poss="POSS") -> dict[str, Column]:
    """C14: offensive / defensive / net rating per 100 possessions (divide-by-one policy)."""
    off = safe_div(100 * _c(pts), _c(poss), "denom_one")
    opp = _c(pts) - _c(plus_minus)
    dfn = safe_div(100 * opp, _c(poss), "denom_one")
    return {"OFF_RTG": off, "OPP_PTS": opp, "DEF_RTG": dfn, "NET_RTG": off - dfn}


def win_flag(wl) -> Column:
    """1 for 'W', else 0 (null included)."""
    return F.coalesce((_c(wl) == "W").cast("int"), F.lit(0))


def blowout_win(plus_minus, win) -> Column:
    """Won by more than 15; an unknown margin is 0."""
    return F.coalesce(((_c(plus_minus) > 15) & (_c(win) == 1)).cast("int"), F.lit(0))


def close_game(plus_minus) -> Column:
    """Decided by fewer than 5; an unknown margin is 0."""
    return F.coalesce((F.abs(_c(plus_minus)) < 5).cast("int"), F.lit(0))
