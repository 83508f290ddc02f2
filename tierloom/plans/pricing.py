"""Prices from a file, and numbers as a report writes them."""

from __future__ import annotations

import tomllib
from pathlib import Path

from tierloom.errors import AuditError
from tierloom.plans.tiers import GB_MONTH

NAME = "pricing.toml"


def load_pricing(path: str | None = None) -> dict[str, float]:
    """USD a GB and month of traces and vectors: of a TOML file, or the one in a folder, or the defaults if there is none to look for."""
    if path is None:
        return dict(GB_MONTH)
    at = Path(path)
    at = at / NAME if at.is_dir() else at
    try:
        found = tomllib.loads(at.read_text())
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise AuditError(f"{at}: {e}") from e
    prices = found.get("gb_month", found)
    out = dict(GB_MONTH)
    for kind, usd in prices.items():
        if kind not in out or isinstance(usd, bool) or not isinstance(usd, int | float) or not 0 <= usd < float("inf"):
            raise AuditError(f"{at}: {kind} = {usd!r} isn't a price of {' or '.join(out)}")
        out[kind] = float(usd)
    return out


def usd(x: float) -> str:
    return f"{'-' if x < 0 else ''}${abs(x):,.2f}"


def size(n: float) -> str:
    """Decimal units, one digit after the point."""
    for least, unit in ((1e12, "TB"), (1e9, "GB"), (1e6, "MB"), (1e3, "KB")):
        if n >= least:
            return f"{n / least:.1f} {unit}"
    return f"{int(n)} B"


def ratio(raw: float, stored: float) -> str:
    return f"{raw / stored:.2f}x" if raw and stored else "n/a"


def recall(x: float | None) -> str:
    return "not measured" if x is None else f"{x:.4f}"


def percent(part: float, whole: float) -> str:
    return f"{100 * part / whole:.2f}%" if whole else "n/a"
