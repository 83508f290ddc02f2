"""Tiered trace and vector analytics on Spark: open a store, audit a corpus, make one up."""

from __future__ import annotations


def open(spark, path: str, create: bool = True):  # noqa: A001 - the name is the API's
    """A store of tiers at ``path``."""
    from tierloom.plans.store import Store

    return Store(spark, path, create)


def audit(spark, path: str, store: str, report: str | None = None, **how):
    """Measures what the tiers do to the corpus at ``path``; the reports go to the folder ``report``."""
    from tierloom.plans.audit import run_audit

    return run_audit(spark, path, store, report, **how)


def synth(spark, path: str, gb: float = 0.01, **how) -> dict:
    """Makes up a corpus at ``path``."""
    from tierloom.plans.synth import generate

    return generate(spark, path, gb, **how)


__all__ = ["audit", "open", "synth"]
