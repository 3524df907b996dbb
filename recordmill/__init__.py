"""Public penalty notices on Spark: pages in, one clean dated ledger out."""

from recordmill.session import build_session, prepare, stage

__all__ = ["build_session", "prepare", "stage"]
