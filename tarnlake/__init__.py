"""Medallion lakehouse analytics as plain PySpark DataFrame functions."""

from tarnlake.session import build_session, prepare

__all__ = ["build_session", "prepare"]
