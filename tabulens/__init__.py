"""tabulens: table profiling, governed SQL and chart queries as Spark DataFrame jobs."""

from tabulens.session import build_session

__all__ = ["build_session"]
