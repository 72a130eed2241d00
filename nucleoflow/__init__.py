"""Single-nucleus multi-omics analytics expressed as Spark DataFrame jobs."""

from nucleoflow.session import build_session, materialize

__all__ = ["build_session", "materialize"]
