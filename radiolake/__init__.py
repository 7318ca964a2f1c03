"""Mobile radio-network analytics as Spark DataFrame transformations."""

from radiolake.session import build_session

__all__ = ["build_session"]
