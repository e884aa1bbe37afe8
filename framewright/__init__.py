"""framewright: table profiling, cleaning, aggregation, statistics and models as Spark DataFrame operators."""

from framewright.session import local_session, prepare

__all__ = ["local_session", "prepare"]
