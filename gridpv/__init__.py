"""gridpv: solar generation at grid supply points, as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` (lazy, no actions),
keyed by a list of partitioning columns, normally ``["gsp_id"]``.
"""

from gridpv.session import get_session

__all__ = ["get_session"]
