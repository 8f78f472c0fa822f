"""tessera: reference-data ingest, audit, hierarchy, catalogue and text jobs on PySpark.

Every operator is a function from DataFrames (plus a few column-role parameters) to a
DataFrame. Nothing here collects data to the driver; actions happen only in callers
(tests, bench, sinks).
"""

from tessera.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
