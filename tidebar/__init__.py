"""tidebar: market-panel analytics expressed as Spark DataFrame jobs.

Every operator takes and returns DataFrames in *long* form, keyed by a series
key (``symbol``, or ``symbol`` plus variant columns) and an event time.
"""

__version__ = "0.1.0"
