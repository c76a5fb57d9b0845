"""innsight: hospitality analytics on Spark DataFrames.

``Hotel`` holds the 25 logical tables, ``Params`` the dates a report runs for;
reports, reconciliation and quality scans live in ``innsight.operators``, batch
appliers in ``innsight.plans`` and Structured Streaming jobs in
``innsight.streaming``.
"""

from innsight.params import Params
from innsight.tables import Delta, Hotel

__all__ = ["Delta", "Hotel", "Params"]
