from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame


class Answer(NamedTuple):
    """What an analytic question returns: result rows, one row of computed figures, and (rank, value, id) of lists."""

    result: DataFrame
    numbers: DataFrame
    ranked: DataFrame | None = None
