"""Connected components, with lineage cut by this subpackage's written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandloom.llm.common import written
from strandloom.operators import components as shared


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): component is the least id that can be reached."""
    return shared.components(edges, written)
