"""All registered queries of the engine and the SQL each is checked against."""

from orefall.plans import details, evaluation, library, modes, retrieval, sql_surface, tables  # noqa: F401  they register their queries
from orefall.plans.registry import ORACLES, QUERIES

FLAGSHIP = "j5_bm25_visible"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
