"""All registered queries over the reference's operators, with their SQL equivalents."""

from . import lookups  # noqa: F401  (adds its queries)
from .queries import ORACLES, QUERIES

FLAGSHIP = "visible_relations"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
