"""All registered queries and their SQL."""

from . import delivery, drivers, extracts, linking, reconcile, relational, texts  # noqa: F401  they register their queries
from ..streaming import queries as streams  # noqa: F401  after the batch twins
from .registry import QUERIES, SQL  # noqa: F401
