"""Named queries over the standard tables, each with a SQL statement of the same result."""

from tidemark.catalog import basics, inference, mining, quality  # noqa: F401
from tidemark.catalog.registry import ORACLES, QUERIES  # noqa: F401
