"""All registered queries."""

from panelwise.catalog import inout, models, quality, relational, series  # noqa: F401
from panelwise.catalog.registry import QUERIES, SQL  # noqa: F401
