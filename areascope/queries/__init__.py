"""Every registered query, grouped by area; importing this package fills ``QUERIES`` / ``ORACLE``.

models     staging views, intermediate models, marts
ingestion  wide panels, API pages, lookups, key cleaning, profiles, city/zip mapping
landing    releases, rewritten months, broken and missing pages, raw profiles
panel      reference dates, lookbacks, percent_rank, rank within groups
reports    dashboard and documented queries over the marts
scale      distinct counts that add up, exact medians, all levels at once, hot cities
quality    the declared data-quality checks
"""

# registration happens on import, in this order
from areascope.queries import models  # noqa: F401  isort: skip
from areascope.queries import ingestion  # noqa: F401  isort: skip
from areascope.queries import landing  # noqa: F401  isort: skip
from areascope.queries import panel  # noqa: F401  isort: skip
from areascope.queries import reports  # noqa: F401  isort: skip
from areascope.queries import quality  # noqa: F401  isort: skip
from areascope.queries import scale  # noqa: F401  isort: skip
from areascope.queries.base import _LAYERS, ORACLE, QUERIES, Layers, layers, register

__all__ = ["ORACLE", "QUERIES", "Layers", "layers", "register", "_LAYERS"]
