"""All queries of the library outside the training-data operators."""

from __future__ import annotations

from quirefold.plans import assembly_queries as _assembly  # noqa: F401  registers its queries
from quirefold.plans import more_queries as _more  # noqa: F401  registers its queries
from quirefold.plans import pages as _pages  # noqa: F401  registers its queries
from quirefold.plans import queries as _q

FLAGSHIP = "chain_missing"


def queries() -> dict[str, _q.Query]:
    return dict(_q.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_q.SQL)
