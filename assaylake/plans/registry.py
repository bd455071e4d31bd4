"""All queries over the driver tables, by name."""

from assaylake.plans import association, calibrated, evidence, extended, external, genome, ids, links, lookups, modules, shape, surface  # noqa: F401
from assaylake.plans.binding import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "assoc_ranked_sets"
