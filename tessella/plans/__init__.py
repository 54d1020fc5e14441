"""Plans: guards, lineage and the registry of queries."""

from . import answers, composites, registry, reports  # noqa: F401  (they register)
