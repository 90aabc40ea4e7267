"""Mail-shaped views over the generic test tables, for the registry, tests and bench."""

from datasets.views import AS_OF, HISTORY_AS_OF, HOUR_AS_OF, view

__all__ = ["AS_OF", "HISTORY_AS_OF", "HOUR_AS_OF", "view"]
