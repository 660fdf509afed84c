"""examlytics: oral-exam session analytics as Spark DataFrame jobs.

Every operator is a function ``DataFrame(s) -> DataFrame`` (or
``Column -> Column`` for scalar helpers in :mod:`examlytics.functions`).
Nothing is collected to the driver; all work is expressed with Spark SQL
expressions so Catalyst can prune, push down and code-generate it.
"""

__all__ = ["session", "schemas", "functions", "operators", "sources", "plans", "streaming"]
