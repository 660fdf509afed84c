from . import ingest, reports, results_store, roster, tables  # noqa: F401
