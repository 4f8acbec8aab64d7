from . import queries, records, signals  # noqa: F401  (records and signals add their queries to those of queries)
