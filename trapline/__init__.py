"""trapline: Spark-native analytics for login-attack logs from honeypot sensors.

Layout:
  schema      StructTypes and key lists shared by every module
  session     session helpers (checkpoint folder, local test session)
  functions/  Column-level helpers (local time, trimming, log lines)
  sources/    raw submissions, stored tables, frames derived from driver tables
  operators/  filters, exact dedup, dictionary coding
  plans/      the twenty views and reports, backfill, query catalog
  streaming/  Structured Streaming ingest with exact dedup
"""

__version__ = "0.1.0"
