"""Business analytics on Spark: long-format facts in, KPI, series, scoring and scenario tables out."""
