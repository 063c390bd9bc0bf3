"""Marketplace analytics on Spark: star schema, business queries, BI measures, review labels."""
