"""Composed plans: marts, batch ETL, publishing, shared-fact and incremental refresh."""
