"""Composed jobs: domain ingest, driver-table roles, registered queries with oracle SQL."""
