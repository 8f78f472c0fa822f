"""Incremental ingest with Structured Streaming.

The reference has no streaming operator; its ingest is a batch upsert. This package only
offers that same keyed upsert as a streaming delivery mode: CSV files landing in a
folder are applied micro-batch by micro-batch to a keyed snapshot table.
"""

from tessera.streaming.upsert_stream import latest_snapshot, start_upsert_stream

__all__ = ["start_upsert_stream", "latest_snapshot"]
