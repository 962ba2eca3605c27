"""Structured Streaming: incremental, exactly-once ingestion of landed API pages.

The reference has no stream processing (its models are full-refresh batch); the only
stream-shaped part is paged API ingestion, which is what lives here.
"""

from areascope.streaming.ingest import amenity_page_stream, append_to_table, school_page_stream

__all__ = ["amenity_page_stream", "append_to_table", "school_page_stream"]
