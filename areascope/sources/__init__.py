"""Sources and sinks: benchmark tables, the domain adapter, ingestion of raw panels and API files."""
