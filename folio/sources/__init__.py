"""Sources: ingest of JSON inputs and adaptors over the driver tables."""
