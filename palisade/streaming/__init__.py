"""Extension: windowed aggregation of event streams. The reference inventory has no streaming operators."""
