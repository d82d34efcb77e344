"""Table sources, fixture views, vector sources and sinks."""
