"""Files, providers and sinks."""
