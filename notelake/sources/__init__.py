"""Note and key-value sources and sinks."""
