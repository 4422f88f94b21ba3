"""Table specifications, readers, extracts and sinks."""
