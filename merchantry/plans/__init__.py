"""The reports, composed from operators."""
