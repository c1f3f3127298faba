"""Reports and multi-step analyses composed from operators."""
