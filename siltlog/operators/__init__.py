"""DataFrame operators over the ordered log table and the pattern table."""
