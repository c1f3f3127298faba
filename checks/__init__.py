"""Registered queries, their SQL counterparts and the log lines both start from."""
