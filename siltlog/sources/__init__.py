"""Reading, parsing and storing log lines."""
