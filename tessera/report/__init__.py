"""The report of a finished scan."""
