"""Evidence and findings operators, each DataFrame to DataFrame."""
