"""Reports and usage analytics."""
