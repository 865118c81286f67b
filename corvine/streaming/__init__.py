"""Change detection and continuous rebuilds."""
