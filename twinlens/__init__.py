"""twinlens package."""
