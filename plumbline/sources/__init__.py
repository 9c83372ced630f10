"""Sources, sinks and their validation."""
