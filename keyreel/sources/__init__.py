"""Sources, sinks and the building of tables."""
