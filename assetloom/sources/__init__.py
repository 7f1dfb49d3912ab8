"""Sources and sinks of the catalog."""
