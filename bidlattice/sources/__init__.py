"""Sources and sinks of graphs."""
