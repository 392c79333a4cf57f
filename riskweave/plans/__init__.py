"""Jobs that chain operators, sources and sinks."""
