"""Sources and sinks: what may enter an analysis, and what leaves it."""
