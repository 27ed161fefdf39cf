"""Sources and sinks: loading files into canonical tables, and writing findings."""
