"""Sources and sinks: invocation logs, dimension tables, fixtures."""
