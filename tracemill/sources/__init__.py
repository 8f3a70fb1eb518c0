"""Sources and sinks: write-ahead logs, JSON requests, and traces from tables."""
