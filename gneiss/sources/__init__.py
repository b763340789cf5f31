"""Sources and sinks: file trees, scanner output, configuration, versioned tables, reports."""
