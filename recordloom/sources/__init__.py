"""Sources and sinks: snapshot databases, file trees, configuration, publishing."""
