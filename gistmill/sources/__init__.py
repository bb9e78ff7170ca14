"""Sources and sinks: file trees, tables, rule files, digest texts, stored state."""
