"""Sources and sinks: CSV contract reader, whole-text files, file fingerprints, writers."""
