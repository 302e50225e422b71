"""Tables, scans and writes."""
