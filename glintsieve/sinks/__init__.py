"""Reports and files that a scan writes."""
