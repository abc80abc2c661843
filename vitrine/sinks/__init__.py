"""Writers of reports and extracts."""
