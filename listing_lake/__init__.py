"""PySpark jobs for marketplace listing data: intake, layers, valuation, scan, training sets and operations."""
