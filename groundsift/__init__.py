"""Site screening on PySpark: dated observations, free-space overlay, evidence joins, versioned results."""
