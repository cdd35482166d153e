"""Log analytics on PySpark: health, search and clusters of log lines."""
