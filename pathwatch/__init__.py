"""PySpark jobs that find network anomalies in very large traceroute collections."""
