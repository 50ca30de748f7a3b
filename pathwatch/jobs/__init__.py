"""Jobs to be given to spark-submit."""
