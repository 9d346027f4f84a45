"""Second-moment summaries of large numeric tables, and models computed from them, on Spark."""
