"""Text-reuse search and corpus analytics on Spark."""
