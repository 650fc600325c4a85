"""strandmill.functions."""
