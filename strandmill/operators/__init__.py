"""strandmill.operators."""
