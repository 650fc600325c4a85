"""strandmill.sources."""
