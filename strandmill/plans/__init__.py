"""strandmill.plans."""
