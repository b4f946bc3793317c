"""The two jobs."""
