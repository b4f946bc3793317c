"""Writers of the job results."""

from rankforge.sinks.results import run_path, write_counts, write_recommendations

__all__ = ["run_path", "write_counts", "write_recommendations"]
