"""plans of the linkage engine."""
