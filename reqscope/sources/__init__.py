"""reqscope.sources."""
