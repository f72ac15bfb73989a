"""reqscope.streaming."""
