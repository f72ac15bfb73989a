"""reqscope.functions."""
