"""reqscope.operators."""
