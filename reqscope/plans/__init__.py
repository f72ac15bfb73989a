"""reqscope.plans."""
