"""Operators for large training corpora. Nothing else in quartzgrid imports this subpackage."""
