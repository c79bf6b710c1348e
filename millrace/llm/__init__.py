"""Operators for large-scale training-data pipelines; nothing else in millrace imports this subpackage."""
