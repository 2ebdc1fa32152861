"""Operators of a training-data pipeline. Nothing else in cairn imports this subpackage."""
