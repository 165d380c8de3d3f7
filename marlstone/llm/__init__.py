"""Operators for training-data pipelines; nothing else in marlstone imports this subpackage."""
