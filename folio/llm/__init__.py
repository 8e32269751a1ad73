"""Operators for training-data pipelines. Nothing else in folio imports this subpackage."""
