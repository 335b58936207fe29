"""Operators for preparing large text and vector collections as training data.

Nothing else in the package imports this subpackage.  Every operator takes and
returns DataFrames and keeps all rows: there are no samples, caps or prefixes
outside documented training samples.
"""
