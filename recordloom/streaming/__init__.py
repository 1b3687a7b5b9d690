"""Change detection and folds over event streams."""
