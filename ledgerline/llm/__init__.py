"""Operations of a large training-data pipeline. Nothing else in this library imports this subpackage."""
