"""Spark jobs for preparing and evaluating image-cell datasets."""
