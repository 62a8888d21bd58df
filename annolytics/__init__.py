"""Annotated-dataset quality and detection analytics on Spark DataFrames."""

from annolytics.taxonomy import Taxonomy

__all__ = ["Taxonomy"]
