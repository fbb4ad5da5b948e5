"""Explainable and testable analytics on Spark DataFrames."""

from whence.operators.frame import LineageFrame, tag
from whence.session import durable, scratch_dir, tune

__all__ = ["LineageFrame", "tag", "durable", "scratch_dir", "tune"]
