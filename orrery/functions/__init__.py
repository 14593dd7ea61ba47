"""Scalar expressions as Spark columns and as plain values."""
