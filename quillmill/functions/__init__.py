"""Scalar expressions and small helpers of the rules."""
