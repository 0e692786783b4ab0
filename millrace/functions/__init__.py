"""Scalar function families with dialect variants."""
