"""Scalar helpers and column expressions shared by the rest of the package."""
