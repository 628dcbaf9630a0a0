"""Queries over points."""
