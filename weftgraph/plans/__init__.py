"""Whole dataflows, and what they need to run on a cluster."""
