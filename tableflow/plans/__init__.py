"""Pipelines described as plain data: steps, contract check, run."""
