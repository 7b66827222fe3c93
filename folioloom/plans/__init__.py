"""Prompt plans, model calls and the staged pipeline."""
