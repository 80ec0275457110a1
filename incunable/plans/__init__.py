"""Whole-book plans, adapters and their configuration."""
