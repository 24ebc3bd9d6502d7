"""Operators composed into retrieval, answering and evaluation jobs."""
