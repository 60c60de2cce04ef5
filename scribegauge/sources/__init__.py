"""Readers for sample sets and terminologies, and writers for reports."""
