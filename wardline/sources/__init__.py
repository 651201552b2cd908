"""Readers, staged tables and run logs."""
