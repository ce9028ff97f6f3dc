"""Captures and their parsers."""
