"""Lexical, semantic and corpus analytics as DataFrame operators on stock Spark."""

__version__ = "0.1.0"
