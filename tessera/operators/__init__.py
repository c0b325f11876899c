"""Relational operators as DataFrame transforms."""
