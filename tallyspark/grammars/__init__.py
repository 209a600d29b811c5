"""Issuer grammars: numbered text lines of statements to raw movements, all as DataFrame operations."""

from .issuers import parse_lines

__all__ = ["parse_lines"]
