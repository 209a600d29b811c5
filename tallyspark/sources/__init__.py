"""Readers of statement files into raw statements and rows."""
