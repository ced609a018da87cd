"""Operators for text and for consolidating matches. Nothing outside this folder imports it."""
