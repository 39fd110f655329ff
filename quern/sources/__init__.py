"""Readers. Document readers return ``schemas.DOCUMENTS``: a text and its place in file order."""
