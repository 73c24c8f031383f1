"""Operators over relations of documents, terms, postings and requests."""
