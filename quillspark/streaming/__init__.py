"""The online request path on Structured Streaming."""
