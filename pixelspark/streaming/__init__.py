"""The per-row operators over streams of files or rows."""
