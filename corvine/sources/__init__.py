"""Readers and writers: file trees, passage tables, vector files, manifests."""
