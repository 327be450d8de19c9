"""Readers and writers: text folders, sidecars, JSON lines, token streams, cursors, shards, manifests."""
