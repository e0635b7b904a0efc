"""Readers and writers for prompt shards, batches and corpora."""
