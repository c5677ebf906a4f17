"""Readers and writers: tables, notice feeds, JSON envelopes, web pages, archives, CSV and shards."""
