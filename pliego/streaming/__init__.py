"""Streams: landed files merged run by run, duplicates and windows with watermarks."""
