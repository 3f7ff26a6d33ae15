"""Structured Streaming forms of corpus statistics: an extension, for corpora that keep growing."""
