"""Corpus preparation for language models: ten operators over a table of documents."""
