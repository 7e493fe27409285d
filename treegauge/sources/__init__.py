"""Reading and writing: file trees, metric and match tables, summaries, CSV."""
