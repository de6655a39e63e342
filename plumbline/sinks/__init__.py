"""Where results go: files, tables, text, alerts."""
