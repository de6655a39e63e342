"""Statistics of streams, in the form of the stored ones."""
