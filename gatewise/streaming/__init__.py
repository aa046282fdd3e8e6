"""Gates on streams of objects."""
