"""Template identification for glyph images, as Spark DataFrame jobs."""
