"""textmill: labelled-text processing expressed as Spark DataFrame plans."""
