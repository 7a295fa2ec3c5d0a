"""Part of textloom; see the README."""
