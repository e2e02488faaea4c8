"""Column expressions: sphere geometry, pixelisation, codecs, WCS algebra."""
