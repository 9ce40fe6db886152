"""Column expressions: titles, text analysis, stemming, excerpts."""
