"""Plans: batch search and autocomplete, index build/read, registered queries and oracles."""
