"""Training-data operators on DataFrames: mixing, packing, search, near-duplicates, fingerprints, HTML, scoring, URL filters, PII, language ID."""
