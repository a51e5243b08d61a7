"""Training-data operators: search, sampling, packing, language, licences, deduplication, scoring, quality."""
