"""Training-data pipeline operators (quality, WARC, toxicity, language, sharding,
near-duplicates, language model, personal data, tokenisation, decontamination)."""
