"""Training-data operators: mixing, quality, privacy, sharding, deduplication, decontamination, chat, language."""
