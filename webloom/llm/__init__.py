"""Operations of a training-data pipeline: search, deduplication, mixing, formatting, packing."""
