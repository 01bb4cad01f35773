"""Operations of a training-data pipeline: scoring, sharding, deduplication, cleaning and packing of documents."""
