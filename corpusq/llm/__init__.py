"""Operations of a large-scale training-data pipeline; nothing else in corpusq imports this."""
