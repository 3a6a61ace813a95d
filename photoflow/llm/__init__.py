"""Training-data operators: token counts, search, mixing, quality, sharding,
toxicity, SentencePiece coding, near and exact duplicates, personal data.

Nothing else in the library imports this subpackage.
"""
