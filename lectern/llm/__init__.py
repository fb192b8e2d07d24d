"""Training-data operators: near copies, leaks, personal data, language, quality, tokens."""
