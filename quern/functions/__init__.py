"""Column functions: text cleaning, tokenizers, stemmers, exact probabilities."""
