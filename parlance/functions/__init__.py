from parlance.functions.text import TOKEN, UAX_TOKEN, ngrams, words

__all__ = ["TOKEN", "UAX_TOKEN", "ngrams", "words"]
