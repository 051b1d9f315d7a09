from parlance.operators.agreement import agreement
from parlance.operators.counts import count, frequent_words, in_group, labels_of, spread, spread_found, word_cloud
from parlance.operators.joins import anti_lookup, attach, attach_split, fits_broadcast, inner_lookup
from parlance.operators.packed_ngrams import packed_ngram_counts
from parlance.operators.priors import dirichlet_prior
from parlance.operators.ranks import top_n, with_position
from parlance.operators.sentiment import (
    labelled,
    lexicon_use,
    message_sentiment,
    net_sentiment,
    score_sums,
    sentiment_counts,
    sentiment_top_terms,
    spread_sentiment,
    word_sentiment,
)
from parlance.operators.stop_scores import proposed_stop_words, word_spread
from parlance.operators.tfidf import bind_tf_idf, group_totals, group_words
from parlance.operators.tokens import (
    ngram_columns,
    ngrams,
    ngrams_without,
    separate,
    tokens,
    unite,
    without_stop_words,
    word_uses,
)
from parlance.operators.top_words import most_frequent
from parlance.operators.topics import (
    TopicModel,
    beta,
    document_term_matrix,
    fit_topics,
    gamma,
    message_word_counts,
    release_topics,
    topic_assignment,
    topic_group_check,
    topic_purity,
    topic_top_terms,
    vocabulary,
)

__all__ = [
    "TopicModel",
    "agreement",
    "anti_lookup",
    "attach",
    "attach_split",
    "beta",
    "bind_tf_idf",
    "count",
    "dirichlet_prior",
    "document_term_matrix",
    "fit_topics",
    "fits_broadcast",
    "frequent_words",
    "gamma",
    "group_totals",
    "group_words",
    "in_group",
    "inner_lookup",
    "labelled",
    "labels_of",
    "lexicon_use",
    "message_sentiment",
    "message_word_counts",
    "most_frequent",
    "net_sentiment",
    "ngram_columns",
    "ngrams",
    "ngrams_without",
    "packed_ngram_counts",
    "proposed_stop_words",
    "release_topics",
    "score_sums",
    "sentiment_counts",
    "sentiment_top_terms",
    "separate",
    "spread",
    "spread_found",
    "spread_sentiment",
    "tokens",
    "top_n",
    "topic_assignment",
    "topic_group_check",
    "topic_purity",
    "topic_top_terms",
    "unite",
    "vocabulary",
    "with_position",
    "without_stop_words",
    "word_cloud",
    "word_sentiment",
    "word_spread",
    "word_uses",
]
