from parlance.sources.lexicons import (
    CUSTOM_WORDS,
    LEXICONS,
    bind_rows,
    custom_stop_words,
    lookup_table,
    read_lexicon,
    stop_words,
)
from parlance.sources.messages import MESSAGES, as_messages, read_messages, spread_out
from parlance.sources.store import read_stored, store_messages

__all__ = [
    "CUSTOM_WORDS",
    "LEXICONS",
    "MESSAGES",
    "as_messages",
    "bind_rows",
    "custom_stop_words",
    "lookup_table",
    "read_lexicon",
    "read_messages",
    "read_stored",
    "spread_out",
    "stop_words",
    "store_messages",
]
