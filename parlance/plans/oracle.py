"""The same analyses in SQL, for checking the results with another engine."""

from __future__ import annotations

from parlance.plans.inputs import AFINN, BING, FOCUS_GROUP, NRC
from parlance.sources.lexicons import CUSTOM_WORDS

TOPICS = 13

# The English stop words that come with Spark.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is
are was were be been being have has had having do does did doing a an the and but if or because as until
while of at by for with about against between into through during before after above below to from up
down in out on off over under again further then once here there when where why how all any both each few
more most other some such no nor not only own same so than too very s t can will just don should now i'll
you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's
there's what's when's where's who's why's would
""".split()

# Letters that are words of their own, and signs whose runs are words.
SINGLE = (
    r"\p{Han}\p{Hiragana}\x{0E01}-\x{0E30}\x{0E32}\x{0E33}\x{0E40}-\x{0E46}\x{0E81}-\x{0EB0}\x{0EB2}\x{0EB3}\x{0EBD}\x{0EC0}-\x{0EC6}\x{0EDC}-\x{0EDF}"
    r"\x{1000}-\x{102A}\x{103F}\x{1050}-\x{1055}\x{1780}-\x{17B3}\x{17D7}\x{17DC}"
)
KATAKANA = r"\p{Katakana}\x{30A0}\x{30FC}\x{FF70}\x{3031}-\x{3035}\x{309B}\x{309C}"
UNSPACED = rf"([{SINGLE}]\p{{M}}*|(?:[{KATAKANA}]\p{{M}}*)+)"

# Unicode word boundaries without lookaround: a letter with what joins it to following letters, a digit with
# what joins it to following digits, or one character of a word. Matches of underscores alone are no words.
# Words of scripts without spaces have spaces put around them before.
TOKEN = rf"(?:[\p{{L}}\p{{M}}](?:['’‘.·‧]\p{{L}})+|\p{{N}}(?:['’‘.,;]\p{{N}})+|[\p{{L}}\p{{M}}\p{{N}}_{KATAKANA}])+"


def _text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(_cell, row)) + ")" for row in rows)


def _parts(value: str) -> str:
    """The value in whole parts of 1e-9."""
    return f"CAST(floor(({value}) * 1e9 + 0.5e0) AS BIGINT)"


def _cell(value) -> str:
    return str(value) if isinstance(value, int) else _text(value)


COMMON = f"""
WITH messages AS (
  SELECT doc_id AS Message_ID_int, CAST((doc_id // 20) % 12 + 1 AS INTEGER) AS Month_Index,
         source AS Group_Name, text AS Message_Body
  FROM documents
),
stop_words(word, lexicon) AS (VALUES {_values((word, "spark") for word in STOP_WORDS)}),
custom_stop_words AS (
  SELECT * FROM (VALUES {_values((word, "custom") for word in CUSTOM_WORDS)}) AS own(word, lexicon)
  UNION ALL SELECT word, lexicon FROM stop_words
),
bing(word, sentiment) AS (VALUES {_values(BING)}),
afinn(word, value) AS (VALUES {_values(AFINN)}),
nrc(word, sentiment) AS (VALUES {_values(NRC)}),
texts AS (
  SELECT Message_ID_int, Month_Index, Group_Name,
         CASE WHEN Message_Body IS NULL THEN [CAST(NULL AS VARCHAR)]
              ELSE list_filter(regexp_extract_all(regexp_replace(lower(Message_Body), {_text(UNSPACED)}, ' \\1 ', 'g'), {_text(TOKEN)}),
                               lambda w: NOT regexp_full_match(w, '_+')) END AS ws
  FROM messages
),
tokens AS (SELECT Message_ID_int, Month_Index, Group_Name, unnest(ws) AS word FROM texts),
tokens_clean AS (
  SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM stop_words s WHERE s.word IS NOT DISTINCT FROM t.word)
),
tokens_custom AS (
  SELECT * FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM custom_stop_words s WHERE s.word IS NOT DISTINCT FROM t.word)
),
word_counts AS (SELECT word, count(*) AS n FROM tokens_clean GROUP BY word),
sentiment_counts AS (
  SELECT Group_Name, Month_Index AS "index", sentiment, count(*) AS n
  FROM tokens_clean JOIN bing USING (word) GROUP BY ALL
),
net AS (
  SELECT Group_Name, "index", CAST(sum(CASE WHEN sentiment = 'negative' THEN n ELSE 0 END) AS BIGINT) AS negative,
         CAST(sum(CASE WHEN sentiment = 'positive' THEN n ELSE 0 END) AS BIGINT) AS positive
  FROM sentiment_counts GROUP BY ALL
),
group_word_sentiment AS (
  SELECT word, sentiment, count(*) AS n FROM tokens_clean JOIN bing USING (word)
  WHERE Group_Name = {_text(FOCUS_GROUP)} GROUP BY ALL
),
group_word_counts AS (SELECT Group_Name, word, count(*) AS n FROM tokens GROUP BY ALL),
group_totals AS (SELECT Group_Name, CAST(sum(n) AS BIGINT) AS total FROM group_word_counts GROUP BY ALL),
group_words AS (SELECT Group_Name, word, count(*) AS n FROM tokens_custom GROUP BY ALL),
pairs AS (
  SELECT Group_Name, ws[i] AS word1, ws[i + 1] AS word2
  FROM (SELECT Group_Name, ws, unnest(range(1, len(ws))) AS i FROM texts)
),
pairs_filtered AS (
  SELECT * FROM pairs p
  WHERE NOT EXISTS (SELECT 1 FROM stop_words s WHERE s.word IS NOT DISTINCT FROM p.word1)
    AND NOT EXISTS (SELECT 1 FROM stop_words s WHERE s.word IS NOT DISTINCT FROM p.word2)
),
triples AS (
  SELECT ws[i] AS word1, ws[i + 1] AS word2, ws[i + 2] AS word3
  FROM (SELECT ws, unnest(range(1, len(ws) - 1)) AS i FROM texts)
),
message_word_counts AS (SELECT Group_Name, Message_ID_int, word, count(*) AS n FROM tokens_clean GROUP BY ALL),
vocabulary AS (
  SELECT word, row_number() OVER (ORDER BY word) AS term_index
  FROM (SELECT DISTINCT word FROM tokens_clean WHERE word IS NOT NULL)
)
"""

# What any fit must satisfy: every word in every topic, every message with a word in every topic, shares summing to 1.
BETA_SUMS = f"""
    SELECT CAST(topic AS INTEGER) AS topic, count(*) AS terms, CAST(1 AS DOUBLE) AS beta_sum
    FROM vocabulary CROSS JOIN range(1, {TOPICS + 1}) AS t(topic) GROUP BY topic"""
GAMMA_SUMS = f"""
    SELECT DISTINCT Message_ID_int, CAST({TOPICS} AS BIGINT) AS topics, CAST(1 AS DOUBLE) AS gamma_sum
    FROM tokens_clean WHERE word IS NOT NULL"""


def _number(value: float) -> str:
    """The value as a literal that is read as a double."""
    return f"{value!r}e0"


def _series(coefficients: list[float]) -> str:
    found = _number(coefficients[-1])
    for coefficient in reversed(coefficients[:-1]):
        found = f"({found} * z + {_number(coefficient)})"
    return found


def _psi(rows: str) -> str:
    """psi, psi1: digamma and trigamma of the column x of ``rows``, by the series at x + 6."""
    digamma = f"(ln(y) - 0.5e0 / y) + {_series([-1 / 12, 1 / 120, -1 / 252, 1 / 240, -1 / 132])} * z"
    trigamma = f"(1e0 / y + 0.5e0 * z) + {_series([1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66])} * z / y"
    for j in range(6):
        digamma += f" - 1e0 / (x + {j}e0)"
        trigamma += f" + 1e0 / ((x + {j}e0) * (x + {j}e0))"
    return f"SELECT {digamma} AS psi, {trigamma} AS psi1 FROM (SELECT *, 1e0 / (y * y) AS z FROM (SELECT *, x + 6e0 AS y FROM ({rows})))"


def _next_prior(turn: int, k: int) -> list[str]:
    """Tables up to the one of the prior ``a`` after a Newton step from that of the round before."""
    received = [f"(t{i} / 1e6)" for i in range(1, k + 1)]
    before, messages = f"prior{turn - 1}", f"messages{turn - 1}"
    each = f"SELECT unnest([{', '.join(f'{one} + a' for one in received)}]) AS x FROM {messages}, {before}"
    in_all = f"SELECT ({' + '.join(received)}) + {k} * a AS x FROM {messages}, {before}"
    sums = "SELECT CAST(sum(CAST(floor(psi * 1e6 + 0.5e0) AS BIGINT)) AS DOUBLE) / 1e6 AS psi, CAST(sum(CAST(floor(psi1 * 1e6 + 0.5e0) AS BIGINT)) AS DOUBLE) / 1e6 AS psi1"
    step = f"""SELECT a, o.psi - d * {k} * p.psi AS s, q.psi - d * r.psi AS t,
        (o.psi1 - d * {k} * p.psi1) - {k * k} * (q.psi1 - d * r.psi1) AS curve
      FROM {before}, each{turn} o, all{turn} q, ({_psi(f"SELECT a AS x FROM {before}")}) p, ({_psi(f"SELECT {k} * a AS x FROM {before}")}) r,
        (SELECT CAST(count(*) AS DOUBLE) AS d FROM {messages})"""
    newton = f"CASE WHEN g < 0 THEN -a * (s - {k} * t) / g WHEN s > 0 AND t > 0 THEN ln(s / ({k} * t)) ELSE 0e0 END"
    return [
        f"each{turn} AS MATERIALIZED ({sums} FROM ({_psi(each)}))",
        f"all{turn} AS MATERIALIZED ({sums} FROM ({_psi(in_all)}))",
        f"""prior{turn} AS MATERIALIZED (SELECT a * exp(greatest(-2e0, least(2e0, {newton}))) AS a
          FROM (SELECT *, a * (s - {k} * t) + a * a * curve AS g FROM ({step})))""",
    ]


def topic_fit(k: int = TOPICS, seed: int = 1234, rounds: int = 20, eta: float = 1.1, estimate: bool = False, settled: int = 10) -> str:
    """The fit, round by round: tables beta (topic, term, beta) and gamma (Message_ID_int, Group_Name, topic, gamma).

    With ``estimate`` the messages' prior takes a step before each round after the first ``settled``, and table priors (round, a) lists it.
    """
    topics = range(1, k + 1)
    for_message, for_word = _number(50 / k + 1 - 1), _number(eta - 1)
    first = for_message

    def shares(likely: list[str]) -> str:
        whole = " + ".join(f"l{i}" for i in topics)
        named = ", ".join(f"{likely[i - 1]} AS l{i}" for i in topics)
        dealt = ", ".join(f"CAST(floor(n * 1e6 * l{i} / ({whole})) AS BIGINT) AS t{i}" for i in topics)
        return f"SELECT m, w, {dealt} FROM (SELECT m, w, n, {named} FROM "

    sums = ", ".join(f"CAST(sum(t{i}) AS BIGINT) AS t{i}" for i in topics)
    draws = [
        f"CAST(CAST('0x' || md5('{seed}/' || m || '/' || w || '/{i}')[1:12] AS BIGINT) % 1000003 + 1 AS DOUBLE)" for i in topics
    ]
    whole = [f"(a.t{i} / 1e6 + size * {for_word})" for i in topics]
    tables = [
        "cells AS MATERIALIZED (SELECT Message_ID_int AS m, word AS w, n FROM message_word_counts WHERE word IS NOT NULL)",
        "terms AS MATERIALIZED (SELECT count(DISTINCT w) AS size FROM cells)",
        f"shares0 AS MATERIALIZED ({shares(draws)} cells))",
    ]
    if estimate:
        tables.append(f"prior0 AS MATERIALIZED (SELECT {first} AS a)")
    for turn in range(rounds + 1):
        tables += [
            f"words{turn} AS MATERIALIZED (SELECT w, {sums} FROM shares{turn} GROUP BY w)",
            f"messages{turn} AS MATERIALIZED (SELECT m, {sums} FROM shares{turn} GROUP BY m)",
            f"totals{turn} AS MATERIALIZED (SELECT {sums} FROM words{turn})",
        ]
        if turn < rounds and estimate:
            tables += _next_prior(turn + 1, k) if turn >= settled else [f"prior{turn + 1} AS MATERIALIZED (FROM prior{turn})"]
            for_message = f"prior{turn + 1}.a"
        if turn < rounds:
            likely = [
                f"(x.t{i} / 1e6 + {for_word}) * (y.t{i} / 1e6 + {for_message}) / {whole[i - 1]}" for i in topics
            ]
            prior = f", prior{turn + 1}" if estimate else ""
            source = f"cells JOIN words{turn} x USING (w) JOIN messages{turn} y USING (m), totals{turn} a, terms{prior}"
            tables.append(f"shares{turn + 1} AS MATERIALIZED ({shares(likely)} {source}))")
    in_topic = ", ".join(f"(x.t{i} / 1e6 + {for_word}) / {whole[i - 1]}" for i in topics)
    received = " + ".join(f"(t{i} / 1e6 + {for_message})" for i in topics)
    of_message = ", ".join(f"(t{i} / 1e6 + {for_message}) / ({received})" for i in topics)
    numbers = f"unnest(range(1, {k + 1}))"
    tables += [
        f"""beta AS MATERIALIZED (
          SELECT CAST({numbers} AS INTEGER) AS topic, w AS term, unnest([{in_topic}]) AS beta
          FROM words{rounds} x, totals{rounds} a, terms)""",
        f"""gamma AS MATERIALIZED (
          SELECT m AS Message_ID_int, Group_Name, CAST({numbers} AS INTEGER) AS topic, unnest([{of_message}]) AS gamma
          FROM messages{rounds} JOIN messages ON m = Message_ID_int{f", prior{rounds}" if estimate else ""})""",
        """assigned AS (
          SELECT Message_ID_int, Group_Name, topic, gamma FROM gamma
          QUALIFY row_number() OVER (PARTITION BY Message_ID_int ORDER BY gamma DESC, topic) = 1)""",
        "checked AS (SELECT topic, Group_Name, count(*) AS n FROM assigned GROUP BY ALL)",
    ]
    if estimate:
        each = " UNION ALL ".join(f"SELECT CAST({turn} AS INTEGER) AS round, a FROM prior{turn}" for turn in range(1, rounds + 1))
        tables.append(f"priors AS ({each})")
    return ", " + ",\n".join(tables)


TOPIC_SELECTS = {
    "topic_beta": "SELECT topic, term, round(beta, 9) AS beta FROM beta",
    "topic_gamma": "SELECT Message_ID_int, topic, round(gamma, 9) AS gamma FROM gamma",
    "topic_top_terms": """
        SELECT topic, CAST(topic AS VARCHAR) AS label, term, round(beta, 9) AS beta, "rank",
               row_number() OVER (PARTITION BY topic ORDER BY raw, term) AS ord
        FROM (SELECT *, beta AS raw, rank() OVER (PARTITION BY topic ORDER BY beta DESC) AS "rank" FROM beta) WHERE "rank" <= 5""",
    "topic_assignment": "SELECT Message_ID_int, topic, round(gamma, 9) AS gamma FROM assigned",
    "topic_group_check": "SELECT * FROM checked",
    "topic_agreement": """
        SELECT * FROM (WITH cells AS (SELECT topic, Group_Name, CAST(n AS DOUBLE) AS n FROM checked),
        by_topic AS (SELECT topic, sum(n) AS n, max(n) AS top FROM cells GROUP BY ALL),
        by_group AS (SELECT Group_Name, sum(n) AS n FROM cells GROUP BY ALL),
        sums AS (
          SELECT (SELECT sum(n) FROM cells) AS total, (SELECT sum(top) FROM by_topic) AS top,
                 (SELECT sum(n * (n - 1) / 2) FROM cells) AS s, (SELECT sum(n * (n - 1) / 2) FROM by_topic) AS t,
                 (SELECT sum(n * (n - 1) / 2) FROM by_group) AS g,
                 (SELECT sum(n * ln(n)) FROM cells) AS h, (SELECT sum(n * ln(n)) FROM by_topic) AS ht, (SELECT sum(n * ln(n)) FROM by_group) AS hg),
        named AS (
          SELECT *, t * g / (total * (total - 1) / 2) AS expected, ln(total) - ht / total AS et, ln(total) - hg / total AS eg,
                 ln(total) - h / total AS e FROM sums)
        SELECT CAST(total AS BIGINT) AS n, round(top / total, 9) AS purity, round((s - expected) / ((t + g) / 2 - expected), 9) AS adjusted_rand,
               round(et + eg - e, 9) AS mutual_information, round((et + eg - e) / ((et + eg) / 2), 9) AS normalised_information
        FROM named)""",
    "topic_purity": """
        SELECT topic, Group_Name, n, n / "all" AS share
        FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY topic) AS DOUBLE) AS "all" FROM checked)
        QUALIFY row_number() OVER (PARTITION BY topic ORDER BY n DESC, Group_Name NULLS FIRST) = 1""",
}

# Selects over the fit whose prior is estimated.
ESTIMATED_SELECTS = {
    "topic_alpha": "SELECT round, round(a, 6) AS alpha FROM priors",
}

SELECTS = {
    "messages_from_parquet": "SELECT * FROM messages",
    "messages_from_csv": "SELECT * FROM messages",
    "tokens": "SELECT * FROM tokens",
    "tokens_clean": "SELECT * FROM tokens_clean",
    "word_counts": "SELECT * FROM word_counts ORDER BY n DESC, word",
    "frequent_words": "SELECT word, n, row_number() OVER (ORDER BY n, word) AS ord FROM word_counts WHERE n > 1500",
    "word_cloud": "SELECT * FROM word_counts WHERE n >= 3 ORDER BY n DESC, word LIMIT 500",
    "word_cloud_by_thresholds": "SELECT * FROM word_counts WHERE n >= 3 ORDER BY n DESC, word LIMIT 500",
    "sentiment_counts": "SELECT * FROM sentiment_counts",
    "sentiment_by_group_month": "SELECT *, positive - negative AS sentiment FROM net",
    "sentiment_spread": "SELECT *, positive - negative AS sentiment FROM net",
    "group_sentiment": f"""
        SELECT *, positive - negative AS sentiment FROM net WHERE Group_Name = {_text(FOCUS_GROUP)}""",
    "stored_group_sentiment": f"""
        SELECT *, positive - negative AS sentiment FROM net WHERE Group_Name = {_text(FOCUS_GROUP)}""",
    "group_word_sentiment": "SELECT * FROM group_word_sentiment ORDER BY n DESC, word, sentiment",
    "sentiment_top_terms": """
        SELECT word, sentiment, n, "rank", dense_rank() OVER (ORDER BY mean, word) AS ord
        FROM (SELECT *, avg(n) OVER (PARTITION BY word) AS mean
              FROM (SELECT *, rank() OVER (PARTITION BY sentiment ORDER BY n DESC) AS "rank" FROM group_word_sentiment)
              WHERE "rank" <= 15)""",
    "message_sentiment": """
        SELECT Message_ID_int, CAST(count(*) FILTER (sentiment = 'negative') AS BIGINT) AS negative,
               CAST(count(*) FILTER (sentiment = 'positive') AS BIGINT) AS positive,
               CAST(sum(CASE sentiment WHEN 'positive' THEN 1 ELSE -1 END) AS BIGINT) AS sentiment
        FROM tokens_clean JOIN bing USING (word) GROUP BY ALL""",
    "score_by_group_month": """
        SELECT Group_Name, Month_Index AS "index", CAST(sum(value) AS BIGINT) AS score, count(*) AS n
        FROM tokens_clean JOIN afinn USING (word) GROUP BY ALL""",
    "emotions_by_group_month": """
        SELECT Group_Name, Month_Index AS "index", sentiment, count(*) AS n
        FROM tokens_clean JOIN nrc USING (word) GROUP BY ALL""",
    "emotions_spread": """
        SELECT Group_Name, Month_Index AS "index", count(*) FILTER (sentiment = 'anger') AS anger, count(*) FILTER (sentiment = 'fear') AS fear,
               count(*) FILTER (sentiment = 'joy') AS joy, count(*) FILTER (sentiment = 'trust') AS trust
        FROM tokens_clean JOIN nrc USING (word) GROUP BY Group_Name, Month_Index""",
    "proposed_stop_words": f"""
        SELECT * FROM (WITH uses AS (SELECT Group_Name, Message_ID_int, word, count(*) AS n FROM tokens WHERE word IS NOT NULL GROUP BY ALL),
        counts AS (
          SELECT Group_Name, word, CAST(sum(n) AS DOUBLE) AS n, count(*) AS messages, sum({_parts('n * ln(n)')}) AS terms FROM uses GROUP BY ALL),
        totals AS (SELECT Group_Name, sum(n) AS whole FROM counts GROUP BY ALL),
        by_word AS (
          SELECT word, sum(n) AS n, CAST(sum(messages) AS BIGINT) AS messages, count(*) AS groups, sum(terms) / 1e9 AS terms,
                 CAST(sum(CAST(rate AS DECIMAL(38, 18))) AS DOUBLE) AS rates,
                 CAST(sum(CAST(rate * ln(rate) AS DECIMAL(38, 18))) AS DOUBLE) AS rate_terms
          FROM (SELECT c.*, n / whole AS rate FROM counts c JOIN totals t ON c.Group_Name IS NOT DISTINCT FROM t.Group_Name) GROUP BY word),
        spread AS (
          SELECT word, CAST(n AS BIGINT) AS n, messages, groups,
                 (ln(rates) - rate_terms / rates) / ln((SELECT count(*) FROM totals)) AS g,
                 (ln(n) - terms / n) / ln((SELECT count(*) FROM messages)) AS m FROM by_word),
        rounded AS (
          SELECT word, n, messages, groups, round(g, 6) AS group_evenness, round(m, 6) AS message_evenness, round(g * m, 6) AS score FROM spread)
        SELECT CAST(row_number() OVER (ORDER BY score DESC, n DESC, word) AS INTEGER) AS "rank", *
        FROM rounded QUALIFY "rank" <= 100)""",
    "word_emotions": "SELECT word, sentiment, count(*) AS n FROM tokens_clean JOIN nrc USING (word) GROUP BY ALL",
    "lexicons": """
        SELECT lexicon, word, label, value, coalesce(n, 0) AS n
        FROM (
          SELECT 'afinn' AS lexicon, word, NULL AS label, value FROM afinn
          UNION ALL SELECT 'bing', word, sentiment, NULL FROM bing
          UNION ALL SELECT 'nrc', word, sentiment, NULL FROM nrc)
        LEFT JOIN (SELECT word, count(*) AS n FROM tokens GROUP BY word) USING (word)""",
    "custom_stop_words": """
        SELECT c.word, lexicon, coalesce(n, 0) AS n FROM custom_stop_words c
        LEFT JOIN (SELECT word, count(*) AS n FROM tokens GROUP BY word) t ON t.word IS NOT DISTINCT FROM c.word""",
    "group_word_counts": "SELECT * FROM group_word_counts ORDER BY n DESC, Group_Name, word",
    "group_totals": "SELECT * FROM group_totals",
    "group_words": "SELECT Group_Name, word, n, total FROM group_words JOIN group_totals USING (Group_Name)",
    "tfidf": """
        SELECT Group_Name, word, n, round(n / all_words, 9) AS tf, round(ln(groups / df), 9) AS idf,
               round(n / all_words * ln(groups / df), 9) AS tf_idf
        FROM group_words
        JOIN (SELECT Group_Name, CAST(sum(n) AS DOUBLE) AS all_words FROM group_words GROUP BY ALL) USING (Group_Name)
        JOIN (SELECT word, CAST(count(*) AS DOUBLE) AS df FROM group_words GROUP BY ALL) USING (word)
        CROSS JOIN (SELECT CAST(count(DISTINCT Group_Name) AS DOUBLE) AS groups FROM group_words)
        ORDER BY tf_idf DESC""",
    "bigrams": "SELECT Group_Name, word1 || ' ' || word2 AS bigram FROM pairs",
    "bigrams_separated": "SELECT * FROM pairs",
    "bigrams_filtered": "SELECT * FROM pairs_filtered",
    "bigram_counts": "SELECT word1, word2, count(*) AS n FROM pairs_filtered GROUP BY ALL ORDER BY n DESC, word1, word2",
    "bigrams_united": "SELECT Group_Name, word1 || ' ' || word2 AS bigram FROM pairs_filtered",
    "trigram_counts": """
        SELECT word1, word2, word3, count(*) AS n FROM triples t
        WHERE NOT EXISTS (SELECT 1 FROM custom_stop_words s WHERE s.word IS NOT DISTINCT FROM t.word1)
          AND NOT EXISTS (SELECT 1 FROM custom_stop_words s WHERE s.word IS NOT DISTINCT FROM t.word2)
          AND NOT EXISTS (SELECT 1 FROM custom_stop_words s WHERE s.word IS NOT DISTINCT FROM t.word3)
        GROUP BY ALL ORDER BY n DESC, word1, word2, word3""",
    "message_word_counts": "SELECT * FROM message_word_counts",
    "dtm": """
        SELECT Message_ID_int, term_index, n FROM message_word_counts JOIN vocabulary USING (word)""",
    "topic_beta_sums": BETA_SUMS,
    "topic_gamma_sums": GAMMA_SUMS,
    "topic_beta_sums_by_joins": BETA_SUMS,
    "topic_gamma_sums_by_joins": GAMMA_SUMS,
    "topic_group_messages": """
        SELECT Group_Name, count(DISTINCT Message_ID_int) AS n FROM tokens_clean WHERE word IS NOT NULL GROUP BY ALL""",
}


SELECTS |= {f"{name}_packed": SELECTS[name] for name in ("bigram_counts", "trigram_counts")}


def oracle_queries() -> dict[str, str]:
    fit = topic_fit()
    plain = {name: COMMON + select for name, select in SELECTS.items()}
    topics = {name: COMMON + fit + select for name, select in TOPIC_SELECTS.items()}
    estimated = {name: COMMON + topic_fit(estimate=True) + select for name, select in ESTIMATED_SELECTS.items()}
    return plain | topics | estimated
