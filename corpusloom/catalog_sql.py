"""DuckDB SQL of the corpus-lexicon queries, written on the joins that the Spark plans avoid."""

from __future__ import annotations

#: Parameters of the registered queries, chosen for the invented prose of the generated tables.
KEYWORDS = ("the", "and", "que", "les", "und", "der", "los")
SOME = ("the", "les")
#: Words of an earlier request, and words with wildcards.
FIRST = ("the", "und")
PATTERNS = ("und", "d_s", "e%x", "sch")
TARGET = "the"
WORD = "of"
PAIR = (10, 11)
VOWELS = "aeiou"
EMOTIONS = {"the": 1, "and": -1, "que": 2}
MARKERS = ("like", "comme", "wie", "como")

_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def _strip(x: str) -> str:
    return f"translate({x}, '{_PUNCT}', '')"


def _pos(x: str) -> str:
    return (
        f"CASE WHEN NOT regexp_matches({x}, '[\\p{{L}}\\p{{N}}_]+') THEN 'PUNCT' WHEN length({x}) <= 3 THEN 'PART' "
        f"WHEN right({x}, 1) IN ('e', 'n') THEN 'VERB' WHEN right({x}, 1) = 's' THEN 'ADJ' ELSE 'NOUN' END"
    )


def _ratio(n: str, d: str) -> str:
    return f"CASE WHEN ({d}) = 0 THEN NULL ELSE CAST((200 * ({n}) + ({d})) // (2 * ({d})) AS DOUBLE) / 100 END"


_LIST = "[" + ", ".join(f"'{k}'" for k in KEYWORDS) + "]"
_SENTENCES = r"""
WITH texts AS (
  SELECT doc_id AS text_id, 'doc-' || doc_id AS title, source AS author, CAST(1800 + doc_id % 200 AS INTEGER) AS year, lang AS genre FROM documents),
parts AS (
  SELECT doc_id AS text_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?…\n]+[.!?…]*'),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents),
sentences AS (
  SELECT text_id, CAST(i - 1 AS INTEGER) AS pos, text_id * 134217728 + i - 1 AS sentence_id, s[i] AS sentence
  FROM (SELECT text_id, s, unnest(generate_series(1, len(s))) AS i FROM parts))
"""
_CORPUS = _SENTENCES + f""",
kw AS (SELECT unnest({_LIST}) AS token),
ann AS (SELECT text_id, sentence_id, sentence, regexp_extract_all(sentence, '{_TOKEN}') AS t FROM sentences),
occ AS (
  SELECT a.text_id, a.sentence_id, k.token, a.t, a.i
  FROM (SELECT text_id, sentence_id, t, unnest(generate_series(1, len(t))) AS i FROM ann) a JOIN kw k ON lower(a.t[a.i]) = k.token),
tokens AS (
  SELECT x.text_id, k.token, (SELECT count(*) FROM occ o WHERE o.text_id = x.text_id AND o.token = k.token) AS token_count FROM texts x CROSS JOIN kw k),
crossed AS (
  SELECT text_id, sentence_id, token, 'VERB_HEAD' AS pos, {_strip('lower(t[i - 1])')} AS word FROM occ WHERE i > 1 AND {_pos('t[i - 1]')} = 'VERB'
  UNION ALL
  SELECT text_id, sentence_id, token, {_pos('t[i + 1]')}, {_strip('lower(t[i + 1])')} FROM occ WHERE i < len(t) AND {_strip('lower(t[i + 1])')} <> ''),
words AS (SELECT text_id, token, pos, word, count(*) AS frequency FROM crossed GROUP BY ALL),
positive AS (SELECT c.* FROM crossed c JOIN tokens t USING (text_id, token) WHERE t.token_count > 0),
hits AS (SELECT DISTINCT sentence_id FROM positive)
"""
_FLAG = "(" + " OR ".join(f"contains(lower(sentence), '{k}')" for k in KEYWORDS) + ")"
_FEATURES = _SENTENCES + rf""",
kept AS (
  SELECT s.text_id, s.sentence_id, x.author, substring(s.sentence, 1, 500) AS sentence
  FROM sentences s JOIN texts x USING (text_id) WHERE {_FLAG}),
tok AS (
  SELECT *, regexp_extract_all(sentence, '{_TOKEN}') AS t,
    list_transform(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}_]+'), lambda w: substring(w, 1, 1)) AS firsts FROM kept),
feats AS (
  SELECT sentence_id, author, sentence, t,
    CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t) ELSE 0 END AS lexical_diversity, CAST(len(t) AS INTEGER) AS sentence_length,
    CAST(coalesce(list_sum(list_transform(t, lambda w: CASE lower(w) {' '.join(f"WHEN '{w}' THEN {n}" for w, n in EMOTIONS.items())} ELSE 0 END)), 0) AS INTEGER) AS emotional_score,
    regexp_matches(sentence, '(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(MARKERS)})($|[^\p{{L}}\p{{N}}_])') AS contains_metaphor,
    CAST(coalesce(list_max(list_transform(list_distinct(firsts), lambda v: len(list_filter(firsts, lambda x: x = v)))), 0) AS INTEGER) AS alliteration_score,
    CAST(length(regexp_replace(lower(sentence), '[^{VOWELS}]', '', 'g')) AS INTEGER) AS rhythm_score
  FROM tok)
"""
_COVER = f""",
cover AS (
  SELECT x.text_id, x.title, x.author, x.year, count(DISTINCT s.sentence_id) AS total_sentences, count(DISTINCT h.sentence_id) AS token_sentences,
    {_ratio('100 * count(DISTINCT h.sentence_id)', 'count(DISTINCT s.sentence_id)')} AS token_sentence_percent
  FROM texts x LEFT JOIN sentences s USING (text_id) LEFT JOIN hits h ON h.sentence_id = s.sentence_id GROUP BY ALL),
per AS (
  SELECT c.text_id, c.sentence_id, count(*) AS n, count(*) FILTER (WHERE t.token_count > 0) AS p
  FROM crossed c LEFT JOIN tokens t USING (text_id, token) GROUP BY ALL),
averages AS (
  SELECT text_id, {_ratio('CAST(sum(n) AS BIGINT)', 'count(*)')} AS avg_links,
    {_ratio('CAST(sum(p * n) AS BIGINT)', 'CAST(sum(p) AS BIGINT)')} AS avg_links_weighted FROM per WHERE p > 0 GROUP BY text_id)
"""
_TOTALS = """,
totals AS (SELECT text_id, token, CAST(sum(token_count) AS BIGINT) AS total FROM tokens GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY text_id ORDER BY total DESC NULLS LAST, token) AS INTEGER) AS rank FROM totals QUALIFY rank <= 5),
pos_sums AS (
  SELECT w.text_id, w.pos, CAST(sum(w.frequency) AS BIGINT) AS total
  FROM words w JOIN crossed c ON (c.text_id, c.token, c.pos, c.word) = (w.text_id, w.token, w.pos, w.word) GROUP BY ALL),
pos_ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY text_id ORDER BY total DESC NULLS LAST, pos) AS INTEGER) AS rank FROM pos_sums QUALIFY rank <= 5)
"""
_JOINED = """,
joined AS (
  SELECT s.text_id, count(*) AS total_sentences, count(DISTINCT c.sentence_id) AS token_sentences
  FROM sentences s JOIN tokens t ON t.text_id = s.text_id AND t.token_count <> 0 LEFT JOIN crossed c ON c.text_id = s.text_id GROUP BY s.text_id),
per_sentence AS (SELECT text_id, sentence_id, count(DISTINCT (token, pos, word)) AS n FROM crossed GROUP BY ALL),
avg_w AS (SELECT text_id, round(avg(n), 6) AS avg_words FROM per_sentence GROUP BY text_id)
"""
_POSLIST = """,
pos_n AS (SELECT text_id, token, pos, count(*) AS n, string_agg(DISTINCT word, ' ' ORDER BY word) AS ex FROM words GROUP BY ALL),
pos_l AS (SELECT text_id, token, string_agg(pos || ':' || n || '[' || ex || ']', ',' ORDER BY n DESC, pos) AS pos_list FROM pos_n GROUP BY ALL)
"""
_TOPLIST = "SELECT text_id, string_agg(token || ':' || token_count, ',' ORDER BY token_count DESC, token) AS top_tokens FROM tokens WHERE token_count > 0 GROUP BY text_id"
_CONTEXT = """
, marked AS (SELECT s.text_id, s.sentence_id, s.sentence, CASE WHEN h.sentence_id IS NULL THEN 0 ELSE 1 END AS hit FROM sentences s LEFT JOIN hits h USING (sentence_id)),
near AS (SELECT *, max(hit) OVER ({part} ORDER BY sentence_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM marked)
SELECT DISTINCT text_id, sentence FROM near WHERE m = 1"""
_CONCORDANCE = """
SELECT {distinct} c.text_id, c.sentence_id, c.word, c.pos, replace(s.sentence, '{typed}', '<mark>{typed}</mark>') AS shown
FROM crossed c JOIN sentences s USING (sentence_id) WHERE c.token = '{target}'"""
_SOME = ", ".join(f"'{t}'" for t in SOME)


def oracle_sql() -> dict[str, str]:
    pivot = ", ".join(
        f"max(CASE WHEN rank = {i} THEN token END) AS \"Top{i}_Token\", max(CASE WHEN rank = {i} THEN total END) AS \"Top{i}_Count\"" for i in range(1, 6)
    )
    pivot_pos = ", ".join(f"max(CASE WHEN rank = {i} THEN pos END) AS \"POS{i}\", max(CASE WHEN rank = {i} THEN total END) AS \"POS{i}_Count\"" for i in range(1, 6))
    wide = _CORPUS + _TOTALS + _JOINED + f""", pt AS (SELECT text_id, {pivot} FROM ranked GROUP BY text_id), pp AS (SELECT text_id, {pivot_pos} FROM pos_ranked GROUP BY text_id)
        SELECT * FROM joined JOIN avg_w USING (text_id) LEFT JOIN pt USING (text_id) LEFT JOIN pp USING (text_id)"""
    a, b = PAIR
    return {
        "split_sentences": _SENTENCES + "SELECT text_id, pos, sentence_id, sentence FROM sentences",
        "author_style_stats": _FEATURES + """SELECT author, round(avg(lexical_diversity), 6) AS lexical_diversity, round(avg(sentence_length), 6) AS sentence_length,
            CAST(sum(emotional_score) AS BIGINT) AS emotional_score, CAST(sum(CAST(contains_metaphor AS BIGINT)) AS BIGINT) AS metaphors,
            round(avg(alliteration_score), 6) AS alliteration_score, round(avg(rhythm_score), 6) AS rhythm_score FROM feats WHERE author IS NOT NULL GROUP BY author""",
        "author_overview": _FEATURES + "SELECT author, round(avg(lexical_diversity), 6) AS lexical_diversity, count(*) AS n_sentences FROM feats GROUP BY author",
        "author_list": _FEATURES + "SELECT DISTINCT author FROM feats WHERE author IS NOT NULL",
        "lemmatised_request": """SELECT CAST(p AS INTEGER) AS position, word, coalesce((SELECT min(source) FROM documents WHERE lower(lang) = word), word) AS token
            FROM (VALUES (0, 'en'), (1, 'fr'), (3, 'unknown'), (4, 'de')) AS w(p, word)""",
        "stored_annotations": _CORPUS + """SELECT a.sentence_id, len(a.t) AS n_tokens, (SELECT count(*) FROM kw k WHERE contains(lower(a.sentence), k.token)) AS n_targets
            FROM ann a JOIN texts x USING (text_id) WHERE x.genre = 'de' AND EXISTS (SELECT 1 FROM kw k WHERE contains(lower(a.sentence), k.token))""",
        "catalogue": _SENTENCES + """SELECT text_id, title, author, CASE WHEN text_id % 2 = 0 THEN genre END AS genre, year AS year_from,
            CASE WHEN text_id % 3 = 0 THEN year + 5 ELSE year END AS year_to FROM texts WHERE author IS NOT NULL""",
        "sentence_csv": _CORPUS + """SELECT s.text_id AS "TextID", x.author AS "Author", x.title AS "Title", s.sentence AS "Sentence"
            FROM sentences s JOIN hits h USING (sentence_id) JOIN texts x ON x.text_id = s.text_id""",
        "metrics_csv": _CORPUS + _COVER + _POSLIST + f"""SELECT c.text_id AS "TextID", c.title AS "TextTitle", c.author AS "Text_Author", c.year AS "Text_year_creation",
              c.total_sentences, c.token_sentences, c.token_sentence_percent, coalesce(l.top_tokens, '') AS top_tokens, a.avg_links AS avg_words_per_token_sentence,
              a.avg_links_weighted AS avg_words_for_token_sentence, CAST((SELECT count(*) FROM pos_l p WHERE p.text_id = c.text_id) AS INTEGER) AS n_pos_lists
            FROM cover c LEFT JOIN ({_TOPLIST}) l ON l.text_id = c.text_id LEFT JOIN averages a ON a.text_id = c.text_id""",
        "graph_files": _CORPUS + """, r AS (SELECT text_id, token, token_count FROM tokens WHERE token_count > 0 QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY token_count DESC, token) <= 5),
            n AS (SELECT token, token || ' (' || arg_max(token_count, text_id) || ')' AS label FROM r GROUP BY token)
            SELECT 'text_' || x.text_id AS src, r.token AS dst, x.title || ' (' || coalesce(x.author, '') || ')' AS src_label, n.label AS dst_label
            FROM r JOIN texts x USING (text_id) JOIN n USING (token)""",
        "remove_cross": _CORPUS + f""", de AS (SELECT text_id FROM texts WHERE genre = 'de'),
            gone AS (SELECT * FROM crossed WHERE token = '{TARGET}' AND text_id IN (SELECT text_id FROM de)),
            e AS (SELECT text_id, token, count(*) AS n FROM crossed WHERE NOT (token = '{TARGET}' AND text_id IN (SELECT text_id FROM de)) GROUP BY ALL)
            SELECT t.text_id, t.token, CASE WHEN t.text_id = {a} AND t.token = '{TARGET}' THEN greatest(0, t.token_count - (SELECT count(*) FROM gone)) ELSE t.token_count END AS token_count,
              coalesce(e.n, 0) AS n_cross FROM tokens t LEFT JOIN e USING (text_id, token)""",
        "sentence_features": _FEATURES + """SELECT sentence_id, author, sentence, array_to_string(t, ', ') AS tokens, round(lexical_diversity, 6) AS lexical_diversity,
            sentence_length, emotional_score, contains_metaphor, alliteration_score, rhythm_score FROM feats""",
        "sentence_annotation": _CORPUS + f""", c AS (SELECT sentence_id, list_transform(t, lambda x: lower(x)) AS l, list_transform(t, lambda x: {_pos('x')}) AS p FROM ann WHERE {_FLAG})
            SELECT sentence_id, array_to_string(l, ' ') AS lemmas, array_to_string(p, ' ') AS pos,
              array_to_string(list_transform(list_sort(list_distinct(p)), lambda v: v || '=' || len(list_filter(p, lambda x: x = v))), ',') AS pos_counts FROM c""",
        "new_texts": """SELECT min(doc_id) AS text_id, concat_ws('/', source, lang) AS title FROM documents GROUP BY concat_ws('/', source, lang)
            HAVING concat_ws('/', source, lang) NOT IN (SELECT concat_ws('/', source, lang) FROM documents WHERE lang = 'fr')""",
        "validate_year": """SELECT doc_id AS text_id, CASE WHEN lang = 'de' THEN ' ' || source || chr(9) ELSE source END AS author,
            CAST(CASE WHEN lang = 'de' THEN NULL ELSE n_chars END AS INTEGER) AS year, lang IS DISTINCT FROM 'de' AS accepted FROM documents""",
        "list_texts": "SELECT row_number() OVER (ORDER BY doc_id) AS number, doc_id AS text_id, 'doc-' || doc_id AS title FROM documents",
        "text_labels": """SELECT doc_id AS text_id, 'doc-' || doc_id || ' (' || coalesce(source, '') || ')' AS label,
            'doc-' || doc_id || ' (' || concat_ws(', ', source, CAST(1800 + doc_id % 200 AS VARCHAR)) || ')' AS label_year FROM documents""",
        "tokens_table": _CORPUS + "SELECT text_id, token, token_count FROM tokens",
        "words_table": _CORPUS + "SELECT text_id, token, pos, word, frequency FROM words",
        "cross_table": _CORPUS + "SELECT sentence_id, text_id, token, pos, word FROM crossed",
        "analysis_report": _CORPUS + """SELECT t.text_id, t.token, CASE WHEN t.token_count > 0 AND x.genre = 'de' THEN 'exists'
            WHEN EXISTS (SELECT 1 FROM sentences s WHERE s.text_id = t.text_id AND contains(lower(s.sentence), t.token)) THEN 'done' ELSE 'not found' END AS status
            FROM tokens t JOIN texts x USING (text_id)""",
        "new_pairs": f"""WITH w AS (SELECT i - 1 AS position, ({_LIST})[i] AS word FROM (SELECT unnest(generate_series(1, {len(KEYWORDS)})) AS i))
            SELECT d.doc_id AS text_id, CAST(w.position AS INTEGER) AS position, w.word, w.word AS token FROM documents d CROSS JOIN w WHERE NOT (d.lang IS NOT DISTINCT FROM 'de' AND w.word = 'und')""",
        "sentences_with_tokens": _CORPUS + "SELECT text_id, sentence_id, sentence FROM sentences WHERE sentence_id IN (SELECT sentence_id FROM hits)",
        "sentences_with_author": _CORPUS + """SELECT s.text_id, s.sentence_id, CASE WHEN x.text_id IS NULL THEN 'Unknown' ELSE x.author END AS author,
            CASE WHEN x.text_id IS NULL THEN 'Unknown' ELSE x.title END AS title, s.sentence FROM sentences s JOIN hits h USING (sentence_id)
            LEFT JOIN (SELECT * FROM texts WHERE genre <> 'de') x ON x.text_id = s.text_id""",
        "context_in_text": _CORPUS + _CONTEXT.format(part="PARTITION BY text_id"),
        "context_global": _CORPUS + _CONTEXT.format(part=""),
        "keyword_flags": _SENTENCES + f"SELECT sentence_id, sentence FROM sentences WHERE {_FLAG}",
        "keyword_sentences": _CORPUS + f"SELECT s.sentence, x.author, x.genre FROM sentences s JOIN crossed c USING (sentence_id) JOIN texts x ON x.text_id = c.text_id WHERE {_FLAG}",
        "concordance": _CORPUS + _CONCORDANCE.format(distinct="DISTINCT", target=TARGET, typed=TARGET),
        "concordance_lemma": _CORPUS + _CONCORDANCE.format(distinct="DISTINCT", target=TARGET, typed="de"),
        "concordance_all": _CORPUS + _CONCORDANCE.format(distinct="", target=TARGET, typed=TARGET),
        "concordance_index": _CORPUS + _CONCORDANCE.format(distinct="", target=TARGET, typed=TARGET),
        "sentences_of_files": _SENTENCES + "SELECT sentence, count(*) AS n FROM sentences GROUP BY sentence",
        "tokens_of_text": _CORPUS + f"SELECT token, token_count FROM tokens WHERE text_id = {a}",
        "words_of_token": _CORPUS + f"SELECT text_id, pos, word, frequency FROM words WHERE token = '{TARGET}'",
        "sentences_of_word": _CORPUS + f""", f AS (SELECT * FROM words WHERE word = '{WORD}' QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY pos, token) = 1)
            SELECT text_id, sentence_id, sentence FROM sentences WHERE sentence_id IN (SELECT c.sentence_id FROM crossed c JOIN f USING (text_id, token, pos, word))""",
        "top_adjectives": _CORPUS + "SELECT text_id, word, frequency FROM words WHERE pos = 'ADJ' ORDER BY frequency DESC, word, text_id LIMIT 10",
        "conversations_by_role": "SELECT role AS author, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY role",
        "text_coverage": _CORPUS + _COVER + "SELECT * FROM cover",
        "text_coverage_joined": _CORPUS + _JOINED + "SELECT * FROM joined",
        "title_coverage": _CORPUS + f""", r AS (SELECT x.title, c.sentence_id AS linked FROM texts x JOIN sentences s USING (text_id) LEFT JOIN crossed c ON c.text_id = x.text_id)
            SELECT title, count(*) AS total_sentences, count(linked) AS token_sentences, {_ratio('100 * count(linked)', 'count(*)')} AS percent FROM r GROUP BY title""",
        "avg_words_per_sentence": _CORPUS + _JOINED + "SELECT text_id, avg_words FROM avg_w",
        "link_averages": _CORPUS + _COVER + "SELECT text_id, avg_links, avg_links_weighted FROM averages",
        "coverage_vs_length": _CORPUS + _COVER + "SELECT text_id, title, total_sentences, token_sentences, token_sentence_percent, avg_links FROM cover LEFT JOIN averages USING (text_id)",
        "token_totals": _CORPUS + _TOTALS + "SELECT text_id, token, total FROM totals",
        "top_tokens": _CORPUS + _TOTALS + "SELECT text_id, token, total, rank FROM ranked",
        "pos_totals": _CORPUS + _TOTALS + "SELECT text_id, pos, total FROM pos_sums",
        "top_pos": _CORPUS + _TOTALS + "SELECT text_id, pos, total, rank FROM pos_ranked",
        "analytical_table": wide,
        "wide_csv": wide,
        "compare_texts": _CORPUS + f""", b AS (SELECT *, row_number() OVER (PARTITION BY pos, text_id ORDER BY frequency DESC, word) AS rn FROM words
              WHERE token IN ({_SOME}) AND text_id IN ({a}, {b}) QUALIFY rn <= 5)
            SELECT pos, coalesce(string_agg(word || ' (' || frequency || ')', ', ' ORDER BY rn) FILTER (WHERE text_id = {a}), '') AS words_a,
              coalesce(string_agg(word || ' (' || frequency || ')', ', ' ORDER BY rn) FILTER (WHERE text_id = {b}), '') AS words_b FROM b GROUP BY pos""",
        "top_words_with_context": _CORPUS + f""", b AS (SELECT w.pos, w.word, w.frequency, w.text_id, c.sentence_id,
              CAST(row_number() OVER (PARTITION BY w.pos ORDER BY w.frequency DESC, w.word, w.text_id, c.sentence_id) AS INTEGER) AS rank
              FROM words w JOIN crossed c USING (text_id, token, pos, word) WHERE w.token IN ({_SOME}) QUALIFY rank <= 5)
            SELECT b.*, s.sentence FROM b JOIN sentences s ON s.sentence_id = b.sentence_id""",
        "tokens_json": _CORPUS + _TOPLIST,
        "pos_per_token": _CORPUS + _POSLIST + "SELECT t.text_id, t.token, pos_list FROM tokens t LEFT JOIN pos_l USING (text_id, token)",
        "pos_map": _CORPUS + _POSLIST + "SELECT t.text_id, 'top_pos_' || t.token AS key, pos_list FROM tokens t LEFT JOIN pos_l USING (text_id, token)",
        "text_report": _CORPUS + _COVER + _POSLIST + f"""SELECT c.*, l.top_tokens, a.avg_links, a.avg_links_weighted,
              CAST((SELECT count(*) FROM pos_l p WHERE p.text_id = c.text_id) AS INTEGER) AS n_pos_lists
            FROM cover c LEFT JOIN ({_TOPLIST}) l ON l.text_id = c.text_id LEFT JOIN averages a ON a.text_id = c.text_id""",
        "corpus_totals": _CORPUS + _COVER + """SELECT CAST(sum(total_sentences) AS BIGINT) AS total_sentences, CAST(sum(token_sentences) AS BIGINT) AS token_sentences,
            round(avg(token_sentence_percent), 6) AS avg_percent, round(avg(avg_links), 6) AS avg_links FROM cover LEFT JOIN averages USING (text_id)""",
        "top_tokens_corpus": _CORPUS + "SELECT token, CAST(sum(token_count) AS BIGINT) AS total FROM tokens WHERE token_count > 0 GROUP BY token ORDER BY total DESC, token LIMIT 10",
        "pos_distribution": _CORPUS + "SELECT pos, count(*) AS total FROM words GROUP BY pos",
        "author_timeline": _SENTENCES + "SELECT year, author, title FROM texts",
        "graph_nodes": _CORPUS + """, r AS (SELECT text_id, token, token_count FROM tokens WHERE token_count > 0 QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY token_count DESC, token) <= 5)
            SELECT 'text_' || text_id AS id, title || ' (' || coalesce(author, '') || ')' AS label, 'text' AS type FROM texts
            UNION ALL SELECT token, token || ' (' || arg_max(token_count, text_id) || ')', 'token' FROM r GROUP BY token""",
        "graph_edges": _CORPUS + """SELECT 'text_' || text_id AS src, token AS dst, 'contains' AS label FROM tokens WHERE token_count > 0
            QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY token_count DESC, token) <= 5""",
        "drop_texts": _CORPUS + ", k AS (SELECT text_id FROM texts WHERE genre IS DISTINCT FROM 'de') " + " UNION ALL ".join(
            f"SELECT '{name}' AS name, count(*) AS n, CAST(sum(text_id) AS BIGINT) AS ids FROM {table} WHERE text_id IN (SELECT text_id FROM k)"
            for name, table in (("texts", "texts"), ("sentences", "sentences"), ("tokens", "tokens"), ("words", "words"), ("cross", "crossed"))
        ),
        "remove_occurrences": _CORPUS + """, e AS (SELECT text_id, token, count(*) AS links, count(DISTINCT (sentence_id, pos, word)) AS gone FROM crossed GROUP BY ALL)
            SELECT t.text_id, t.token, greatest(0, t.token_count - coalesce(e.gone, 0)) AS token_count, coalesce(e.links - e.gone, 0) AS n_cross
            FROM tokens t LEFT JOIN e USING (text_id, token)""",
        "second_analysis": _CORPUS + """, w AS (SELECT text_id, token, count(*) AS n FROM words GROUP BY ALL), c AS (SELECT text_id, token, count(*) AS n FROM crossed GROUP BY ALL)
            SELECT t.text_id, t.token, t.token_count, coalesce(w.n, 0) AS n_words, coalesce(c.n, 0) AS n_cross, 'exists' AS status, CAST(2 AS INTEGER) AS version
            FROM tokens t LEFT JOIN w USING (text_id, token) LEFT JOIN c USING (text_id, token)""",
        "stored_drop_texts": _CORPUS + ", k AS (SELECT text_id FROM texts WHERE genre IS DISTINCT FROM 'de') " + " UNION ALL ".join(
            f"SELECT '{name}' AS name, count(*) FILTER (WHERE text_id IN (SELECT text_id FROM k)) AS n, CAST(sum(text_id) FILTER (WHERE text_id IN (SELECT text_id FROM k)) AS BIGINT) AS ids, count(*) AS n_before, count(*) FILTER (WHERE text_id IN (SELECT text_id FROM k)) AS n_counted FROM {table}"
            for name, table in (("texts", "texts"), ("sentences", "sentences"), ("tokens", "tokens"), ("words", "words"), ("cross", "crossed"))
        ),
        "stored_removals": _CORPUS + """, e AS (SELECT text_id, token, count(*) AS links, count(DISTINCT (sentence_id, pos, word)) AS gone FROM crossed GROUP BY ALL)
            SELECT t.text_id, t.token, greatest(0, t.token_count - coalesce(e.gone, 0)) AS token_count, coalesce(e.links - e.gone, 0) AS n_cross
            FROM tokens t LEFT JOIN e USING (text_id, token)""",
        "added_texts": _SENTENCES + """SELECT x.genre, count(DISTINCT x.text_id) AS n_texts, count(s.sentence_id) AS n_sentences
            FROM texts x LEFT JOIN sentences s USING (text_id) GROUP BY x.genre""",
        "stored_candidates": _SENTENCES + f""", w AS (SELECT unnest([{', '.join(f"'{p}'" for p in PATTERNS if p not in KEYWORDS)}]) AS word)
            SELECT s.sentence_id, string_agg(w.word, ',' ORDER BY w.word) AS targets FROM sentences s JOIN texts x USING (text_id) JOIN w ON s.sentence ILIKE '%' || w.word || '%'
            WHERE x.genre = 'de' GROUP BY s.sentence_id""",
        "emotional_lexicon": _SENTENCES + rf""", l AS (SELECT DISTINCT lower(regexp_extract(text, '[\p{{L}}\p{{N}}_]+')) AS word FROM documents),
            t AS (SELECT sentence_id, lower(unnest(regexp_extract_all(sentence, '{_TOKEN}'))) AS word FROM sentences),
            v AS (SELECT t.sentence_id, sum(length(l.word) % 5 - 2) AS score FROM t JOIN l USING (word) WHERE l.word <> '' GROUP BY ALL)
            SELECT s.sentence_id, CAST(coalesce(v.score, 0) AS BIGINT) AS emotional_score FROM sentences s LEFT JOIN v USING (sentence_id)""",
        "many_words": _SENTENCES + r""", l AS (SELECT DISTINCT lower(regexp_extract(text, '[\p{L}\p{N}_]+')) AS word FROM documents)
            SELECT sentence_id FROM sentences s WHERE EXISTS (SELECT 1 FROM l WHERE l.word <> '' AND contains(lower(s.sentence), l.word))""",
        "extraction_counts": _CORPUS + ", near_text AS (" + _CONTEXT.format(part="PARTITION BY text_id").replace(", marked AS", "WITH marked AS", 1) + """)
            SELECT 'linked' AS name, (SELECT count(*) FROM hits) AS n UNION ALL SELECT 'context', (SELECT count(*) FROM near_text)""",
        "explode_links": """SELECT DISTINCT l_orderkey AS word_id, l_partkey AS sentence_id FROM lineitem
            WHERE (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1)""",
    }
