"""The catalog's queries as DuckDB SQL, put together from named parts.

Words are ASCII here, so that SQL's string functions count bytes."""

from __future__ import annotations

from ..functions.stopwords import STOPWORDS

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
_WORDS = "regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9]+')"


def _good(word: str, least: int = 3) -> str:
    return f"(length({word}) >= {least} AND regexp_matches({word}, '[A-Za-z]'))"


DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc, split_part(text, chr(10), 1) AS title, text FROM documents)"
PAGES = """docs AS (SELECT CAST(page_id AS VARCHAR) AS doc, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title,
    regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS text FROM pages)"""

TOKENS = f"""
lists AS (SELECT doc, {_WORDS.format('title')} AS tw, {_WORDS.format('text')} AS bw FROM docs),
tok AS (
    SELECT doc, -1 - i AS pos, w FROM (SELECT doc, unnest(tw) AS w, unnest(range(len(tw))) AS i FROM lists)
    UNION ALL
    SELECT doc, i AS pos, w FROM (SELECT doc, unnest(bw) AS w, unnest(range(len(bw))) AS i FROM lists)),
kept AS (SELECT doc, pos, lower(w) AS term FROM tok WHERE {_good('w')} AND lower(w) NOT IN ({_STOP})),
post AS (SELECT term, doc, count(*) AS tf FROM kept GROUP BY term, doc),
art AS (SELECT doc, len(bw) AS size, maxf FROM lists JOIN (SELECT doc, max(tf) AS maxf FROM post GROUP BY doc) USING (doc)),
stats AS (SELECT count(*) AS n, CAST(floor(sum(size) / count(*)) AS BIGINT) AS avg_len FROM art),
dict AS (SELECT DISTINCT lower(w) AS term FROM tok WHERE {_good('w', 4)}),
vocab AS (SELECT term FROM kept UNION SELECT term FROM dict)"""

QUERIES = f"""
qw AS (SELECT DISTINCT item_id AS query_id, lower(u) AS word
    FROM (SELECT item_id, unnest({_WORDS.format('text')}) AS u FROM benchmark))"""


def _dl(a: str, b: str, k: int) -> str:
    return f"damerau_levenshtein({a}, {b}) <= {k}"


def _swapped(w: str) -> str:
    m = f"(length({w}) // 2)"
    return f"(substr({w}, 1, {m} - 1) || substr({w}, {m} + 1, 1) || substr({w}, {m}, 1) || substr({w}, {m} + 2))"


def _within_two(w: str, t: str) -> str:
    """The two-edit rule. SQL's distance lets an edit fall between two swapped characters; so either
    no swap is needed, or the sides of some swap are within one edit in all."""
    at = " OR ".join(
        f"(substr({t}, {j}, 2) = substr({w}, i + 1, 1) || substr({w}, i, 1) AND {j} >= 1 AND damerau_levenshtein(substr({w}, 1, i - 1), "
        f"substr({t}, 1, {j} - 1)) + damerau_levenshtein(substr({w}, i + 2), substr({t}, {j} + 2)) <= 1)"
        for j in ("(i - 1)", "i", "(i + 1)")
    )
    swap = f"len(list_filter(range(1, length({w})), lambda i: {at})) > 0"
    return f"({_dl(w, t, 2)} AND (levenshtein({w}, {t}) <= 2 OR {swap} OR (length({w}) >= 2 AND {_dl(_swapped(w), t, 1)})))"


def _tiers(name: str, source: str, most: int) -> str:
    """CTEs: {name}(word, term, k) for the distinct words of source(word)."""
    out = f"""
{name}0 AS (SELECT word, term, 0 AS k FROM (SELECT DISTINCT word FROM {source}) JOIN vocab ON term = word),
{name}m AS (SELECT DISTINCT word FROM {source} WHERE word NOT IN (SELECT word FROM {name}0)),
{name}1 AS (SELECT word, term, 1 AS k FROM {name}m JOIN vocab ON abs(length(word) - length(term)) <= 1 AND {_dl('word', 'term', 1)})"""
    rows = f"SELECT * FROM {name}0 UNION ALL SELECT * FROM {name}1"
    if most == 2:
        out += f""",
{name}mm AS (SELECT word FROM {name}m WHERE word NOT IN (SELECT word FROM {name}1)),
{name}2 AS (SELECT word, term, 2 AS k FROM {name}mm JOIN vocab ON abs(length(word) - length(term)) <= 2 AND {_within_two('word', 'term')})"""
        rows += f" UNION ALL SELECT * FROM {name}2"
    return out + f",\n{name} AS ({rows})"


CORRECTION = f"""
lw AS (SELECT DISTINCT word FROM qw WHERE {_good('word')}),{_tiers('tier', 'lw', 2)},
found AS (SELECT word, min(k) AS k, count(*) AS n, list_sort(list(term)) AS terms FROM tier GROUP BY word),
corr AS (SELECT q.word, CASE WHEN k > 0 AND n <= 10 THEN terms ELSE [q.word] END AS alternatives,
    CASE WHEN NOT {_good('q.word')} OR coalesce(k = 0, false) THEN NULL ELSE coalesce(k > 0 AND n <= 10, false) END AS corrected
    FROM (SELECT DISTINCT word FROM qw) q LEFT JOIN found USING (word))"""

MATCHING = f"""
alts AS (SELECT query_id, word, unnest(alternatives) AS alt FROM qw JOIN corr USING (word)),
sets AS (SELECT DISTINCT query_id, terms FROM (SELECT query_id, word, list_sort(list(DISTINCT alt)) AS terms FROM alts
    WHERE {_good('alt')} AND alt NOT IN ({_STOP}) GROUP BY query_id, word)),
sw AS (SELECT query_id, terms, unnest(terms) AS word FROM sets),{_tiers('key', 'sw', 1)},
keys AS (SELECT DISTINCT query_id, terms, term AS key FROM sw JOIN key USING (word)),
hits AS (SELECT query_id, key, doc, tf FROM (SELECT DISTINCT query_id, key FROM keys) JOIN post ON term = key),
matched AS (SELECT query_id, doc FROM (SELECT query_id, doc, count(DISTINCT terms) AS n FROM keys JOIN hits USING (query_id, key) GROUP BY query_id, doc)
    JOIN (SELECT query_id, count(*) AS n FROM sets GROUP BY query_id) USING (query_id, n))"""

SCORES = """
df AS (SELECT query_id, key, count(DISTINCT doc) AS df FROM hits GROUP BY query_id, key),
nk AS (SELECT query_id, count(*) AS n_keys FROM df GROUP BY query_id),
parts AS (SELECT query_id, doc, tf / size AS f, size, n, avg_len, df FROM hits JOIN matched USING (query_id, doc) JOIN df USING (query_id, key)
    JOIN (SELECT * FROM art WHERE size > 0) USING (doc), stats),
text_scores AS (SELECT query_id, doc, sum(greatest(0.4::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)))
    * (f * 2.6::DOUBLE / (f + 1.6::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / avg_len)))) AS text_score FROM parts GROUP BY query_id, doc)"""

BOOSTS = f"""
ql AS (SELECT query_id, list(DISTINCT alt) AS q FROM alts GROUP BY query_id),
kl AS (SELECT query_id, list(DISTINCT key) AS ks FROM hits GROUP BY query_id),
titles AS (SELECT doc, list_transform(tw, lambda x: lower(x)) AS t FROM lists),
boosts AS (SELECT query_id, doc, 10 * len(list_intersect(q, t)) / (len(q) + len(t) - len(list_intersect(q, t))) AS boost_words,
    10 * len(list_intersect(ks, list_filter(t, lambda x: {_good('x')} AND NOT list_contains([{_STOP}], x)))) / len(ks) AS boost_keys
    FROM matched JOIN titles USING (doc) JOIN ql USING (query_id) JOIN kl USING (query_id))"""

RANKED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank
    FROM (SELECT query_id, doc, round(text_score + boost_words + boost_keys, 6) AS score FROM text_scores JOIN boosts USING (query_id, doc)))"""


def sql(select: str, *parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


def _all(docs: str, *more: str) -> tuple[str, ...]:
    return (docs, TOKENS, QUERIES, CORRECTION, MATCHING, *more)


_POSTINGS = """SELECT term, doc, count(*) AS tf, concat_ws(',', string_agg(CASE WHEN pos < 0 THEN pos END, ',' ORDER BY pos DESC),
    string_agg(CASE WHEN pos >= 0 THEN pos END, ',' ORDER BY pos)) AS positions FROM kept GROUP BY term, doc"""

_ISLANDS = """
pos AS (SELECT DISTINCT query_id, doc, pos FROM (SELECT DISTINCT query_id, key FROM keys) JOIN kept ON term = key JOIN matched USING (query_id, doc) WHERE pos >= 0),
marked AS (SELECT *, CASE WHEN pos - 10 <= lag(pos) OVER (PARTITION BY query_id, doc ORDER BY pos) + 16 THEN 0 ELSE 1 END AS new FROM pos),
parted AS (SELECT *, sum(new) OVER (PARTITION BY query_id, doc ORDER BY pos) AS part FROM marked)"""

_FILTERED = """SELECT doc_id FROM documents
    WHERE source <> 'src1' AND text IS NOT NULL AND text <> '' AND lower(substr(text, 1, 9)) <> '#redirect'"""

#: What stands before and after a document's letters in wiki_markup, and what is left of it.
WIKI_HEAD = "{{box|a={{b|c}}}}\n== Empty ==\n== Lead ==\n'''Name''' [[target|label]]s [[plain]] [[File:x.png]] "
WIKI_TAIL = " [http://h.org/x words here]<ref>gone</ref> <b>bold</b><!-- no -->\n* item &amp;amp; more\n{| class=t\n| cell\n|}\n=== Sub! ===\n<math>a^2</math> then <math>b</math>....... end,, &eacute;\n(bracketed)\n== Last =="
_WIKI = """SELECT doc_id, 'Lead.' || chr(10) || 'Name labels plain ' || array_to_string(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), ' ') ||
    ' words here bold' || chr(10) || ' item &amp; more' || chr(10) || 'Sub!' || chr(10) || 'formula_1 then formula_2... end, é' AS text FROM documents"""


def _unescaped(text: str) -> str:
    """The references that the pages use, twice; & goes last, as it may begin another."""
    for _ in range(2):
        for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
            text = f"replace({text}, '&{name};', '{sign}')"
    return text


_FED = """docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc, split_part(text, chr(10), 1) AS title, text FROM documents)"""
_PAGE_WORDS = f"""pw AS (SELECT DISTINCT lower(w) AS term FROM (SELECT unnest({_WORDS.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS w FROM pages) WHERE {_good('w', 4)}),
kept_keys AS (SELECT DISTINCT term FROM kept UNION SELECT term FROM pw)"""
_STORE_WORDS = ("thanedble", "toanensting", "nosuchword", "the")


def _store_queries() -> str:
    near = {0: lambda w: f"term = '{w}'", 1: lambda w: _dl(f"'{w}'", "term", 1), 2: lambda w: _within_two(f"'{w}'", "term")}
    parts = [f"SELECT '{w}' AS word, term FROM kept_keys WHERE {near[min(k, 2)](w)}" for k, w in enumerate(_STORE_WORDS)]
    return f"""SELECT word, term, count(*) OVER (PARTITION BY word) AS exact_total, row_number() OVER (PARTITION BY word ORDER BY encode(term)) AS place
    FROM ({' UNION ALL '.join(parts)})"""


_BEYOND = r"""SELECT DISTINCT word, term FROM (SELECT DISTINCT unnest(regexp_extract_all(regexp_extract(html, '<title>([^<]*)</title>', 1), '[\p{L}\p{N}]+')) AS word FROM pages),
    (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS term FROM documents)
    WHERE strlen(word) > length(word) AND strlen(term) > length(term) AND abs(strlen(word) - strlen(term)) <= 1 AND damerau_levenshtein(word, term) <= 1"""

ORACLES: dict[str, str] = {
    "article_filters": _FILTERED,
    "tokens_posexplode": sql("SELECT doc, pos, term FROM kept", DOCS, TOKENS),
    "postings_build": sql(_POSTINGS, DOCS, TOKENS),
    "postings_batches": sql(
        "SELECT CAST(floor(CAST(doc AS BIGINT) / 50) AS BIGINT) AS batch, term, count(*) AS n_docs, string_agg(doc || ':' || tf, ' ' ORDER BY doc) AS docs FROM post GROUP BY ALL", DOCS, TOKENS
    ),
    "postings_merge": sql(_POSTINGS, DOCS, TOKENS),
    "streaming_ingest": sql(_POSTINGS, DOCS, TOKENS),
    "doc_stats": sql("SELECT doc, size, maxf FROM art", DOCS, TOKENS),
    "corpus_stats": sql("SELECT n, avg_len FROM stats", DOCS, TOKENS),
    "vocab_distinct": sql("SELECT term, length(term) AS term_len, reverse(term) AS term_rev FROM vocab", DOCS, TOKENS),
    "dictionary_words": sql("SELECT term FROM dict", DOCS, TOKENS),
    "document_frequency": sql(
        "SELECT term, df, cf, round(greatest(0.4::DOUBLE, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))), 6) AS idf "
        "FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY term), stats",
        DOCS,
        TOKENS,
    ),
    "term_lookup_exact": sql("SELECT word, doc, tf FROM (SELECT DISTINCT word FROM qw) JOIN post ON term = word", DOCS, TOKENS, QUERIES),
    "keys_only_lookup": sql("SELECT word, term FROM (SELECT DISTINCT word FROM qw) JOIN vocab ON term = word", DOCS, TOKENS, QUERIES),
    "fuzzy_k1": sql(
        f"SELECT word, term FROM (SELECT DISTINCT word FROM qw WHERE {_good('word')}) JOIN vocab ON abs(length(word) - length(term)) <= 1 AND {_dl('word', 'term', 1)}",
        DOCS, TOKENS, QUERIES,
    ),
    "fuzzy_k2": sql(
        f"SELECT word, term FROM (SELECT DISTINCT word FROM qw WHERE {_good('word')}) JOIN vocab ON abs(length(word) - length(term)) <= 2 AND {_within_two('word', 'term')}",
        DOCS, TOKENS, QUERIES,
    ),
    "word_query_page": sql(
        f"""SELECT word, term, exact_total FROM (SELECT word, term, count(*) OVER (PARTITION BY word) AS exact_total,
        row_number() OVER (PARTITION BY word ORDER BY term) AS r FROM (SELECT DISTINCT word FROM qw WHERE {_good('word')})
        JOIN vocab ON abs(length(word) - length(term)) <= 1 AND {_dl('word', 'term', 1)}) WHERE r > 1 AND r <= 4""",
        DOCS, TOKENS, QUERIES,
    ),
    "spell_correct": sql("SELECT word, array_to_string(alternatives, ' ') AS alternatives, corrected FROM corr", DOCS, TOKENS, QUERIES, CORRECTION),
    "query_sets": sql("SELECT query_id, array_to_string(terms, ' ') AS terms FROM sets", *_all(DOCS)),
    "bool_and_or": sql("SELECT query_id, doc FROM matched", *_all(DOCS)),
    "bm25_rank": sql("SELECT query_id, doc, round(text_score, 6) AS text_score, n_keys FROM text_scores JOIN nk USING (query_id)", *_all(DOCS, SCORES)),
    "title_boost": sql("SELECT query_id, doc, round(boost_words, 6) AS boost_words, round(boost_keys, 6) AS boost_keys FROM boosts", *_all(DOCS, BOOSTS)),
    "ranked_topk": sql("SELECT query_id, doc, score, rank FROM ranked WHERE rank <= 10", *_all(DOCS, SCORES, BOOSTS, RANKED)),
    "ranked_pages": sql("SELECT query_id, doc, score, rank FROM ranked WHERE rank > 10 AND rank <= 20",
        PAGES, TOKENS, """
qw AS (SELECT DISTINCT query_id, word FROM (VALUES (1, 'the'), (1, 'ration'), (2, 'en'), (2, 'licence'), (3, 'example'), (4, 'exmaple'), (4, 'track')) AS v(query_id, word))""",
        CORRECTION, MATCHING, SCORES, BOOSTS, RANKED),
    "snippet_islands": sql(
        'SELECT query_id, doc, CAST(part AS BIGINT) AS part, min(pos) - 10 AS "start", max(pos) + 16 AS "end", string_agg(pos, \',\' ORDER BY pos) AS hits FROM parted GROUP BY query_id, doc, part',
        *_all(DOCS, _ISLANDS),
    ),
    "store_feeds": sql(_POSTINGS, _FED, TOKENS),
    "store_articles": sql("SELECT doc, title, length(text) AS chars, size FROM art JOIN docs USING (doc)", _FED, TOKENS),
    "store_vocabulary": sql("SELECT term FROM kept_keys", _FED, TOKENS, _PAGE_WORDS),
    "store_point_reads": sql(_POSTINGS.replace("FROM kept", f"FROM kept WHERE term IN {_STORE_WORDS}"), _FED, TOKENS),
    "store_word_queries": sql(_store_queries(), _FED, TOKENS, _PAGE_WORDS),
    "fuzzy_bytes": _BEYOND,
    "wiki_markup": _WIKI,
    "entity_unescape": f"SELECT page_id, {_unescaped('html')} AS text FROM pages",
    "idf": sql(
        "SELECT df, round(greatest(0.4::DOUBLE, ln((any_value(n) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))), 6) AS idf, count(*) AS n_terms "
        "FROM (SELECT term, count(*) AS df FROM post GROUP BY term), stats GROUP BY df",
        DOCS,
        TOKENS,
    ),
    "store_stats": sql(
        """SELECT (SELECT count(*) FROM vocab) AS n_terms, (SELECT CAST(sum(length(term)) AS BIGINT) FROM vocab) AS term_bytes, (SELECT max(length(term)) FROM vocab) AS longest_term,
        (SELECT count(*) FROM post) AS n_postings, (SELECT CAST(sum(tf) AS BIGINT) FROM post) AS n_positions,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM post GROUP BY term)) AS longest_list, (SELECT count(*) FROM art) AS n_articles""",
        DOCS, TOKENS,
    ),
}
