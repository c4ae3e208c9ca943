"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]
    turns = turns.unionByName(spark.createDataFrame(trial, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_conversations(turns))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import components

    return components(read_table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_model

    docs = read_table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, read_table(spark, sf_dir, "labels")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches

    return matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import url_filter

    return url_filter(read_table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 6))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    made = warc.derivatives(warc.from_pages(read_table(spark, sf_dir, "pages")))
    return made.withColumn("text", F.when(F.col("record_type") == "conversion", F.col("block").cast("string"))).drop("block")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dedup": OP1, "op4_chat": _op4(), "op8_url_filter": _op8()}


#: All pairs that share a shingle, then reachability.
OP1 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 70 * (p.n + q.n - both_)),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


def _op4() -> str:
    from . import chat

    def escaped(x: str) -> str:
        q = lambda t: "'" + t.replace(chat.ESCAPE, "' || chr(27) || '") + "'"
        x = f"replace({x}, chr(27), chr(27) || 'e')"
        for c in chat.CONTROL:
            x = f"replace({x}, {q(c)}, {q(c[0] + chat.ESCAPE + 'c' + c[1:])})"
        return x

    marks = len(chat.OPEN + chat.MIDDLE + chat.CLOSE)
    trial = "</s>[INST] ok [/INST]"
    return f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{trial}'), (-7, 1, 'assistant', '{trial}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({marks} + length({escaped('role')}) + length({escaped('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def _op8() -> str:
    """Rules, the words of all pages, the likeliest split of each host by dynamic programming, and naive
    Bayes over all tokens of the URLs that the rules decide."""
    from . import url_filter as U

    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"({k}, '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for k, (r, v) in enumerate(U.RULES))
    letter = r"[\p{L}\p{Nl}\p{No}]"
    return rf"""
WITH RECURSIVE u AS (
    SELECT row_number() OVER () AS r, page_id, {lower("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
rules AS (SELECT * FROM (VALUES {rules}) AS x(k, rule, h, p, verdict)),
ruled AS (SELECT r, arg_max(rule, (length(rule), -k)) AS rule, arg_max(verdict, (length(rule), -k)) AS decided
    FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r),
seen AS (SELECT lower(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^<>]*>|&#?\w+;', ' ', 'g')) AS t FROM pages),
lex AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '{letter}+')) AS w FROM seen) GROUP BY w),
whole AS (SELECT sum(n) AS total FROM lex),
hosts AS (SELECT DISTINCT host FROM u),
runs AS (SELECT host, i, list_extract(x, i) AS run FROM (SELECT host, regexp_extract_all(lower(host), '\p{{Nd}}+|{letter}+') AS x FROM hosts), unnest(range(1, len(x) + 1)) AS t(i)),
names AS (SELECT DISTINCT run AS name FROM runs WHERE NOT regexp_matches(run, '^\p{{Nd}}')),
parts AS (SELECT name, e, s, substr(name, s + 1, e - s) AS w FROM names, unnest(range(1, length(name) + 1)) AS a(e), unnest(range(0, e)) AS b(s)),
costs AS (SELECT name, list(coalesce(ln(n / total), ln(1 / total) - 1 - 2.3::DOUBLE * length(p.w)) ORDER BY e, s) AS c
    FROM parts p LEFT JOIN lex ON lex.w = p.w, whole GROUP BY name),
walk AS (
    SELECT name, 0 AS e, [0.0::DOUBLE] AS best, CAST([] AS BIGINT[]) AS back FROM costs
    UNION ALL
    SELECT name, e, list_append(best, list_max(x)), list_append(back, len(x) - list_position(list_reverse(x), list_max(x)))
    FROM (SELECT k.name, k.e + 1 AS e, best, back, list_transform(range(0, k.e + 1), lambda s: best[s + 1] + c[k.e * (k.e + 1) // 2 + s + 1]) AS x
        FROM walk k JOIN costs USING (name) WHERE k.e < length(k.name))),
track AS (
    SELECT name, e, back, back[e] AS s FROM walk WHERE e = length(name) AND e > 0
    UNION ALL
    SELECT name, s, back, back[s] FROM track WHERE s > 0),
split AS (SELECT name, list(substr(name, s + 1, e - s) ORDER BY s) AS words FROM track GROUP BY name),
host_tokens AS (
    SELECT host, i, 0 AS j, 'h:#' || length(run) AS token FROM runs WHERE regexp_matches(run, '^\p{{Nd}}')
    UNION ALL
    SELECT host, i, j, 'h:' || words[j] FROM runs JOIN split ON run = name, unnest(range(1, len(words) + 1)) AS t(j)),
path_tokens AS (SELECT r, CASE WHEN regexp_matches(x, '^\p{{Nd}}') THEN 'p:#' || length(x) ELSE 'p:' || x END AS token
    FROM (SELECT r, unnest(regexp_extract_all(lower(path), '\p{{Nd}}+|{letter}+')) AS x FROM u)),
tokens AS (SELECT r, token FROM path_tokens UNION ALL SELECT r, token FROM u JOIN host_tokens USING (host)),
counts AS (SELECT token, count(*) FILTER (decided = 'allow') AS a, count(*) FILTER (decided = 'block') AS b FROM tokens JOIN ruled USING (r) GROUP BY token),
sums AS (SELECT count(*) AS v, sum(a) AS a, sum(b) AS b FROM counts),
odds AS (SELECT token, ln((c.b + 1) / (s.b + v)) - ln((c.a + 1) / (s.a + v)) AS odds FROM counts c, sums s),
prior AS (SELECT ln(count(*) FILTER (decided = 'block') / count(*) FILTER (decided = 'allow')) AS prior FROM ruled),
scores AS (SELECT r, sum(odds) AS score FROM tokens JOIN odds USING (token) GROUP BY r),
named AS (SELECT host, string_agg(substr(token, 3), ' ' ORDER BY i, j) AS words FROM host_tokens GROUP BY host)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN prior + coalesce(score, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
    coalesce(words, '') AS words, round(prior + coalesce(score, 0), 6) AS score
FROM u LEFT JOIN ruled USING (r) LEFT JOIN scores USING (r) LEFT JOIN named USING (host), prior"""
