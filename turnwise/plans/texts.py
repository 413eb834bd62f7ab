"""Queries over the texts of conversations and documents. Frequent tokens of the tables stand in for word lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions import text as T
from turnwise.registry import dround, query
from turnwise.sources.sinks import turn_bodies
from turnwise.sources.tables import conversations, read

POSITIVE, NEGATIVE, NEGATORS = ["the", "and", "best", "to", "de"], ["no", "is", "for", "la"], ["of", "in"]
_in = lambda words: ", ".join(f"'{w}'" for w in words)
TOKENS_SQL = "regexp_extract_all(lower(text), '([a-z'']+)', 1)"


@query(f"""WITH t AS (SELECT doc_id, {TOKENS_SQL} AS tk FROM documents), s AS (SELECT doc_id, list_sum(list_transform(range(1, len(tk) + 1), lambda i: coalesce(
        (CASE WHEN tk[i] IN ({_in(POSITIVE)}) THEN 1.0::DOUBLE WHEN tk[i] IN ({_in(NEGATIVE)}) THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END)
        * (CASE WHEN i > 1 AND tk[i - 1] IN ({_in(NEGATORS)}) THEN -0.6::DOUBLE ELSE 1.0::DOUBLE END), 0.0::DOUBLE))) AS total FROM t)
    SELECT doc_id, coalesce({dround("(CAST(printf('%.12f', CAST(total / sqrt(total * total + 15) AS DOUBLE)) AS DOUBLE) + 0.0)", 3)}, 0.0) AS lexical FROM s""")
def lexical_sentiment(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.sentiment(F.col("text"), {**dict.fromkeys(POSITIVE, 1.0), **dict.fromkeys(NEGATIVE, -1.0)}, NEGATORS).alias("lexical"))


@query(r"""WITH s AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(?i)\b(?:the|of|to)\b[,.]?', '', 'g'), '\[[^\]]*\]', '', 'g') AS t FROM conversations) SELECT conv_id, turn, md5(t) AS hash FROM s""")
def strip_fillers(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.md5(T.without_fillers(F.col("text"), ["the", "of", "to"])).alias("hash"))


@query(r"SELECT role AS speaker, CAST(sum(length(regexp_replace(text, '\[[^\]]*\]', '', 'g')) - length(replace(regexp_replace(text, '\[[^\]]*\]', '', 'g'), '?', ''))) AS BIGINT) AS questions FROM conversations GROUP BY 1")
def questions_asked(spark, sf_dir):
    return conversations(spark, sf_dir).groupBy("speaker").agg(F.sum(T.questions(F.col("text"))).alias("questions"))


HEDGES = ["the", "of the", "to be"]


@query("WITH t AS (SELECT doc_id, ' ' || array_to_string(" + TOKENS_SQL + ", '  ') || ' ' AS s FROM documents) SELECT doc_id, CAST(" + " + ".join(f"(length(s) - length(replace(s, ' {'  '.join(h.split())} ', ''))) // {len('  '.join(h.split())) + 2}" for h in HEDGES) + " AS BIGINT) AS hedges FROM t")
def hedges(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.phrase_hits(F.col("text"), HEDGES).alias("hedges"))


NORM_SQL = r"""array_to_string(list_filter(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[\[\]]', ' ', 'g'), '[ \t\n]+'), lambda x: x <> ''),
    lambda x: regexp_replace(regexp_replace(x, '[^a-z0-9'']', '', 'g'), '^''+|''+$', '', 'g') || CASE WHEN ends_with(regexp_replace(x, '[.,!?;:]+$', '', 'g'), '-') THEN '-' ELSE '' END), lambda x: x NOT IN ('', '-')), ' ')"""


@query(f"SELECT conv_id, turn, md5({NORM_SQL.replace('{t}', 'text')}) AS hash FROM conversations")
def normalise(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.md5(T.normalised(F.col("text"))).alias("hash"))


@query(f"""WITH n AS (SELECT conv_id, turn, {NORM_SQL.replace('{t}', 'text')} AS t FROM conversations), q AS (SELECT *, array_to_string(string_split(t, ' ')[2:4], ' ') AS q FROM n)
    SELECT a.conv_id, a.turn, a.q <> '' AND contains(' ' || a.t || ' ', ' ' || a.q || ' ') AS own, count(b.turn) AS others FROM q a LEFT JOIN q b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND a.q <> '' AND contains(' ' || b.t || ' ', ' ' || a.q || ' ') GROUP BY ALL""")
def quote_contains(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalised(F.col("text")).alias("t"))
    asked = rows.withColumn("q", F.array_join(F.slice(F.split("t", " "), 2, 3), " "))
    other = rows.select("conv_id", F.col("turn").alias("_turn"), F.col("t").alias("_t"))
    hits = asked.join(other, "conv_id", "left").groupBy("conv_id", "turn", "t", "q").agg(F.count_if((F.col("turn") != F.col("_turn")) & T.holds(F.col("_t"), F.col("q"))).alias("others"))
    return hits.select("conv_id", "turn", T.holds(F.col("t"), F.col("q")).alias("own"), "others")


@query("SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("tokens"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[,\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS a FROM conversations)
    SELECT conv_id, turn, len(list_distinct(a)) AS terms, md5(array_to_string(list_sort(list_distinct(a)), '|')) AS hash FROM t""")
def split_terms(spark, sf_dir):
    found = T.terms(F.col("text"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(found).cast("long").alias("terms"), F.md5(F.array_join(F.array_sort(found), "|")).alias("hash"))


@query("SELECT doc_id, regexp_matches(text, '(?i)(then|the)\\s+(of|ed)[ .]') AS banned FROM documents")
def banned_wording(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"(?i)(then|the)\s+(of|ed)[ .]").alias("banned"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN printf('%.1f', value) || '%' WHEN 'view' THEN printf('%02d:%02d', CAST(floor(floor(value) / 60) AS BIGINT), CAST(floor(value) AS BIGINT) % 60) ELSE printf('%.2f', value) END AS shown FROM events")
def fmt_feature(spark, sf_dir):
    shown = F.when(F.col("event_type") == "error", F.concat(T.fixed(F.col("value"), 1), F.lit("%"))).when(F.col("event_type") == "view", T.minutes(F.col("value"))).otherwise(T.fixed(F.col("value"), 2))
    return read(spark, sf_dir, "events").select("event_id", shown.alias("shown"))


@query("""SELECT conv_id AS call_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body, count(*) AS turns FROM conversations GROUP BY 1""")
def turn_text(spark, sf_dir):
    rows = conversations(spark, sf_dir).withColumn("line", F.concat("speaker", F.lit(": "), "text"))
    return rows.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx", "line"))), lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("turns"))


@query(r"""SELECT conv_id AS call_id, turn AS turn_idx, len(list_filter(regexp_split_to_array(text, '[ \t\n]+'), lambda x: x <> '')) AS words FROM conversations""")
def turn_word_count(spark, sf_dir):
    return conversations(spark, sf_dir).select("call_id", "turn_idx", F.size(F.filter(F.split("text", r"[ \t\n]+"), lambda w: w != "")).cast("long").alias("words"))


@query(r"""SELECT page_id, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) IN ('', '/') THEN rtrim(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), '/') || '/v1' ELSE rtrim(url, '/') END AS normal FROM pages""")
def normalise_url(spark, sf_dir):
    url = F.col("url")
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    return read(spark, sf_dir, "pages").select("page_id", F.when(path.isin("", "/"), F.concat(F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1), F.lit("/v1"))).otherwise(F.regexp_replace(url, "/+$", "")).alias("normal"))


@query("SELECT page_id, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) IN ('.html', '.com', '.net') AS is_media FROM pages")
def media_filter(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"(\.[^./]+)$", 1)).isin(".html", ".com", ".net").alias("is_media"))


@query("SELECT page_id, sha1(url || '|' || length(html)) AS call_id, sha256(html) AS digest FROM pages")
def call_id(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.call_id(F.col("url"), F.length("html")).alias("call_id"), F.sha2("html", 256).alias("digest"))


@query("""WITH w AS (SELECT conv_id, turn, role, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word, generate_subscripts(list_filter(string_split(text, ' '), lambda w: w <> ''), 1) - 1 AS k FROM conversations),
    p AS (SELECT *, 'w' || (k % 12) AS tok, k % 5 = 1 AND k < 12 AS stops FROM w)
    SELECT conv_id AS call_id, turn AS turn_idx, string_agg(tok || CASE WHEN stops THEN printf(' (...%.1fs)', 1 + k / 4.0) ELSE '' END, ' ' ORDER BY k) AS body FROM p GROUP BY ALL""")
def turn_body(spark, sf_dir):
    """Words w0 to w11 in turn, with pauses behind some of the first twelve and one behind a word that isn't there."""
    words = F.expr("filter(split(text, ' '), w -> w <> '')")
    turns = conversations(spark, sf_dir).where(F.size(words) > 0).select("call_id", "turn_idx", F.array_join(F.transform(words, lambda w, k: F.concat(F.lit("w"), (k % 12).cast("string"))), " ").alias("text"), F.size(words).alias("n"))
    stops = turns.select("call_id", "turn_idx", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(12)) - 1)).alias("k")).where("k % 5 = 1")
    held = stops.select("call_id", "turn_idx", F.col("k").cast("double").alias("at"), (1 + F.col("k") / 4).alias("seconds"), F.concat(F.lit("w"), F.col("k").cast("string")).alias("after_word"))
    absent = turns.select("call_id", "turn_idx", F.lit(0.5).alias("at"), F.lit(9.0).alias("seconds"), F.lit("w").alias("after_word"))
    return turn_bodies(turns, held.union(absent)).select("call_id", "turn_idx", "body")
