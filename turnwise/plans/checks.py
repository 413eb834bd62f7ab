"""Queries over replies made of the tables: an order is a call's claim, its lines cite turns of the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.functions.lexicons import BANNED, NOT_NAMES
from turnwise.functions.text import normalised
from turnwise.operators import checking as K
from turnwise.plans.people import KIND_SQL
from turnwise.plans.texts import NORM_SQL
from turnwise.registry import query
from turnwise.sources.tables import conversations, read, words

_list = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
OVERLAP_RE2, BANNED_RE2 = K.OVERLAP_WORDS, BANNED.replace("'", "''")
# a claim's lines cite turn l_linenumber - 1 of a call, two words of it, and a moment of that or another turn
CITED_SQL = r"""c AS (SELECT max(conv_id) + 1 AS m FROM conversations),
    cv AS (SELECT conv_id AS call_id, turn AS turn_idx, role AS speaker, text, array_to_string(list_filter(string_split(text, ' '), lambda w: w <> '')[2:3], ' ') AS two FROM conversations),
    ev AS (SELECT l_orderkey % m AS call_id, l_orderkey AS claim, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS item, l_linenumber - 1 AS turn_idx,
        CASE l_suppkey % 6 WHEN 0 THEN 'lexical' WHEN 1 THEN 'timing' WHEN 2 THEN 'prosody' WHEN 3 THEN 'disfluency' WHEN 4 THEN 'interaction' ELSE 'smell' END AS channel,
        CASE l_partkey % 3 WHEN 0 THEN 'both talked over it' WHEN 1 THEN 'Interrupting again' ELSE 'a plain answer' END AS description, l_partkey % 2 = 0 AS quoted, 'M' || (l_partkey % 4) AS moment FROM lineitem, c)"""


def _modulus(spark, sf_dir):
    return F.broadcast(read(spark, sf_dir, "conversations").agg((F.max("conv_id") + 1).alias("m")))


def _cited(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").crossJoin(_modulus(spark, sf_dir))
    channel = F.element_at(F.array(*map(F.lit, ("lexical", "timing", "prosody", "disfluency", "interaction", "smell"))), (F.col("l_suppkey") % 6 + 1).cast("int"))
    said = F.element_at(F.array(*map(F.lit, ("both talked over it", "Interrupting again", "a plain answer"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    return line.select(
        (F.col("l_orderkey") % F.col("m")).alias("call_id"), F.col("l_orderkey").alias("claim"), (F.col("l_linenumber") * F.lit(1000000000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("item"), (F.col("l_linenumber") - 1).cast("long").alias("turn_idx"),
        channel.alias("channel"), said.alias("description"), (F.col("l_partkey") % 2 == 0).alias("quoted"), F.concat(F.lit("M"), (F.col("l_partkey") % 4).cast("string")).alias("moment"),
    )


@query(rf"""WITH {CITED_SQL}, {KIND_SQL}, wl AS (SELECT call_id, turn_idx, list({{'n': {NORM_SQL.replace('{t}', 'word')}, 'k': CASE WHEN kind = 'content' AND lower(word) IN ('the', 'of', 'la', 'de') THEN 'filler' ELSE kind END}} ORDER BY word_idx) AS ws FROM kw GROUP BY ALL),
    wn AS (SELECT call_id, turn_idx, list_filter(ws, lambda w: w.n <> '') AS ws FROM wl),
    j AS (SELECT ev.*, cv.turn_idx % 5 = 0 AS still, cv.turn_idx % 4 * 1.5 AS late, cv.turn_idx % 3 = 0 AS over, CASE WHEN quoted THEN cv.two ELSE '' END AS quote, string_split(CASE WHEN quoted THEN {NORM_SQL.replace('{t}', 'cv.two')} ELSE '' END, ' ') AS tk,
        coalesce(wn.ws, []) AS ws, ev.moment = 'M' || (ev.turn_idx % 4) AS here FROM ev JOIN cv USING (call_id, turn_idx) LEFT JOIN wn USING (call_id, turn_idx)),
    h AS (SELECT *, CASE WHEN channel = 'disfluency' AND tk <> [''] THEN list_filter(range(1, len(ws) - len(tk) + 2), lambda i: list_transform(ws[i:i + len(tk) - 1], lambda w: w.n) = tk) ELSE [] END AS hits FROM j)
    SELECT call_id, claim, item, CASE WHEN channel = 'prosody' AND NOT (here AND turn_idx % 3 = 1) THEN 'prosody_unsupported'
        WHEN channel = 'disfluency' AND NOT ((here AND turn_idx % 3 = 0) OR (tk <> [''] AND len(hits) > 0 AND len(list_filter(ws[hits[1]:hits[1] + len(tk) - 1], lambda w: w.k IN ('filler', 'cutoff', 'repetition'))) >= 2)) THEN 'disfluency_unsupported'
        WHEN channel = 'timing' AND NOT ((late >= 2.0 AND late >= 3 * 0.9) OR still) THEN 'timing_unsupported' WHEN channel = 'lexical' AND NOT quoted THEN 'lexical_needs_quote'
        WHEN channel = 'interaction' AND regexp_matches(description, '{OVERLAP_RE2}') AND NOT over THEN 'interaction_unsupported' WHEN channel = 'smell' THEN 'unknown_channel' END AS problem FROM h""")
def vf_channel(spark, sf_dir):
    turns = conversations(spark, sf_dir)
    kind = F.when((F.col("kind") == "content") & F.lower("word").isin("the", "of", "la", "de"), "filler").otherwise(F.col("kind"))
    from turnwise.operators import words as W

    told = words(spark, sf_dir).withColumn("kind", W.word_class(F.col("word"))).groupBy("call_id", "turn_idx").agg(F.array_sort(F.collect_list(F.struct("word_idx", normalised(F.col("word")).alias("norm"), kind.alias("kind")))).alias("words"))
    two = F.array_join(F.slice(F.filter(F.split("text", " "), lambda w: w != ""), 2, 2), " ")
    timed = turns.withColumn("start_s", F.col("turn_idx") * 10.0).withColumn("end_s", F.col("turn_idx") * 10.0 + 8)
    overlaps = turns.where("turn_idx % 3 = 0").select("call_id", (F.col("turn_idx") * 10.0 + 2).alias("start_s"), (F.col("turn_idx") * 10.0 + 3).alias("end_s"))
    view = K.meets(timed, overlaps).join(told, ["call_id", "turn_idx"], "left").select(
        "call_id", "turn_idx", F.coalesce("words", F.array().cast("array<struct<word_idx:int,norm:string,kind:string>>")).alias("words"), (F.col("turn_idx") % 4 * 1.5).alias("reply_latency"), F.lit(0.9).alias("median_latency"),
        F.when(F.col("turn_idx") % 5 == 0, F.array(F.lit(0.4), F.lit(2.5))).otherwise(F.array(F.lit(1.0))).alias("pauses"), "overlapped",
    )
    features = F.when(F.col("turn_idx") % 3 == 0, F.array(F.lit("medial_fillers"))).when(F.col("turn_idx") % 3 == 1, F.array(F.lit("arousal"), F.lit(None).cast("string"))).otherwise(F.array(F.lit(None).cast("string")))
    moments = turns.select("call_id", F.concat(F.lit("M"), (F.col("turn_idx") % 4).cast("string")).alias("moment_id"), "turn_idx", features.alias("features"))
    cited = _cited(spark, sf_dir).join(turns.select("call_id", "turn_idx", two.alias("two")), ["call_id", "turn_idx"], "left")
    evidence = cited.select("call_id", "claim", "item", "turn_idx", "channel", F.when(F.col("quoted"), F.col("two")).otherwise("").alias("quote"), F.col("quoted").alias("matched"), "description", F.array("moment").alias("moments"))
    return K.channel_problems(evidence, view, moments).select("call_id", "claim", "item", "problem")


@query("""SELECT o_orderkey AS claim, CASE WHEN o_custkey % 7 = 0 THEN 'about_reader' WHEN c_custkey IS NULL THEN 'unknown_speaker' WHEN c_acctbal <= 0 THEN 'no_baseline' END AS problem
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON c_custkey = o_custkey""")
def vf_speaker(spark, sf_dir):
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    claims = orders.select((F.col("o_custkey") % 7).cast("string").alias("call_id"), F.col("o_orderkey").alias("claim"), F.col("o_custkey").cast("string").alias("speaker"))
    speakers = customer.where("c_custkey % 5 <> 0").select((F.col("c_custkey") % 7).cast("string").alias("call_id"), F.col("c_custkey").cast("string").alias("speaker"), F.ceil("c_acctbal").alias("baseline_turns"))
    # the calls of the remainder 0 are each the reader's own
    claims = claims.withColumn("call_id", F.concat("call_id", F.lit("/"), "speaker"))
    speakers = speakers.withColumn("call_id", F.concat("call_id", F.lit("/"), "speaker"))
    readers = claims.where("call_id like '0/%'").select("call_id", F.col("speaker").alias("me")).distinct()
    return K.speaker_problems(claims, speakers, readers).select("claim", "problem")


@query(f"""WITH c AS (SELECT max(conv_id) + 1 AS m FROM conversations), t AS (SELECT DISTINCT conv_id AS call_id, turn AS turn_idx FROM conversations),
    l AS (SELECT l_orderkey % m AS call_id, l_orderkey AS line, list(CAST(l_suppkey % 9 AS BIGINT) ORDER BY l_linenumber, l_suppkey % 9) FILTER (l_orderkey % 5 <> 0) AS ids, CASE WHEN l_orderkey % 3 = 0 THEN 'he was Lying' ELSE 'a clean line' END AS text FROM lineitem, c GROUP BY ALL),
    x AS (SELECT l.*, list_filter(coalesce(ids, []), lambda i: list_contains(coalesce(k.known, []), i)) AS clean FROM l LEFT JOIN (SELECT call_id, list(turn_idx) AS known FROM t GROUP BY 1) k USING (call_id))
    SELECT line, array_to_string(clean, ',') AS turn_ids, CASE WHEN regexp_matches(text, '{BANNED_RE2}') THEN 'wording_note_line' WHEN len(coalesce(ids, [])) > 0 AND len(clean) = 0 THEN 'unverified_note_line' END AS problem FROM x""")
def vf_notes(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").crossJoin(_modulus(spark, sf_dir))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 9).cast("long").alias("i")))), lambda x: x["i"])
    rows = line.groupBy((F.col("l_orderkey") % F.col("m")).alias("call_id"), F.col("l_orderkey").alias("line")).agg(ids.alias("turn_ids"))
    rows = rows.withColumn("turn_ids", F.when(F.col("line") % 5 != 0, F.col("turn_ids"))).withColumn("text", F.when(F.col("line") % 3 == 0, "he was Lying").otherwise("a clean line"))
    return K.note_lines(rows, conversations(spark, sf_dir)).select("line", F.array_join("turn_ids", ",").alias("turn_ids"), "problem")


@query("""WITH c AS (SELECT max(conv_id) + 1 AS m FROM conversations), t AS (SELECT DISTINCT conv_id AS call_id, turn AS turn_idx FROM conversations),
    s AS (SELECT l_orderkey % m AS call_id, l_orderkey AS topic, l_linenumber AS place, CAST(l_suppkey % 4 AS BIGINT) AS a, CAST(l_suppkey % 4 + l_partkey % 5 AS BIGINT) AS b FROM lineitem, c)
    SELECT topic, string_agg(s.a || '-' || s.b, ',' ORDER BY place, s.a, s.b) AS spans FROM s JOIN t x ON x.call_id = s.call_id AND x.turn_idx = s.a JOIN t y ON y.call_id = s.call_id AND y.turn_idx = s.b GROUP BY s.call_id, topic""")
def vf_topics(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem").crossJoin(_modulus(spark, sf_dir))
    span = F.array((F.col("l_suppkey") % 4).cast("long"), (F.col("l_suppkey") % 4 + F.col("l_partkey") % 5).cast("long"))
    spans = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", span.alias("s")))), lambda x: x["s"])
    topics = line.groupBy((F.col("l_orderkey") % F.col("m")).alias("call_id"), F.col("l_orderkey").alias("topic")).agg(spans.alias("spans"))
    return K.topic_spans(topics, conversations(spark, sf_dir)).select("topic", F.array_join(F.transform("spans", lambda s: F.array_join(s.cast("array<string>"), "-")), ",").alias("spans"))


@query("""WITH o AS (SELECT o_custkey AS call_id, count(*) AS proposed, count(*) FILTER (o_orderstatus = 'O') AS kept, count(*) FILTER (o_orderstatus <> 'O') AS dropped FROM orders GROUP BY 1),
    e AS (SELECT o_custkey AS call_id, count(*) AS evidence_proposed, count(*) FILTER (l_returnflag <> 'N') AS evidence_quote_rejected FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    r AS (SELECT c_custkey AS call_id, count(*) AS model_rejected FROM customer WHERE c_acctbal > 0 GROUP BY 1)
    SELECT call_id, proposed, kept, dropped, coalesce(evidence_proposed, 0) AS evidence_proposed, coalesce(evidence_quote_rejected, 0) AS evidence_quote_rejected, coalesce(model_rejected, 0) AS model_rejected FROM o LEFT JOIN e USING (call_id) LEFT JOIN r USING (call_id)""")
def vf_reply_accounts(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    claims = orders.select(F.col("o_custkey").alias("call_id"), F.col("o_orderkey").alias("claim"), F.when(F.col("o_orderstatus") != "O", "convergence").alias("reason"))
    problem = F.when(F.col("l_returnflag") == "A", "quote_mismatch").when(F.col("l_returnflag") == "R", "quote_too_long").otherwise("wrong_speaker")
    evidence = read(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("call_id"), problem.alias("problem"))
    rejected = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("claim"))
    return K.reply_accounts(claims, evidence, rejected)


@query("""WITH ob AS (SELECT DISTINCT l_orderkey, 'O' || (l_partkey % 6) AS i FROM lineitem WHERE l_returnflag <> 'A'),
    su AS (SELECT l_orderkey, 'O' || (l_suppkey % 6) AS i FROM lineitem), f AS (SELECT l_orderkey, list_sort(list(DISTINCT i)) AS obs FROM su JOIN ob USING (l_orderkey, i) GROUP BY 1)
    SELECT o_orderkey AS cluster, o_orderpriority AS verdict, coalesce(array_to_string(obs, ','), '') AS observations FROM orders JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON k = o_orderkey LEFT JOIN f ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW'""")
def kept_clusters(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    id_ = lambda c: F.concat(F.lit("O"), (F.col(c) % 6).cast("string"))
    reviews = read(spark, sf_dir, "orders").select(F.lit("c").alias("call_id"), F.col("o_orderkey").alias("cluster"), F.when(F.col("o_orderpriority") == "5-LOW", "drop").otherwise(F.col("o_orderpriority")).alias("verdict"))
    clusters = line.groupBy(F.col("l_orderkey").alias("cluster")).agg(F.collect_list(id_("l_suppkey")).alias("supports")).withColumn("call_id", F.lit("c"))
    # ids of observations are those of their cluster, as an order has its own
    own = clusters.withColumn("supports", F.expr("transform(supports, s -> concat(cluster, '/', s))"))
    observations = line.where("l_returnflag <> 'A'").select(F.lit("c").alias("call_id"), F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), id_("l_partkey")).alias("observation"))
    found = K.kept_clusters(reviews, own, observations)
    return found.select("cluster", "verdict", F.array_join(F.transform("observations", lambda o: F.substring_index(o, "/", -1)), ",").alias("observations"))


@query(rf"""WITH {KIND_SQL}, k AS (SELECT *, kind IN ('filler', 'cutoff', 'repetition', 'vocalisation', 'event') OR lower(word) IN ('the', 'la') AS gone FROM kw)
    SELECT call_id, turn_idx, coalesce(trim(regexp_replace(string_agg(trim(word, ' '), ' ' ORDER BY word_idx) FILTER (NOT gone), '[ \t\n]+', ' ', 'g'), ' '), '') AS text, count(*) FILTER (NOT gone) AS word_count FROM k GROUP BY ALL""")
def variant_clean(spark, sf_dir):
    from turnwise.operators import words as W

    kind = F.when(F.lower("word").isin("the", "la"), "filler").otherwise(W.word_class(F.col("word")))
    return K.clean_text(words(spark, sf_dir).withColumn("kind", kind), ["call_id", "turn_idx"])


@query(f"""WITH c AS (SELECT max(conv_id) + 1 AS m FROM conversations), i AS (SELECT o_orderkey % m AS call_id, o_orderkey AS item, CASE WHEN o_custkey % 4 = 0 THEN 'you hid a lie' ELSE 'ask more' END AS text, CAST(o_custkey % 6 AS BIGINT) AS turn_idx FROM orders, c)
    SELECT item, i.text, CASE WHEN t.turn IS NOT NULL THEN i.turn_idx END AS turn_idx FROM i LEFT JOIN conversations t ON t.conv_id = i.call_id AND t.turn = i.turn_idx AND t.role = 'user' WHERE NOT regexp_matches(i.text, '{BANNED_RE2}')""")
def coaching_reply(spark, sf_dir):
    order = read(spark, sf_dir, "orders").crossJoin(_modulus(spark, sf_dir))
    items = order.select((F.col("o_orderkey") % F.col("m")).alias("call_id"), F.col("o_orderkey").alias("item"), F.when(F.col("o_custkey") % 4 == 0, "you hid a lie").otherwise("ask more").alias("text"), F.lit(None).cast("string").alias("advice"), (F.col("o_custkey") % 6).cast("long").alias("turn_idx"))
    return K.own_turns(items, conversations(spark, sf_dir), "user").select("item", "text", "turn_idx")


@query("""WITH n AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 4 WHEN 0 THEN 'call ' || strftime(o_orderdate, '%Y-%m-%d') || ' b' WHEN 1 THEN 'call 2024-13-45' WHEN 2 THEN 'x2024-01-02' ELSE 'plain' END AS name FROM orders)
    SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + 1 ELSE DATE '2026-01-01' END, '%Y-%m-%d') AS day FROM n""")
def call_date(spark, sf_dir):
    day = F.to_date("o_orderdate")
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, F.concat(F.lit("call "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" b"))).when(k == 1, "call 2024-13-45").when(k == 2, "x2024-01-02").otherwise("plain")
    modified = F.when(F.col("o_orderkey") % 3 == 0, F.date_add(day, 1))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(K.call_date(name, modified, F.lit("2026-01-01").cast("date")), "yyyy-MM-dd").alias("day"))


@query("""WITH r AS (SELECT o_custkey AS call_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O') SELECT * FROM r WHERE place <= 8""")
def topk_candidates(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("call_id"), "o_orderkey", "o_orderdate")
    return K.candidate_turns(rows, ["o_orderdate", "o_orderkey"]).select("call_id", "o_orderkey", F.col("place").cast("long").alias("place"))


ME_SQL = f"""WITH s AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, c_custkey FROM customer),
    p AS (SELECT c_custkey AS call_id, 'A' AS a, 'B' AS b, CASE c_custkey % 5 WHEN 0 THEN 'Brian?' WHEN 1 THEN '' WHEN 2 THEN 'Kaden' ELSE 'Mia' END AS an, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Kaden?' WHEN 2 THEN 'Brian' ELSE ' ' END AS bn,
        CASE c_custkey % 3 WHEN 0 THEN '2024-01-02 Brian.mkv' WHEN 1 THEN 'call with Mia and Zed' ELSE 'zoom Monday ok' END AS title FROM customer WHERE c_custkey % 11 <> 0),
    q AS (SELECT call_id, a, b, rtrim(trim(an), '?') AS an, rtrim(trim(bn), '?') AS bn, list_filter(list_transform(regexp_extract_all(title, '[A-Za-z]+'), lambda t: lower(t)), lambda t: length(t) >= 2 AND t NOT IN ({_list(NOT_NAMES)})) AS tk,
        list_sort(list_distinct(list_filter(regexp_extract_all(title, '\\b[A-Z][a-z]{{2,}}\\b'), lambda t: lower(t) NOT IN ({_list(NOT_NAMES)})))) AS nm FROM p),
    f AS (SELECT *, list_contains(tk, lower(an)) AS ia, list_contains(tk, lower(bn)) AS ib, list_contains(list_transform(nm, lambda t: lower(t)), lower(an)) AS na, list_contains(list_transform(nm, lambda t: lower(t)), lower(bn)) AS nb FROM q),
    g AS (SELECT *, CASE WHEN ia AND NOT ib THEN 'B' WHEN ib AND NOT ia THEN 'A' WHEN an <> '' AND bn = '' AND len(nm) > 0 AND NOT na THEN 'A' WHEN bn <> '' AND an = '' AND len(nm) > 0 AND NOT nb THEN 'B' END AS label FROM f)
    SELECT call_id, label, CASE label WHEN 'A' THEN 'B' ELSE 'A' END AS counterpart, CASE WHEN ia AND NOT ib THEN an WHEN ib AND NOT ia THEN bn ELSE nm[1] END AS counterpart_name FROM g WHERE label IS NOT NULL"""


@query(ME_SQL)
def guess_me(spark, sf_dir):
    calls = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("call_id"))
    at = lambda k, *values: F.element_at(F.array(*map(F.lit, values)), (F.col("call_id") % k + 1).cast("int"))
    speakers = calls.select("call_id", F.lit("A").alias("speaker"), F.lit(5).alias("baseline_turns"), at(5, "Brian?", "", "Kaden", "Mia", "Mia").alias("name"))
    speakers = speakers.union(calls.select("call_id", F.lit("B"), F.when(F.col("call_id") % 11 != 0, 12).otherwise(0), at(4, "", "Kaden?", "Brian", " "))).union(calls.select("call_id", F.lit("C"), F.lit(0), F.lit("Zed")))
    return K.guess_me(speakers, calls.select("call_id", at(3, "2024-01-02 Brian.mkv", "call with Mia and Zed", "zoom Monday ok").alias("title")))


@query("""WITH f AS (SELECT event_id, value AS s, value + user_id % 7 * 0.25 AS e, (user_id % 3) * 0.5 AS o FROM events)
    SELECT event_id, greatest(CAST(trunc((s - o) / 0.25) AS BIGINT), 0) AS low, least(CAST(trunc((e - o) / 0.25) AS BIGINT) + 1, 400) AS high, greatest(CAST(ceil((s - o) / 0.25) AS BIGINT), 0) AS inner_low,
        greatest(least(CAST(trunc((e - o) / 0.25 - 0.04 / 0.25) AS BIGINT) + 1, 400), greatest(CAST(ceil((s - o) / 0.25) AS BIGINT), 0)) AS inner_high FROM f""")
def frame_range(spark, sf_dir):
    low, high, inner_low, inner_high = K.frame_ranges(F.col("value"), F.col("value") + F.col("user_id") % 7 * 0.25, F.col("user_id") % 3 * 0.5, F.lit(0.25), F.lit(400).cast("long"))
    return read(spark, sf_dir, "events").select("event_id", low.alias("low"), high.alias("high"), inner_low.alias("inner_low"), inner_high.alias("inner_high"))


@query("SELECT l_orderkey AS claim, array_to_string(list_sort(list(DISTINCT l_partkey % 9)), ',') AS turns FROM lineitem GROUP BY 1")
def reading_key(spark, sf_dir):
    evidence = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), (F.col("l_partkey") % 9).alias("turn_idx"))
    return K.reading_key(evidence, ["claim"]).select("claim", F.array_join(F.col("turns").cast("array<string>"), ",").alias("turns"))


#: the fifth score of B by o_custkey % 5: a number in each JSON form, a number in quotes, a list, null
TONES = ("2", "-0.5e1", '"4"', "[3]", "null")


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS swapped, CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'tie' ELSE 'A' END AS p, o_custkey % 5 >= 2 AS short, o_orderkey % 13 = 0 AS broken, o_orderkey % 17 = 0 AS half FROM orders)
    SELECT o_orderkey, CASE WHEN broken THEN 'not JSON' WHEN half THEN 'missing score A.faithfulness' WHEN short THEN 'missing score B.tone' WHEN p IS NULL OR p = 'C' THEN 'prefer must be A, B or tie' END AS problem,
        CASE WHEN NOT broken AND NOT half AND NOT short AND p IN ('A', 'B', 'tie') THEN CASE WHEN swapped THEN CASE p WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE p END ELSE p END END AS prefer FROM r""")
def judge_replies(spark, sf_dir):
    scores = '{"faithfulness": 4, "usefulness": 3.5, "non_obviousness": 1, "over_reach": 0, "tone": '
    tone = F.element_at(F.array(*map(F.lit, TONES)), (F.col("o_custkey") % 5 + 1).cast("int"))
    prefer = F.element_at(F.array(*map(F.lit, ("", ', "prefer": "B"', ', "prefer": "C"', ', "prefer": "tie"', ', "prefer": "A"', ', "prefer": "A"'))), (F.col("o_custkey") % 6 + 1).cast("int"))
    both = F.concat(F.lit('{"A": ' + scores + '5}, "B": ' + scores), tone, F.lit("}"), prefer, F.lit("}"))
    reply = F.when(F.col("o_orderkey") % 13 == 0, "no reply {").when(F.col("o_orderkey") % 17 == 0, '{"A": 3, "prefer": "A"}').otherwise(F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), both, F.lit("\n```"))).otherwise(both))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", reply.alias("reply"), (F.col("o_orderkey") % 2 == 0).alias("swapped"))
    return K.judge_replies(rows).select("o_orderkey", "problem", "prefer")


@query("""WITH e AS (SELECT l_orderkey, list({'c': CASE l_suppkey % 4 WHEN 0 THEN 'lexical' WHEN 1 THEN 'timing' WHEN 2 THEN 'prosody' ELSE 'smell' END, 't': CASE WHEN l_partkey % 5 = 0 THEN 'T1' ELSE 'T' || (100 + l_linenumber) END} ORDER BY l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN 'T1' ELSE 'T' || (100 + l_linenumber) END, CASE l_suppkey % 4 WHEN 0 THEN 'lexical' WHEN 1 THEN 'timing' WHEN 2 THEN 'prosody' ELSE 'smell' END) AS es FROM lineitem GROUP BY 1),
    c AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'likely' END AS lk, CASE WHEN o_custkey % 4 = 0 THEN 'odd' ELSE 'unsaid' END AS ly, es FROM orders JOIN e ON l_orderkey = o_orderkey)
    SELECT o_orderkey, concat_ws('; ', CASE WHEN ly = 'odd' THEN 'layer: odd' END, CASE WHEN lk IS NULL THEN 'likelihood: missing' END,
        nullif(array_to_string(flatten(list_transform(es, lambda x, i: list_filter([CASE WHEN x.c = 'smell' THEN 'evidence ' || (i - 1) || '.channel' END, CASE WHEN x.t = 'T1' THEN 'evidence ' || (i - 1) || '.turn_id' END], lambda y: y IS NOT NULL))), '; '), '')) AS problems FROM c""")
def schema_problems(spark, sf_dir):
    channel = F.element_at(F.array(*map(F.lit, ("lexical", "timing", "prosody", "smell"))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    turn = F.when(F.col("l_partkey") % 5 == 0, "T1").otherwise(F.concat(F.lit("T"), (100 + F.col("l_linenumber")).cast("string")))
    evidence = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", turn.alias("turn_id"), channel.alias("channel")))), lambda x: F.struct(x["turn_id"].alias("turn_id"), x["channel"].alias("channel")))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(evidence.alias("evidence"))
    claims = read(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "o_orderkey", F.when(F.col("o_custkey") % 4 == 0, "odd").otherwise("unsaid").alias("layer"), F.lit("s").alias("speaker"), F.lit("c").alias("claim"),
        F.when(F.col("o_custkey") % 3 != 0, "likely").alias("likelihood"), F.lit("low").alias("evidence_confidence"), "evidence",
    )
    return K.shape_problems(claims).select("o_orderkey", F.array_join("problems", "; ").alias("problems"))
