"""Ordered sequences: sessions, running maxima, text windows, intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.functions import scoring, text
from citelake.operators import sequence
from citelake.plans.tables import table
from citelake.registry import register

_ENDED = """e AS (SELECT *, ts + INTERVAL 1 SECOND * CAST(floor(value) AS BIGINT) AS ended FROM events)"""


def _ended(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.withColumn("ended", F.col("ts") + F.make_dt_interval(secs=F.floor("value").cast("decimal(18,6)")))


@register(
    f"""
    WITH {_ENDED},
    m AS (SELECT *, max(ended) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
    s AS (SELECT *, 1 + CAST(sum(CASE WHEN ts > before + INTERVAL 60 MINUTE THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM m)
    SELECT user_id, session, count(*) AS checks, min(ts) AS begin, max(ended) AS "end",
           CAST(floor(epoch(max(ended)) - epoch(min(ts))) AS BIGINT) AS seconds FROM s GROUP BY 1, 2"""
)
def sessions_by_gap(spark, sf_dir):
    rows = sequence.sessions(_ended(spark, sf_dir), "user_id", F.col("ts"), F.col("ended"), "event_id", 60)
    return sequence.session_summary(rows, "user_id", F.col("ts"), F.col("ended"))


@register(
    """
    WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, max(l_partkey) OVER (PARTITION BY l_orderkey
                 ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS largest_before FROM lineitem)
    SELECT * FROM m WHERE l_partkey < largest_before"""
)
def running_max_out_of_order(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return sequence.out_of_order(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey")


@register(
    """
    WITH p AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
    SELECT user_id, count(*) AS n, round(avg(CASE WHEN p <= value THEN 1.0 ELSE 0.0 END) FILTER (WHERE p IS NOT NULL), 6) AS up,
           round(avg(CASE WHEN p >= value THEN 1.0 ELSE 0.0 END) FILTER (WHERE p IS NOT NULL), 6) AS down
    FROM p GROUP BY 1 HAVING count(*) >= 4"""
)
def adjacent_ratio(spark, sf_dir):
    out = sequence.adjacent_order(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return out.withColumns({"up": F.round("up", 6), "down": F.round("down", 6)})


_WINDOWS = r"""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
    n AS (SELECT doc_id, w, len(w) AS n, greatest(1, CAST(ceil((len(w) - 350) / 175) AS BIGINT) + 1) AS f FROM w),
    t AS (SELECT *, n - (f - 1) * 175 AS tail FROM n),
    k AS (SELECT *, CASE WHEN n <= 350 THEN CASE WHEN n >= 300 THEN 1 ELSE 0 END
                         WHEN tail >= 300 THEN f ELSE f - 1 END AS kept FROM t),
    x AS (SELECT doc_id, w, n, f, tail, kept, unnest(range(0, kept)) AS i FROM k),
    y AS (SELECT doc_id, CAST(i AS INT) AS i, CASE WHEN n <= 350 THEN w
            WHEN i = kept - 1 AND kept < f AND 350 + tail <= 525
              THEN list_concat(w[i * 175 + 1 : i * 175 + 350], w[(i + 1) * 175 + 1 : (i + 1) * 175 + 350])
            ELSE w[i * 175 + 1 : i * 175 + 350] END AS win FROM x)"""


@register(
    _WINDOWS
    + """
    SELECT doc_id, i, CAST(len(win) AS INT) AS n_words,
           round(len(list_distinct(win)) / len(win), 6) AS distinct_share FROM y"""
)
def doc_windows_score(spark, sf_dir):
    out = _windows(spark, sf_dir)
    return out.select("doc_id", "i", F.size("win").alias("n_words"), F.round(F.size(F.array_distinct("win")) / F.size("win"), 6).alias("distinct_share"))


def _windows(spark, sf_dir):
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    return docs.select("doc_id", F.posexplode(sequence.text_windows(F.col("w"))).alias("i", "win"))


_SCORED = _WINDOWS + """,
    s AS (SELECT doc_id, i, 1 - (len(list_distinct(win)) / len(win) - 0.2) AS p FROM y)"""


def _scored(spark, sf_dir):
    distinct = F.size(F.array_distinct("win")) / F.size("win")
    return _windows(spark, sf_dir).select("doc_id", "i", (1 - (distinct - F.lit(0.2).cast("double"))).alias("p"))


@register(
    _SCORED
    + """
    SELECT doc_id, count(*) AS windows, round(avg(p), 3) AS score,
           CASE WHEN avg(p) >= 0.5 AND count(*) >= 2 THEN 'high' WHEN avg(p) >= 0.3 THEN 'medium' ELSE 'low' END AS band
    FROM s GROUP BY 1"""
)
def detector_bands(spark, sf_dir):
    rows = _scored(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("windows"), F.avg("p").alias("p"))
    band = scoring.band(F.col("p"), 0.5)
    band = F.when((band == "high") & (F.col("windows") < 2), "medium").otherwise(band)
    return rows.select("doc_id", "windows", F.round("p", 3).alias("score"), band.alias("band"))


@register(
    _SCORED
    + """,
    nb AS (SELECT *, lag(i) OVER w AS li, lag(p) OVER w AS lp, lead(i) OVER w AS ni, lead(p) OVER w AS np
          FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id, i, round(p, 6) AS p FROM nb
    WHERE p >= 0.5 AND ((li = i - 1 AND lp >= 0.5) OR (ni = i + 1 AND np >= 0.5))"""
)
def corroborated_windows(spark, sf_dir):
    out = sequence.corroborated(_scored(spark, sf_dir), "doc_id", "i", "p", 0.5)
    return out.select("doc_id", "i", F.round("p", 6).alias("p"))


_SPANS = """i AS (SELECT l_suppkey, l_shipdate AS s, l_shipdate + INTERVAL 1 DAY * CAST(l_quantity AS BIGINT) AS e FROM lineitem)"""


def _spans(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_suppkey", F.col("l_shipdate").alias("s"), (F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("e"))


@register(
    f"""
    WITH {_SPANS},
    m AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i),
    k AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e) AS g FROM m)
    SELECT l_suppkey, min(s) AS s, max(e) AS e, count(*) AS n FROM k GROUP BY l_suppkey, g"""
)
def merged_intervals(spark, sf_dir):
    return sequence.merge_intervals(_spans(spark, sf_dir), "l_suppkey", "s", "e")


_NAMED_SPANS = """i AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS id, min(l_shipdate) AS s, max(l_shipdate + INTERVAL 1 DAY * CAST(l_quantity AS INT)) AS e FROM lineitem GROUP BY 1, 2)"""


def _named_spans(spark, sf_dir):
    days = F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", number).agg(F.min("l_shipdate").alias("s"), F.max(days).alias("e"))


@register(
    f"""
    WITH {_NAMED_SPANS},
    m AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM i),
    k AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e) AS g FROM m)
    SELECT l_suppkey, min(s) AS s, max(e) AS e, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM k GROUP BY l_suppkey, g"""
)
def merged_interval_members(spark, sf_dir):
    merged = sequence.merge_intervals(_named_spans(spark, sf_dir), "l_suppkey", "s", "e", "id")
    return merged.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@register(
    f"""
    WITH {_NAMED_SPANS},
    q AS (SELECT l_suppkey, s AS pt FROM i UNION SELECT l_suppkey, e FROM i),
    r AS (SELECT l_suppkey, pt AS s, lead(pt) OVER (PARTITION BY l_suppkey ORDER BY pt) AS e FROM q)
    SELECT r.l_suppkey, r.s, r.e, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids
    FROM r JOIN i ON i.l_suppkey = r.l_suppkey AND i.s <= r.s AND i.e >= r.e GROUP BY 1, 2, 3"""
)
def covered_segments(spark, sf_dir):
    found = sequence.covered_segments(_named_spans(spark, sf_dir), "l_suppkey", "s", "e", "id")
    return found.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@register(
    f"""
    WITH {_SPANS},
    p AS (SELECT l_suppkey, s AS pt, 1 AS d FROM i UNION ALL SELECT l_suppkey, e, -1 FROM i),
    q AS (SELECT l_suppkey, pt, sum(d) AS d FROM p GROUP BY 1, 2),
    r AS (SELECT l_suppkey, pt AS s, lead(pt) OVER w AS e, CAST(sum(d) OVER w AS BIGINT) AS covering FROM q WINDOW w AS (PARTITION BY l_suppkey ORDER BY pt))
    SELECT * FROM r WHERE e IS NOT NULL AND covering > 0"""
)
def interval_segments(spark, sf_dir):
    return sequence.interval_segments(_spans(spark, sf_dir), "l_suppkey", "s", "e")


@register(
    r"""
    WITH s AS (SELECT doc_id, list_transform(string_split_regex(replace(replace(replace(text, '. ', '.' || chr(1)), '! ', '!' || chr(1)), '? ', '?' || chr(1)),
                 chr(1) || '|[.]\n'), lambda x: trim(x)) AS s FROM documents WHERE lang = 'en')
    SELECT doc_id, CAST(least(40, len(list_distinct(list_filter(s, lambda x: length(x) >= 40 AND length(x) <= 320)))) AS INT) AS n FROM s"""
)
def sentence_counts(spark, sf_dir):
    # line ends after a full stop also end a sentence, as in the SQL
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    lines = F.regexp_replace("text", r"[.]\n", "\u0001")
    parts = F.split(F.regexp_replace(lines, r"(?<=[.!?]) ", "\u0001"), "\u0001")
    fit = F.filter(F.transform(parts, lambda s: F.btrim(s)), lambda s: F.length(s).between(40, 320))
    return docs.select("doc_id", F.least(F.lit(40), F.size(F.array_distinct(fit))).alias("n"))


@register(
    """SELECT conv_id, CAST(count(*) AS BIGINT) AS n, bool_and(role <> p) AS alternates FROM (
         SELECT conv_id, turn, role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS p FROM conversations) GROUP BY 1"""
)
def turn_order_audit(spark, sf_dir):
    from pyspark.sql import Window

    before = F.coalesce(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("role") != before).alias("ok"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.bool_and("ok").alias("alternates"))


@register(
    r"""SELECT doc_id, CAST(ceil(greatest(length(text) - 200, 1) / 7800) AS INT) AS chunks FROM documents"""
)
def chunk_counts(spark, sf_dir):
    chunks = sequence.chunk_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(chunks).alias("chunks"))
