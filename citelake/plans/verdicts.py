"""Verdicts on references: ``orders`` play references, ``part`` and ``pages`` what they cite."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.functions import titles, verdicts
from citelake.operators import results, wordbreaks
from citelake.plans.tables import spread, table
from citelake.registry import register


def _case(key, *values):
    """The value at the key's remainder; the SQL says the same with a list."""
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def _list(key: str, *values: str) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[({key}) % {len(values)} + 1]"


@register(
    """
    WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE year(o_orderdate) END AS cited,
                      CASE WHEN o_orderkey % 7 <> 0 THEN year(o_orderdate) + o_orderkey % 5 - 2 END AS found,
                      CASE o_orderkey % 3 WHEN 0 THEN '10.1016/j.x.' || year(o_orderdate) || '.07' WHEN 1 THEN '10.1/9' || year(o_orderdate) END AS doi FROM orders)
    SELECT o_orderkey, CASE WHEN found IS NULL THEN NULL WHEN cited = 0 THEN 'missing'
           WHEN abs(cited - found) > 1 AND NOT coalesce(list_contains(regexp_split_to_array(doi, '[^0-9]+'), CAST(cited AS VARCHAR)), false) THEN 'mismatch' END AS verdict
    FROM r"""
)
def year_verdicts(spark, sf_dir):
    key, year = F.col("o_orderkey"), F.year("o_orderdate")
    cited = F.when(key % 11 == 0, 0).otherwise(year)
    found = F.when(key % 7 != 0, year + (key % 5).cast("int") - 2)
    doi = F.when(key % 3 == 0, F.concat(F.lit("10.1016/j.x."), year.cast("string"), F.lit(".07"))).when(
        key % 3 == 1, F.concat(F.lit("10.1/9"), year.cast("string"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", verdicts.year_verdict(cited, found, doi).alias("verdict"))


_KINDS = ("Unverified", "arxiv_id", "year", "", "multiple", "doi", "other")
_DETAILS = ("Could not verify", "Incorrect ArXiv ID for this author", "Year mismatch", "Title differs", "", "URL is non-existent", "Venue and author")


@register(
    f"""
    WITH r AS (SELECT o_orderkey, lower({_list("o_orderkey", *_KINDS)}) AS k, lower({_list("o_orderkey // 7", *_DETAILS)}) AS d, o_orderkey % 4 <> 0 AS found FROM orders),
    c AS (SELECT o_orderkey, k, list_filter([
        CASE WHEN k IN ('unverified', 'multiple', 'url') OR regexp_matches(d, 'unverified|could not be verified|could not verify') THEN 'unverified' END,
        CASE WHEN regexp_matches(d, 'non-existent|does not reference') THEN 'url_verification_failed' END,
        CASE WHEN k IN ('arxiv_id', 'arxiv', 'doi') OR regexp_matches(d, 'arxiv id|doi mismatch|incorrect arxiv id') THEN 'identifier_conflict' END,
        CASE WHEN contains(d, 'author') THEN 'author_mismatch' END, CASE WHEN contains(d, 'title') THEN 'title_mismatch' END,
        CASE WHEN contains(d, 'venue') THEN 'venue_mismatch' END, CASE WHEN contains(d, 'year') THEN 'year_mismatch' END,
        CASE WHEN NOT found THEN 'web_search_not_found' END], lambda x: x IS NOT NULL) AS codes FROM r)
    SELECT o_orderkey, array_to_string(CASE WHEN len(codes) > 0 THEN codes ELSE [coalesce(nullif(k, ''), 'hallucination_candidate')] END, ',') AS reasons,
           CASE o_orderkey % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'none' END AS level FROM c"""
)
def reason_code_lists(spark, sf_dir):
    key = F.col("o_orderkey")
    codes = verdicts.reason_codes(_case(key, *_KINDS), _case(F.floor(key / 7), *_DETAILS), key % 4 != 0)
    level = F.when(key % 5 == 0, "LOW")
    verdict = F.when(key % 5 == 1, "likely").when(key % 5 == 2, "UNCERTAIN").when(key % 5 == 3, "UNLIKELY")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(codes, ",").alias("reasons"), verdicts.flag_level(level, verdict).alias("level")
    )


@register(
    """
    WITH r AS (SELECT o_orderkey AS k, ['arXiv', 'DOI', '', 'url'][o_orderkey % 4 + 1] AS t,
                      ['arXiv:2101.0' || o_orderkey, ' https://doi.org/10.1/' || o_orderkey, '', ' '][o_orderkey % 4 + 1] AS v,
                      ['file', 'url', 'text'][o_orderkey % 3 + 1] AS st,
                      ['/data/uploads/' || o_orderkey, 'http://x.org/' || o_orderkey, '2001.' || o_orderkey, 'none'][o_orderkey // 4 % 4 + 1] AS s FROM orders)
    SELECT k AS o_orderkey, CASE WHEN lower(t) = 'arxiv' THEN 'https://arxiv.org/abs/' || replace(v, 'arXiv:', '')
           WHEN lower(t) = 'doi' THEN 'https://doi.org/' || replace(trim(v), 'https://doi.org/', '')
           WHEN starts_with(s, 'http://') THEN s WHEN st = 'url' AND regexp_matches(s, '^[0-9]') THEN 'https://arxiv.org/abs/' || s END AS link FROM r"""
)
def paper_links(spark, sf_dir):
    key = F.col("o_orderkey")

    def with_key(start):
        return F.concat(F.lit(start), key.cast("string"))

    ident = F.get(F.array(with_key("arXiv:2101.0"), with_key(" https://doi.org/10.1/"), F.lit(""), F.lit(" ")), (key % 4).cast("int"))
    places = F.array(with_key("/data/uploads/"), with_key("http://x.org/"), with_key("2001."), F.lit("none"))
    source = F.get(places, (F.floor(key / 4) % 4).cast("int"))
    link = verdicts.paper_link(_case(key, "file", "url", "text"), source, _case(key, "arXiv", "DOI", "", "url"), ident)
    return table(spark, sf_dir, "orders").select("o_orderkey", link.alias("link"))


_HOSTS = ("https://www.dl.acm.org/doi/1", "http://arxiv.org/abs/1", "https://notarxiv.org/abs", "https://x.nature.com/a?b", "ftp//bad", "https://export.arxiv.org:80/", "https://springer.com.evil.io/")


@register(
    f"""
    SELECT page_id, h AS url, coalesce(regexp_matches(regexp_extract(lower(h), '^[a-z]+://(?:www\\.)?([^/:?#]+)', 1),
           '^(?:.*\\.)?(?:{"|".join(h.replace(".", chr(92) + ".") for h in verdicts.ACADEMIC_HOSTS)})$'), false) AS academic
    FROM (SELECT page_id, unnest([url, {_list("page_id", *_HOSTS)}]) AS h FROM pages)"""
)
def academic_pages(spark, sf_dir):
    both = F.explode(F.array("url", _case(F.col("page_id"), *_HOSTS))).alias("url")
    rows = table(spark, sf_dir, "pages").select("page_id", both)
    return rows.select("page_id", "url", verdicts.is_academic(F.col("url")).alias("academic"))


@register(
    f"""
    WITH r AS (SELECT doc_id, lower(coalesce(text, '')) AS t, {_list("doc_id", "https://github.com/a", "https://data.zenodo.org/r", "https://x.org")} AS u FROM documents)
    SELECT doc_id, regexp_matches(t, 'dataset|documentation|model card|repository|software') OR (NOT contains(u, 'x.org') AND regexp_matches(t, 'release|record')) AS source_like FROM r"""
)
def non_paper_sources(spark, sf_dir):
    url = _case(F.col("doc_id"), "https://github.com/a", "https://data.zenodo.org/r", "https://x.org")
    return table(spark, sf_dir, "documents").select("doc_id", verdicts.is_source_like(F.col("text"), url).alias("source_like"))


_TITLES = ("Nature. ", "ISBN 978-3-16-148410-0", "A study", "0-306-40615-2x", "isbn numbers", "Proceedings", "978 0306406157")
_VENUES = ("nature", "Springer", "", "Journal", "Science", "proceedings .", "x")
_RAW = ("Smith, eds. A study", "plain", "introduction by X", "the editorial office", "doi 10.1/2")
_WHO = ("Springer", "A. Author", " IEEE. ")


@register(
    f"""
    WITH r AS (SELECT o_orderkey AS k, trim(lower(trim({_list("o_orderkey", *_TITLES)})), ' .') AS t, trim(lower(trim({_list("o_orderkey", *_VENUES)})), ' .') AS v,
                      {_list("o_orderkey // 7", *_RAW)} AS raw, trim(lower(trim({_list("o_orderkey // 35", *_WHO)})), ' .') AS a FROM orders)
    SELECT k AS o_orderkey, CASE WHEN t <> '' AND t = v THEN 'title is venue'
           WHEN regexp_matches(t, '^(?:isbn\\s*)?(?:97[89][\\s-]?)?[0-9][0-9\\s-]{{8,}}[0-9x]$') THEN 'title is isbn'
           WHEN a IN ('springer', 'ieee') AND contains(t, 'isbn') THEN 'author is publisher'
           WHEN regexp_matches(lower(raw), '\\b(?:edited by|editors?|eds\\.?|introduction by|foreword by)\\b') THEN 'editors' END AS fault FROM r"""
)
def parser_artifacts(spark, sf_dir):
    key = F.col("o_orderkey")
    fault = verdicts.artifact(_case(key, *_TITLES), _case(key, *_VENUES), _case(F.floor(key / 7), *_RAW), _case(F.floor(key / 35), *_WHO), F.lit(None).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", fault.alias("fault"))


_STATES = ("verified", "error", "unverified", "hallucination", "pending", "warning", "queued", "suggestion")


@register(
    f"""
    WITH r AS (SELECT o_orderkey AS k, {_list("o_orderkey", *_STATES)} AS s, o_orderkey % 13 = 0 AS pending, o_orderkey % 5 = 0 AS assessed, o_orderkey % 15 = 0 AS found,
                      o_orderkey % 17 = 0 AS e, o_orderkey % 19 = 0 AS w, o_orderkey % 3 = 0 AS g, o_orderkey % 2 = 0 AS done FROM orders)
    SELECT k AS o_orderkey, CASE WHEN pending AND NOT assessed THEN 'checking' WHEN s = 'unverified' AND NOT assessed AND NOT done THEN 'checking'
           WHEN s = 'hallucination' AND found THEN 'verified' WHEN s = 'hallucination' THEN s WHEN found THEN CASE WHEN g THEN 'suggestion' ELSE 'verified' END
           WHEN e THEN 'error' WHEN w THEN 'warning' WHEN g THEN 'suggestion' WHEN s IN ('error', 'warning', 'suggestion') THEN 'verified'
           WHEN s IN ('verified', 'unverified') THEN s WHEN done THEN 'unchecked' WHEN s = 'pending' THEN s ELSE 'checking' END AS status FROM r"""
)
def effective_statuses(spark, sf_dir):
    key = F.col("o_orderkey")

    def one_in(n):
        return key % n == 0

    has = {"error": one_in(17), "warning": one_in(19), "suggestion": one_in(3)}
    status = results.effective_status(_case(key, *_STATES), one_in(13), one_in(5), one_in(15), has, one_in(2))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@register(
    f"""
    WITH r AS (SELECT o_orderkey AS k, {_list("o_orderkey", *_STATES)} AS s, ['LIKELY', 'UNLIKELY', 'uncertain', ''][o_orderkey // 8 % 4 + 1] AS v, o_orderkey % 3 = 0 AS found FROM orders)
    SELECT k AS o_orderkey, CASE WHEN v = 'LIKELY' THEN CASE WHEN found THEN 'verified' ELSE 'hallucination' END ELSE s END AS status,
           v = 'UNLIKELY' AND found AND s = 'unverified' AS again FROM r"""
)
def applied_verdicts(spark, sf_dir):
    key = F.col("o_orderkey")
    status, again = verdicts.apply_verdict(_case(key, *_STATES), _case(F.floor(key / 8), "LIKELY", "UNLIKELY", "uncertain", ""), key % 3 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), again.alias("again"))


@register(
    """
    SELECT p_partkey, p_partkey % 4 = 0 OR p_partkey % 3 <> 0 AS complete FROM part"""
)
def complete_records(spark, sf_dir):
    key = F.col("p_partkey")
    none, some = F.array().cast("array<string>"), F.array(F.col("p_name"))
    done = verdicts.complete(F.when(key % 4 == 0, none).otherwise(some), F.when(key % 3 == 0, none).otherwise(some))
    return table(spark, sf_dir, "part").select("p_partkey", done.alias("complete"))


@register(
    """
    WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS n, ['et al', 'et al.', 'Others', 'and others', p_brand][p_partkey % 5 + 1] AS last FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 5 <> 4 AND len(n) > 1 THEN array_to_string(n, ';') END AS full_list FROM w"""
)
def recovered_author_lists(spark, sf_dir):
    names = F.split("p_name", " ")
    last = F.get(F.array(*[F.lit(x) for x in ("et al", "et al.", "Others", "and others")], F.col("p_brand")), (F.col("p_partkey") % 5).cast("int"))
    full = verdicts.recovered_authors(F.array(F.get(names, F.lit(0)), last), names)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(full, ";").alias("full_list"))


@register(
    r"""
    WITH t AS (SELECT page_id, regexp_extract(html, '<title[^>]*>([^<]*)</title>', 1) AS p, html FROM pages),
    k AS (SELECT page_id, p, list_distinct(list_filter(list_transform(string_split_regex(lower(p), '\s+'), lambda w: trim(w, '.,;:()[]')), lambda w: length(w) > 3)) AS pw,
                 ['annual report of results', 'user guide to everything', p][page_id % 3 + 1] AS c FROM t),
    m AS (SELECT *, list_distinct(list_filter(list_transform(string_split_regex(lower(c), '\s+'), lambda w: trim(w, '.,;:()[]')), lambda w: length(w) > 3)) AS cw FROM k)
    SELECT page_id, contains(lower(trim(p)), lower(trim(c))) OR contains(lower(trim(c)), lower(trim(p))) OR len(list_intersect(cw, pw)) >= least(2, len(cw) // 2)
           OR (list_has_any(cw, ['api', 'documentation', 'guide', 'tutorial', 'reference', 'docs']) AND list_has_any(pw, ['api', 'documentation', 'guide', 'tutorial', 'reference', 'docs'])
               AND len(list_intersect(cw, pw)) >= 1) AS about FROM m"""
)
def pages_about_titles(spark, sf_dir):
    page = F.regexp_extract("html", "<title[^>]*>([^<]*)</title>", 1)
    cited = F.get(F.array(F.lit("annual report of results"), F.lit("user guide to everything"), page), (F.col("page_id") % 3).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", titles.page_is_about(cited, page, F.lit(None).cast("string")).alias("about"))


_LONG = "a torn lateral measure of things"


@register(
    f"""
    WITH t AS (SELECT p_partkey AS k, '{_LONG} ' || lower(p_name) AS h, lower(p_type) AS s FROM part),
    p AS (SELECT k, h AS a, [h || ': ' || s, h || ' ' || s, s || ' ' || h, s || ': ' || h, h || '!'][k % 5 + 1] AS b, h, s FROM t)
    SELECT k AS p_partkey, CASE k % 5 WHEN 1 THEN length(h) >= floor(0.7 * length(b)) WHEN 2 THEN false ELSE true END AS aligned FROM p"""
)
def aligned_subtitles(spark, sf_dir):
    head = F.concat(F.lit(_LONG + " "), F.col("p_name"))
    kind = F.col("p_type")
    other = F.get(
        F.array(
            F.concat_ws(": ", head, kind), F.concat_ws(" ", head, kind), F.concat_ws(" ", kind, head), F.concat_ws(": ", kind, head), F.concat(head, F.lit("!"))
        ),
        (F.col("p_partkey") % 5).cast("int"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", titles.titles_align(head, other).alias("aligned"))


@register(
    r"""
    WITH t AS (SELECT p_partkey AS k, '"' || p_name || ' (2nd Workshop on ' || p_type || ')  cross-' || chr(10) || ' linking (' || (1980 + p_size) || ') ' || p_brand || ' ' || (1970 + p_size) || '.;' AS t FROM part)
    SELECT k AS p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(t, '\s+', ' ', 'g')), '[.,;:]+$', ''),
              '([a-z])-\s+([a-z])', '\1\2', 'g'), '^["'']+|["'']+$', '', 'g'), '\s*\((?:19|20)[0-9]{2}\)\s*', ' ', 'g'), '\s+(?:19|20)[0-9]{2}\s*$', ''), '\s+', ' ', 'g')) AS clean,
           trim(regexp_replace(regexp_replace(t, '\s*\(2nd Workshop[^)]*\)\s*', ' '), '\s+', ' ', 'g')) AS no_meeting FROM t"""
)
def cleaned_titles(spark, sf_dir):
    year = [(F.col("p_size") + y).cast("string") for y in (1980, 1970)]
    t = F.concat(
        F.lit('"'), "p_name", F.lit(" (2nd Workshop on "), "p_type", F.lit(")  cross-\n linking ("), year[0], F.lit(") "), "p_brand", F.lit(" "), year[1], F.lit(".;")
    )
    return table(spark, sf_dir, "part").select("p_partkey", titles.clean_title(t).alias("clean"), titles.without_meeting(t).alias("no_meeting"))


@register(
    """
    SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN replace(p_name, ' ', '-') || ' ' || lower(p_type) ELSE p_name || ' ' || lower(p_type) END AS title FROM part"""
)
def repaired_titles(spark, sf_dir):
    """Names of parts run together, broken at a hyphen or a blank, or as compounds at a line's
    end, repaired by the words of all names and types."""
    parts = table(spark, sf_dir, "part")
    head, tail = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    kind = F.lower("p_type")
    half = F.floor(F.length(kind) / 2).cast("int")
    start, end = F.left(kind, half), F.substring(kind, half + 1, F.length(kind))
    broken = _case(
        F.col("p_partkey") % 5,
        F.concat(head, tail, kind),
        F.concat(F.col("p_name"), F.lit(" "), start, F.lit("-  "), end),
        F.concat(F.col("p_name"), F.lit(" "), start, F.lit(" "), end),
        F.concat(head, F.lit("- "), tail, F.lit(" "), kind),
        F.concat_ws(" ", "p_name", kind),
    )
    known = wordbreaks.vocabulary(parts.select(F.concat_ws(" ", "p_name", "p_type").alias("t")), "t")
    return wordbreaks.repaired_titles(parts.select("p_partkey", broken.alias("title")), "p_partkey", "title", known)


@register(
    """
    WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS n FROM part)
    SELECT p_partkey, 'V ' || 'oicebox for ' || p_name AS broken, 'Voicebox for ' || p_name AS joined, true AS lost FROM w"""
)
def joined_fragments(spark, sf_dir):
    broken = F.concat(F.lit("V oicebox for "), F.col("p_name"))
    glued = F.concat(F.lit("Averyveryverylongword"), F.col("p_name"))
    spaced = F.concat(F.lit("A very very very long word"), F.col("p_name"))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        "p_partkey", broken.alias("broken"), titles.join_fragments(broken).alias("joined"), titles.spaces_lost(glued, spaced).alias("lost")
    )


@register(
    """
    WITH a AS (SELECT p_partkey, p_name AS t, p_brand || ' ' || p_name AS u FROM part),
    w AS (SELECT p_partkey, list_distinct(string_split(regexp_replace(lower(t), '[^a-z0-9\\s]+', ' ', 'g'), ' ')) AS x,
                 list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(u), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ')), lambda v: v <> '') AS y FROM a)
    SELECT p_partkey, CAST(round(len(list_intersect(x, y)) / greatest(len(x), len(y)), 6) AS DOUBLE) AS overlap FROM w"""
)
def title_word_overlap(spark, sf_dir):
    share = titles.words_overlap(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name"))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.round(share, 6).alias("overlap"))


@register(
    """
    WITH r AS (SELECT p_partkey AS k, '2101.' || (10000 + p_partkey) AS cited, '2101.' || (10000 + p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS right_id FROM part)
    SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN 'arxiv_id' WHEN k % 3 = 1 AND k % 2 = 0 THEN 'title' WHEN k % 3 = 1 THEN 'arxiv_id' END AS mismatch FROM r"""
)
def identifier_mismatches(spark, sf_dir):
    key = F.col("p_partkey")

    def ident(n):
        # a month has 99,999 numbers at most, so the key fills the archive's letters, too
        number = F.lpad(n.cast("string"), 12, "0")
        archive = F.translate(F.left(number, F.lit(5)), "0123456789", "abcdefghij")
        return F.concat(F.lit("https://arxiv.org/abs/"), archive, F.lit("/"), F.right(number, F.lit(7)), F.lit("v2"))

    title, other = F.col("p_name"), F.when(key % 3 == 1, "Unrelated quantum chemistry survey").otherwise(F.col("p_name"))
    authors = F.array(F.lit("Ann Lee"), F.lit("Bo Chen"))
    by = F.when(key % 2 == 0, authors).otherwise(F.array(F.lit("Zoe Quist"), F.lit("Yan Pol")))
    found = verdicts.id_mismatch(ident(key + 10000), ident(key + 10000 + F.when(key % 3 == 0, 1).otherwise(0)), title, authors, other, by)
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", found.alias("mismatch"))


@register(
    """
    SELECT p_partkey, CAST([1.0, 0.94, 0.0, 0.9, 0.8][p_partkey % 5 + 1] AS DOUBLE) AS score FROM part"""
)
def version_match_scores(spark, sf_dir):
    """Equal titles, with the lists of authors equal, half equal, strange, of one author, none."""
    lists = [["Ann Lee", "Bo Chen"], ["Ann Lee", "Bo Chen", "Cy Diaz"], ["Ann Lee", "Bo Chen"], ["Ann Lee"], []]
    others = [["Ann Lee", "Bo Chen"], ["Ann Lee", "Bo Chen", "Xu Wei"], ["Zoe Quist", "Yan Pol"], ["Zoe Quist"], ["Ann Lee"]]

    def at(xs):
        each = [F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in xs]
        return F.get(F.array(*each), (F.col("p_partkey") % 5).cast("int"))

    title = F.col("p_name")
    score = verdicts.match_score(title, at(lists), F.upper(title), at(others))
    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.round(score, 6).alias("score"))


