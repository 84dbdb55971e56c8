"""Text, reference and redaction operators over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as S
from . import corpus as X
from .columns import rounded, with_sql

QUERIES = {}


def add(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = (run, sql)
        return run

    return keep


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def labelled_sql(patterns: dict[str, str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {quoted(k)} AS label, len(regexp_extract_all(text, {quoted(p)})) AS hits FROM blocks"
        for k, p in patterns.items()
    )
    return with_sql(
        X.PAPERS_SQL,
        f"h AS ({parts})",
        select="SELECT doc_id, label, sum(hits) AS matches, count(*) AS blocks, 'medium' AS severity FROM h WHERE hits > 0 GROUP BY doc_id, label",
    )


@add("t1_placeholders", labelled_sql(S.PLACEHOLDERS))
def t1(spark, sf_dir):
    return S.labelled_matches(X.paper_blocks(spark, sf_dir), S.PLACEHOLDERS)


@add(
    "t2_chatbot_phrases",
    with_sql(
        X.PAPERS_SQL,
        "h AS (" + " UNION ALL ".join(
            f"SELECT doc_id, unnest(regexp_extract_all(text, {quoted(p)})) AS phrase FROM blocks" for p in S.CHATBOT
        ) + ")",
        select="SELECT doc_id, lower(phrase) AS phrase, count(*) AS matches, 'high' AS severity FROM h GROUP BY doc_id, lower(phrase)",
    ),
)
def t2(spark, sf_dir):
    return S.chatbot_phrases(X.paper_blocks(spark, sf_dir))


@add("t3_broken_citations", labelled_sql(S.BROKEN_CITATIONS))
def t3(spark, sf_dir):
    return S.labelled_matches(X.paper_blocks(spark, sf_dir), S.BROKEN_CITATIONS)


@add(
    "t4_template_phrases",
    with_sql(
        X.PAPERS_SQL,
        f"r AS (SELECT doc_id, CASE WHEN regexp_matches(text, {quoted(S.PUNCTUATION_BURST)}) THEN 'punctuation' "
        f"WHEN regexp_matches(text, {quoted(S.HEDGING)}) THEN 'hedging' END AS reason FROM blocks)",
        select="SELECT doc_id, reason, count(*) AS blocks, 'low' AS severity FROM r WHERE reason IS NOT NULL GROUP BY doc_id, reason",
    ),
)
def t4(spark, sf_dir):
    return S.template_phrases(X.paper_blocks(spark, sf_dir))


GRAMS = (
    "tok AS (SELECT doc_id, block_no, regexp_extract_all(lower(text), '[一-鿿]|[a-z]+|\\d+|[^\\s]') AS t FROM blocks)",
    "g AS (SELECT doc_id, block_no, i AS spot, array_to_string(t[i:i + 3], ' ') AS gram FROM (SELECT doc_id, block_no, t, "
    "unnest(range(1, greatest(len(t) - 2, 1))) AS i FROM tok WHERE len(t) >= 4))",
    "ph AS (SELECT DISTINCT phrase FROM dict)",
    "hit AS (SELECT doc_id, block_no, spot, gram AS phrase FROM g JOIN ph ON gram = phrase)",
)


@add(
    "j19_phrase_matches",
    with_sql(
        X.PAPERS_SQL, X.PHRASES_SQL, *GRAMS,
        select="SELECT doc_id, block_no, phrase, count(*) AS matches FROM hit GROUP BY ALL",
    ),
)
def j19(spark, sf_dir):
    return S.phrase_matches(X.paper_blocks(spark, sf_dir), X.phrase_dictionary(spark, sf_dir))


@add(
    "t5_phrase_report",
    with_sql(
        X.PAPERS_SQL, X.PHRASES_SQL, *GRAMS,
        select="SELECT doc_id, count(DISTINCT phrase) AS distinct_phrases, count(*) AS total, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM hit GROUP BY doc_id",
    ),
)
def t5(spark, sf_dir):
    return S.phrase_report(
        S.phrase_matches(X.paper_blocks(spark, sf_dir), X.phrase_dictionary(spark, sf_dir))
    )


@add(
    "t11_phrase_density",
    with_sql(
        X.PAPERS_SQL, X.PHRASES_SQL,
        "p AS (SELECT DISTINCT phrase FROM dict)",
        "h AS (SELECT doc_id, count(*) AS n FROM papers, p WHERE contains(lower(text), phrase) GROUP BY ALL)",
        select="SELECT doc_id, n AS distinct_phrases, CASE WHEN n >= 3 THEN 'high' WHEN n = 2 THEN 'medium' END AS severity FROM h",
    ),
)
def t11(spark, sf_dir):
    return S.phrase_density(X.papers(spark, sf_dir), X.phrase_dictionary(spark, sf_dir))


@add(
    "t28_phrase_dictionary",
    with_sql(
        X.PHRASES_SQL,
        select="SELECT phrase, arg_min(intended, CAST(intended AS BIGINT)) AS intended FROM dict WHERE CAST(intended AS BIGINT) % 5 <> 0 "
        "AND CAST(intended AS BIGINT) % 10 >= 4 AND length(phrase) >= 4 AND phrase <> 'the of and to' GROUP BY phrase",
    ),
)
def t28(spark, sf_dir):
    n = F.col("intended").cast("long")
    rows = X.phrase_dictionary(spark, sf_dir).select(
        n.alias("row_no"),
        F.upper("phrase").alias("phrase"),
        "intended",
        (n % 5 != 0).alias("verified"),
        F.lit(True).alias("likely"),
        F.when(n % 10 >= 4, 0.95).otherwise(0.5).alias("confidence"),
    )
    return S.build_dictionary(rows, ["the of and to"])


SHINGLES = """w AS (SELECT lang AS doc_id, doc_id AS block_no, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
sh AS (SELECT DISTINCT doc_id, block_no, array_to_string(t[i:i + 4], ' ') AS g FROM (SELECT doc_id, block_no, t, unnest(range(1, len(t) - 3)) AS i FROM w WHERE len(t) >= 30)),
sz AS (SELECT doc_id, block_no, count(*) AS n FROM sh GROUP BY ALL),
ov AS (SELECT a.doc_id, a.block_no AS x, b.block_no AS y, count(*) AS c FROM sh a JOIN sh b ON a.doc_id = b.doc_id AND a.g = b.g GROUP BY ALL),
e AS (SELECT o.doc_id, x, y FROM ov o JOIN sz a ON a.doc_id = o.doc_id AND a.block_no = x JOIN sz b ON b.doc_id = o.doc_id AND b.block_no = y
 WHERE c * 1.0 / (a.n + b.n - c) >= 0.9)"""


@add(
    "j18_duplicate_passages",
    with_sql(
        SHINGLES,
        select="""SELECT doc_id, lead AS first_block, count(*) AS members, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS severity FROM (
 SELECT doc_id, x, min(y) AS lead FROM (WITH RECURSIVE r(doc_id, x, y) AS (SELECT doc_id, x, y FROM e UNION SELECT r.doc_id, r.x, e.y FROM r JOIN e
 ON r.doc_id = e.doc_id AND r.y = e.x) SELECT * FROM r) GROUP BY doc_id, x) GROUP BY doc_id, lead HAVING count(*) >= 2""",
    ),
)
def j18(spark, sf_dir):
    blocks = X.read(spark, sf_dir, "documents").select(
        F.col("lang").alias("doc_id"), F.col("doc_id").alias("block_no"), "text"
    )
    return S.duplicate_passages(blocks)


@add("w7_copy_loops")
def w7(spark, sf_dir):
    blocks = X.read(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("block_no"), "text")
    return S.copy_loops(blocks)


@add(
    "t6_compliance",
    with_sql(
        X.PAPERS_SQL,
        select=" UNION ALL ".join(
            f"SELECT doc_id, '{k}' AS category, regexp_matches(text, {quoted(p)}) AS present FROM papers"
            for k, p in S.COMPLIANCE.items()
        ),
    ),
)
def t6(spark, sf_dir):
    return S.compliance(X.papers(spark, sf_dir)).drop("contexts")


@add(
    "u2_missing_statements",
    with_sql(
        X.PAPERS_SQL,
        "c AS (" + " UNION ALL ".join(
            f"SELECT doc_id, '{k}' AS category, regexp_matches(text, {quoted(p)}) AS present FROM papers"
            for k, p in S.COMPLIANCE.items()
        ) + ")",
        select="SELECT doc_id, list_sort(list(category)) AS missing FROM c WHERE NOT present GROUP BY doc_id",
    ),
)
def u2(spark, sf_dir):
    return S.missing_statements(X.papers(spark, sf_dir))


_FREE = ", ".join(f"'{d}'" for d in S.FREE_MAIL)


@add(
    "t7_t12_byline_emails",
    with_sql(
        X.PAPERS_SQL,
        f"m AS (SELECT doc_id, unnest(regexp_extract_all(lower(string_split_regex(text, {quoted(S.BYLINE_END)})[1]), {quoted(S.EMAIL)})) AS email FROM papers)",
        "a AS (SELECT doc_id, email, count(*) AS c FROM m GROUP BY ALL)",
        "d AS (SELECT doc_id, regexp_extract(email, '@([^@]*)$', 1) AS domain, sum(c) AS c, count(*) FILTER (c > 1) AS rep FROM a GROUP BY ALL)",
        f"""p AS (SELECT q.doc_id, coalesce(sum(c), 0) AS emails, coalesce(max(c), 0) AS top_domain, coalesce(sum(rep), 0) AS duplicates,
 coalesce(sum(CASE WHEN domain IN ({_FREE}) THEN c ELSE 0 END), 0) AS free_mail FROM papers q LEFT JOIN d USING (doc_id) GROUP BY q.doc_id)""",
        select="""SELECT *, CASE WHEN duplicates > 0 THEN 'medium' WHEN emails = 0 OR (top_domain > emails / 2 AND emails >= 3)
 OR (free_mail > 2 AND free_mail > emails / 2) THEN 'low' END AS severity FROM p""",
    ),
)
def t7(spark, sf_dir):
    return S.byline_emails(X.papers(spark, sf_dir)).drop("checks")


_CUT = f"string_split_regex({{0}}, {quoted(S.BYLINE_END)})[1]"
#: The same name without a look-behind; on these texts no capital follows a letter.
_INDEXED = quoted(S.INDEXED_AUTHOR.removeprefix("(?<![A-Za-z])"))
_BLOCK = _CUT.format("text")
for _marker in reversed(S.CORRESPONDENCE):
    _spot = f"instr(upper(text), '{_marker}')"
    _BLOCK = f"CASE WHEN {_spot} > 0 AND {_spot} - 1 < length(text) // 2 THEN {_CUT.format(f'substr(text, {_spot})')} ELSE {_BLOCK} END"


@add(
    "t8_t13_authorship",
    with_sql(
        X.PAPERS_SQL,
        f"""fa AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, {quoted(S.FIRST_AUTHOR)})
 THEN length(string_split_regex(text, {quoted(S.FIRST_AUTHOR)})[1]) + 1 ELSE 0 END AS pos FROM papers)""",
        f"""bl AS (SELECT doc_id, CASE WHEN pos > 0 AND regexp_matches(substr(text, pos), '{S.AUTHOR_PLACE}')
 THEN substr(text, greatest(pos - 80, 1), least(80, pos - 1)) || {_CUT.format('substr(text, pos)')} ELSE {_BLOCK} END AS b FROM fa)""",
        f"""nm AS (SELECT doc_id, b, list_distinct(list_filter(list_transform(regexp_extract_all(b, {_INDEXED}, 1), lambda x: regexp_replace(x, '\\s+', ' ', 'g')),
 lambda x: length(x) >= 4 AND NOT regexp_matches(lower(x), '{"|".join(S.NOT_AUTHOR)}'))) AS names,
 len(regexp_extract_all(b, {quoted(S.PLAIN_AUTHOR)})) AS plain,
 list_transform(string_split_regex(b, {quoted(S.PLAIN_AUTHOR)}), lambda x: length(x)) AS gaps,
 len(list_filter(regexp_extract_all(b, {_INDEXED}, 2), lambda x: len(string_split(x, ',')) >= 3)) AS stacked_authors,
 len(list_distinct(list_filter(list_transform(list_filter(list_transform(string_split_regex(b, '[.\\n]'), lambda c: trim(c)),
 lambda c: length(c) BETWEEN 8 AND 400 AND regexp_matches(c, {quoted(S.AFFILIATION)})),
 lambda c: trim(regexp_replace(regexp_replace(lower(c), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))), lambda c: length(c) >= 10))) AS affiliations FROM bl)""",
        """au AS (SELECT *, CASE WHEN len(names) > 0 THEN len(names) ELSE coalesce(nullif(list_position(list_transform(gaps[2:plain], lambda g: g > 220), true), 0), plain) END AS authors FROM nm),
ra AS (SELECT *, CASE WHEN authors > 0 AND affiliations > 0 THEN affiliations * 1.0 / authors END AS r FROM au)""",
        select="""SELECT doc_id, authors::INT AS authors, affiliations::INT AS affiliations, stacked_authors::INT AS stacked_authors, round(r, 6) AS ratio,
 CASE WHEN authors >= 15 AND r <= 0.25 THEN 'high' WHEN (authors >= 8 AND r <= 0.35) OR (authors >= 6 AND r <= 0.30) THEN 'medium' WHEN authors >= 4 AND r <= 0.40 THEN 'low' END AS severity,
 CASE WHEN stacked_authors >= 1 AND (authors >= 3 OR stacked_authors >= 2) THEN CASE WHEN stacked_authors >= 2 OR authors >= 4 THEN 'medium' ELSE 'low' END END AS stacking_severity FROM ra""",
    ),
)
def t9(spark, sf_dir):
    return S.authorship(X.papers(spark, sf_dir))


@add(
    "t14_thin_review",
    with_sql(
        X.PAPERS_SQL,
        f"b AS (SELECT doc_id, regexp_extract(text, {quoted(S.REVIEWER_BLOCK)}, 1) AS block FROM papers WHERE regexp_matches(text, '(?i)retracted'))",
        "n AS (SELECT doc_id, list_filter(list_transform(string_split_regex(block, '[\\n,]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), "
        f"lambda x: length(x) BETWEEN 5 AND 60 AND NOT regexp_matches(x, {quoted(S.NOT_A_REVIEWER)}) AND regexp_matches(x, {quoted(S.REVIEWER)})) AS names FROM b)",
        select="SELECT doc_id, len(names)::INT AS reviewers FROM n WHERE len(names) BETWEEN 1 AND 3",
    ),
)
def t14(spark, sf_dir):
    return S.thin_review(X.papers(spark, sf_dir))


_MAP = ", ".join(f"'{k}'" for k in S.HEADINGS)


@add(
    "t15_odd_headings",
    with_sql(
        X.PAPERS_SQL,
        f"h AS (SELECT DISTINCT doc_id, regexp_replace(lower(trim(regexp_extract(trim(text), {quoted(S.HEADING)}, 1))), '\\s+', ' ', 'g') AS norm "
        "FROM blocks WHERE length(trim(text)) BETWEEN 1 AND 100)",
        select=f"SELECT doc_id, count(*) AS odd_headings, CASE WHEN count(*) >= 3 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS severity FROM h WHERE norm IN ({_MAP}) GROUP BY doc_id",
    ),
)
def t15(spark, sf_dir):
    return S.odd_headings(X.paper_blocks(spark, sf_dir))


REFS = f"""refs AS (SELECT doc_id, block_no, trim(text) AS ref FROM blocks WHERE trim(text) <> '' AND (regexp_matches(trim(text), {quoted(S.REFERENCE_START)})
 OR regexp_matches(text, {quoted(S.DOI)}) OR (regexp_matches(text, {quoted(S.YEAR)}) AND length(trim(text)) > 30)))"""


@add("t16_references", with_sql(X.PAPERS_SQL, REFS, select="SELECT * FROM refs"))
def t16(spark, sf_dir):
    return S.references(X.paper_blocks(spark, sf_dir))


STYLES = f"""st AS (SELECT doc_id, CASE WHEN q AND paren AND NOT semic THEN 'chicago' WHEN NOT q AND y AND semic THEN 'vancouver' WHEN NOT q AND y THEN 'ieee'
 WHEN y AND contains(left(ref, 20), ',') THEN 'apa' ELSE 'unknown' END AS style FROM (SELECT *, regexp_matches(ref, {quoted(S.QUOTED_TITLE)}) AS q,
 regexp_matches(ref, {quoted(S.YEAR)}) AS y, contains(ref, '(') AND contains(ref, ')') AS paren, contains(ref, ';') AS semic FROM refs))"""


@add(
    "t17_reference_styles",
    with_sql(
        X.PAPERS_SQL, REFS, STYLES,
        select="SELECT doc_id, count(*) AS refs, count(DISTINCT style) FILTER (style <> 'unknown') AS styles, "
        "CASE WHEN count(DISTINCT style) FILTER (style <> 'unknown') >= 3 THEN 'medium' END AS severity FROM st GROUP BY doc_id",
    ),
)
def t17(spark, sf_dir):
    return S.reference_styles(S.references(X.paper_blocks(spark, sf_dir)))


IDS = f"""ids AS (SELECT doc_id, block_no, ref, 'doi:' || rtrim(unnest(regexp_extract_all(ref, {quoted(S.DOI)})), '.,;') AS id FROM refs
 UNION ALL SELECT doc_id, block_no, ref, 'pmid:' || unnest(regexp_extract_all(ref, {quoted(S.PMID)}, 1)) FROM refs
 UNION ALL SELECT doc_id, block_no, ref, 'arxiv:' || unnest(regexp_extract_all(ref, {quoted(S.ARXIV)}, 1)) FROM refs)"""


@add(
    "h19_identifiers",
    with_sql(X.PAPERS_SQL, REFS, IDS, select="SELECT doc_id, block_no, id FROM ids"),
)
def h19(spark, sf_dir):
    refs = S.references(X.paper_blocks(spark, sf_dir))
    return refs.select("doc_id", "block_no", F.explode(S.identifiers(F.col("ref"))).alias("id"))


@add(
    "t18_conflicting_references",
    with_sql(
        X.PAPERS_SQL, REFS, IDS,
        "base AS (SELECT doc_id, id, min(block_no) AS b0, arg_min(ref, block_no) AS r0 FROM ids GROUP BY ALL)",
        f"""cf AS (SELECT i.doc_id, i.id, i.block_no, CASE WHEN len(regexp_extract_all(r0, {quoted(S.YEAR)})) > 0 AND len(regexp_extract_all(ref, {quoted(S.YEAR)})) > 0
 AND regexp_extract_all(r0, {quoted(S.YEAR)}) <> regexp_extract_all(ref, {quoted(S.YEAR)}) THEN 'year' END AS conflict
 FROM ids i JOIN base b ON i.doc_id = b.doc_id AND i.id = b.id AND i.block_no > b0)""",
        select="SELECT doc_id, id, arg_min(conflict, block_no) AS conflict, 'high' AS severity FROM cf WHERE conflict IS NOT NULL GROUP BY doc_id, id",
    ),
)
def t18(spark, sf_dir):
    return S.conflicting_references(S.references(X.paper_blocks(spark, sf_dir)))


@add(
    "t19_u3_citations",
    with_sql(
        X.PAPERS_SQL,
        f"c AS (SELECT doc_id, block_no, unnest(regexp_extract_all(text, {quoted(S.CITATION)})) AS raw FROM blocks UNION ALL "
        f"SELECT doc_id, block_no, unnest(regexp_extract_all(text, {quoted(S.NUMERIC_CITATION)})) FROM blocks)",
        select=f"SELECT doc_id, raw, regexp_extract(raw, {quoted(S.CITATION)}, 1) AS author, regexp_extract(raw, {quoted(S.CITATION)}, 2) AS year, min(block_no) AS block_no FROM c GROUP BY doc_id, raw",
    ),
)
def t19(spark, sf_dir):
    return S.citations(X.paper_blocks(spark, sf_dir))


# The same headings for an engine without look-around: the character behind a heading is matched and given back.
HEADING = S.SECTION_START.replace("(?<![A-Za-z0-9])", "").replace("(?=[:.\\n\\s]|$)", "(?:[:.\\s]|$)")


@add(
    "t21_availability_flags",
    with_sql(
        X.PAPERS_SQL,
        f"h AS (SELECT doc_id, text, regexp_extract(text, {quoted(HEADING)}) AS heading FROM papers)",
        "t AS (SELECT *, CASE WHEN heading <> '' THEN substr(text, instr(text, heading) + length(heading) - 1) END AS tail FROM h)",
        f"s AS (SELECT *, CASE WHEN regexp_matches(tail, {quoted(S.SECTION_END)}) THEN regexp_extract(tail, {quoted('(?s)^(.*?)(?:' + S.SECTION_END + ')')}, 1) "
        "ELSE tail END AS section FROM t)",
        select=" UNION ALL ".join(
            [
                f"SELECT doc_id, '{k}' AS category, '{severity}' AS severity FROM s WHERE regexp_matches(coalesce(section, text), {quoted(p)})"
                for k, (severity, p) in S.AVAILABILITY_FLAGS.items()
            ]
            + [
                f"SELECT doc_id, 'not_applicable', 'low' FROM s WHERE regexp_matches(left(section, 250), {quoted(S.NOT_APPLICABLE)})",
                "SELECT doc_id, 'missing_section', 'low' FROM s WHERE section IS NULL AND len(string_split_regex(trim(text), '\\s+')) > 2000",
            ]
        ),
    ),
)
def t21(spark, sf_dir):
    return S.availability_flags(X.papers(spark, sf_dir))


@add(
    "t20_statement_links",
    with_sql(
        X.PAPERS_SQL,
        select="SELECT doc_id, 'https://example.org/data' AS url FROM papers WHERE doc_id % 12 = 5",
    ),
)
def t20(spark, sf_dir):
    return S.statement_links(X.papers(spark, sf_dir))


@add(
    "t25_text_search",
    with_sql(
        X.TEXT_BLOCKS_SQL,
        select="SELECT doc_id, block_no AS line_no, text AS line FROM blocks WHERE contains(lower(text), 'email') OR contains(text, '@mail')",
    ),
)
def t25(spark, sf_dir):
    return S.search(X.read(spark, sf_dir, "documents"), "email|@mail", regex=True, ignore_case=True).filter(
        F.lower("line").contains("email") | F.col("line").contains("@mail")
    )


@add(
    "t26_note_fields",
    with_sql(
        "n AS (SELECT doc_id, '---' || chr(10) || 'title: ' || source || chr(10) || '---' || chr(10) || '# Head ' || lang || chr(10) || 'x #' || lang || ' #Alpha' AS text FROM documents)",
        select="SELECT doc_id, 'title: ' || source AS front_matter, source AS title, [lang, 'alpha'] AS tags FROM documents",
    ),
)
def t26(spark, sf_dir):
    notes = X.read(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.lit("---\ntitle: "), "source", F.lit("\n---\n# Head "), "lang", F.lit("\nx #"), "lang", F.lit(" #Alpha")
        ).alias("text"),
    )
    return S.note_fields(notes)


@add(
    "t27_html_text",
    with_sql(
        "a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g') AS h FROM pages)",
        select="SELECT page_id, md5(trim(regexp_replace(regexp_replace(h, '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM a",
    ),
)
def t27(spark, sf_dir):
    return X.read(spark, sf_dir, "pages").select(
        "page_id", F.md5(S.html_text(F.col("html"))).alias("digest")
    )


def _redact_sql(expr: str) -> str:
    for pattern, mark in S.REDACTIONS:
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(mark.replace('$', chr(92)))}, 'g')"
    return expr


@add(
    "h25_redacted_text",
    with_sql(X.PAPERS_SQL, select=f"SELECT doc_id, md5({_redact_sql('text')}) AS digest FROM papers"),
)
def h25(spark, sf_dir):
    return X.papers(spark, sf_dir).select("doc_id", F.md5(S.redacted(F.col("text"))).alias("digest"))


@add("h25_redacted_conversations")
def h25_conversations(spark, sf_dir):
    values = F.create_map(F.lit("text"), "text", F.lit("token"), "role")
    return X.read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", S.redacted_map(values).alias("payload")
    ).select("conv_id", "turn", F.col("payload")["token"].alias("token"), F.md5(F.col("payload")["text"]).alias("digest"))


@add(
    "k6_recent_documents",
    "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20",
)
def k6(spark, sf_dir):
    docs = X.read(spark, sf_dir, "documents")
    return docs.select("doc_id", "n_chars").orderBy(F.col("n_chars").desc(), "doc_id").limit(20)


@add("h20_sentences")
def h20(spark, sf_dir):
    return X.papers(spark, sf_dir).select("doc_id", F.size(S.sentences(F.col("text"))).alias("sentences"))
