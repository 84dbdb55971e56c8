"""Text patterns, phrases, passages, references and redaction (T*, J18-J19, W7, H19, H20, H25, U2-U3).

``blocks(doc_id, block_no, text)`` are lines or paragraphs, ``docs(doc_id, text)``
whole texts; nothing is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..session import written

# Pattern and word lists.
PLACEHOLDERS = {
    "TODO": r"\bTODO\b",
    "FIXME": r"\bFIXME\b",
    "XXX": r"\bXXX\b",
    "[?]": r"\[\?\]",
    "[XX]": r"\[XX\]|\[XXX\]",
    "<<<…>>>": r"<<<\s*[^>]{0,40}>>>",
    "{{…}}": r"\{\{\s*[A-Za-z_][A-Za-z0-9_]*\s*\}\}",
    "placeholder": r"(?i)\bplaceholder\b",
}
CHATBOT = (
    r"(?i)\bas an ai(?: language model)?\b",
    r"(?i)\bi am an ai\b",
    r"(?i)\blanguage model\b",
    r"(?i)\bi (?:cannot|can'?t) (?:provide|help|assist)\b",
    r"(?i)\bopenai\b",
    r"(?i)\bchatgpt\b",
    r"(?i)\bclaude\b",
    r"(?i)\bbard\b",
)
BROKEN_CITATIONS = {
    "broken marker": r"(?i)\[n\?\?\]|\[\?\]|\[XX\]|\[XXX\]",
    "TODO:cite": r"\bTODO\s*:\s*cite\b",
    "FIXME:ref": r"\bFIXME\s*:\s*ref\b",
    "et al.?": r"\bet al\.\s*\?",
    "(?)": r"\(\s*\?\s*\)",
}
PUNCTUATION_BURST = r"!{2,}|\?{2,}|!\?|\?!"
HEDGING = r"(?i)\b(?:certainly|of course|absolutely|sure!|you bet)[,!.]"
COMPLIANCE = {
    "data_availability": r"(?i)\b(data availability|data availability statement|data are available"
    r"|data is available|raw data are|data sharing|data access|raw data|raw data underlying)\b",
    "ethics_approval": r"(?i)\b(ethics approval|ethical approval|institutional review board|irb approval"
    r"|animal care and use|iacuc|ethics committee|ethical review|research ethics|ethics statement|approved by the)\b",
    "funding": r"(?i)\b(funding|funded by|financial support|grant number|grant support|supported by|funder|sponsored by)\b",
    "conflict_of_interest": r"(?i)\b(conflict[s]? of interest|competing interests|conflict of interest statement"
    r"|coi statement|no conflict[s]?|disclosure statement|disclosures)\b",
    "trial_registration": r"(?i)\b(trial registration|registered at|clinicaltrials\.gov|chictr\.org\.cn|anzctr\.org\.au"
    r"|isrctn\.com|clinical trials? registry|registration number|unique trial id)\b",
}
FREE_MAIL = (
    "gmail.com", "qq.com", "163.com", "126.com", "yahoo.com", "yahoo.com.cn", "hotmail.com",
    "outlook.com", "live.com", "foxmail.com", "sina.com", "sohu.com", "aol.com", "icloud.com",
)
HEADINGS = {
    "introduction and background": "Introduction",
    "background and introduction": "Introduction",
    "background of the study": "Introduction",
    "study background": "Introduction",
    "materials and methods": "Methods",
    "material and methods": "Methods",
    "methodology and methods": "Methods",
    "research methodology": "Methods",
    "experimental section": "Methods",
    "experimental procedure": "Methods",
    "results and discussion": "Results + Discussion",
    "results and analysis": "Results + Analysis",
    "discussion and results": "Discussion",
    "discussion and conclusion": "Discussion",
    "discussion section": "Discussion",
    "conclusion and discussion": "Conclusion",
    "conclusions and discussion": "Conclusion",
    "concluding remarks": "Conclusion",
    "summary and conclusion": "Conclusion",
    "conclusion section": "Conclusion",
    "literature review": "Introduction",
    "theoretical framework": "Introduction",
    "theoretical background": "Introduction",
    "associated works": "Related work",
}
AVAILABILITY_FLAGS = {
    "raw_data_unavailable": (
        "high",
        r"(?i)\b(raw data (?:are|is|were) (?:no longer|not) (?:longer\s+)?available"
        r"|raw data (?:are|is|were) (?:not|no longer) accessible|raw data (?:have|has) been (?:removed|lost|destroyed)"
        r"|source data (?:are|is) not available|underlying data (?:are|is) not available)\b",
    ),
    "authors_unresponsive": (
        "high",
        r"(?i)\b(authors? (?:have been |were )?unresponsive|authors? (?:failed|did not respond) to (?:provide|share) (?:the )?raw data"
        r"|authors? (?:have |has )?not responded to (?:multiple )?requests? for (?:the )?raw data"
        r"|authors? did not provide (?:the )?raw data)\b",
    ),
    "vague_availability": (
        "medium",
        r"(?i)\b(available (?:from |upon )?reasonable request|available (?:from |upon )?request"
        r"|available from the corresponding author|are available from the corresponding author on request"
        r"|available on request from the (?:corresponding )?author|data (?:are|is) available (?:on|upon) (?:a )?reasonable request"
        r"|will be made available (?:upon|on) (?:reasonable )?request|(?:can|may) be (?:obtained|requested) from the (?:corresponding )?author"
        r"|available from the authors? (?:upon|on) request|supporting data (?:are|is|will be) available (?:upon|on) request"
        r"|datasets? (?:generated|used) (?:during|in) (?:the )?(?:current|present) study (?:are|is) available from"
        r"|data (?:are|is) available from the corresponding author|further inquiries can be directed to"
        r"|data sharing is not applicable|the data that support the findings of this study (?:are|is) available from"
        r"|will be made available by the authors?|without undue reservation"
        r"|raw data supporting the conclusions of this article will be made available)\b",
    ),
    "restricted_availability": (
        "medium",
        r"(?i)\b(available (?:subject|with) (?:ethical|legal|privacy|confidentiality) (?:approval|restrictions|constraints)"
        r"|not publicly available due to (?:ethical|legal|privacy|confidentiality) (?:reasons|concerns|restrictions)"
        r"|access (?:is )?restricted (?:by|due to) (?:ethical|legal|privacy) (?:approval|reasons|restrictions)"
        r"|privacy (?:or|and) ethical restrictions|patient (?:privacy|confidentiality) (?:reasons|concerns)"
        r"|cannot be shared (?:publicly )?due to)\b",
    ),
    "within_manuscript_only": (
        "low",
        r"(?i)\b(all (?:relevant |underlying )?data (?:are|is) (?:included |presented |reported |shown )?(?:with)?in (?:the |this )"
        r"(?:manuscript|paper|article|main text|main manuscript)|available only within the (?:paper|manuscript|article)"
        r"|data (?:are|is) available only within|results of this study are available only within"
        r"|within the (?:manuscript|paper) and its supporting information)\b",
    ),
}
DOI = r"\b10\.\d{4,9}/[^\s,;]+"
PMID = r"(?i)\bPMID:\s*(\d+)\b"
ARXIV = r"\barXiv:(\d{4}\.\d{4,5})\b"
YEAR = r"\b((?:19|20)\d{2})\b"
URL = r"https?://[^\s)>\]]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
REFERENCE_START = r"^(\[\d+\]|\d+[.)])\s+\S"
QUOTED_TITLE = r'"([^"]{15,200})"'
HEADING = (
    r"^\s*(?:\d+\.|\d+\)|\([a-z]\)|[ivx]+\.)?\s*([A-Z][A-Za-z][A-Za-z \-]{1,80}[A-Za-z])\s*$"
)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


# --------------------------------------------------------------------------- patterns


def labelled_matches(blocks: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Matches per document and label in one pass over the text."""
    counts = F.array(
        *[
            F.struct(F.lit(k).alias("label"), F.size(find_all(F.col("text"), p)).alias("hits"))
            for k, p in patterns.items()
        ]
    )
    return (
        blocks.select("doc_id", F.explode(F.filter(counts, lambda c: c["hits"] > 0)).alias("c"))
        .groupBy("doc_id", F.col("c.label").alias("label"))
        .agg(F.sum("c.hits").alias("matches"), F.count(F.lit(1)).alias("blocks"))
        .withColumn("severity", F.lit("medium"))
    )


def chatbot_phrases(blocks: DataFrame) -> DataFrame:
    """Assistant disclaimers per distinct phrase."""
    found = F.concat(*[find_all(F.col("text"), p) for p in CHATBOT])
    return (
        blocks.select("doc_id", F.explode(found).alias("phrase"))
        .groupBy("doc_id", F.lower("phrase").alias("phrase"))
        .agg(F.count(F.lit(1)).alias("matches"))
        .withColumn("severity", F.lit("high"))
    )


def template_phrases(blocks: DataFrame) -> DataFrame:
    """Punctuation bursts, else hedging (T4)."""
    reason = F.when(F.col("text").rlike(PUNCTUATION_BURST), "punctuation").when(
        F.col("text").rlike(HEDGING), "hedging"
    )
    return (
        blocks.withColumn("reason", reason)
        .filter("reason IS NOT NULL")
        .groupBy("doc_id", "reason")
        .agg(F.count(F.lit(1)).alias("blocks"))
        .withColumn("severity", F.lit("low"))
    )


# --------------------------------------------------------------------------- phrase dictionary

TOKEN = r"[一-鿿]|[A-Za-z]+|\d+|[^\s]"


def phrase_tokens(text: Column) -> Column:
    """Letter runs, digit runs, single CJK characters and single symbols, lower case."""
    return find_all(F.lower(text), TOKEN)


def phrase_matches(blocks: DataFrame, phrases: DataFrame) -> DataFrame:
    """Dictionary phrases in text, longest first at each place.

    Token n-grams of the lengths in the dictionary meet it in an equi-join; the
    dictionary side is broadcast only when Spark finds it small enough.
    """
    words = (
        phrases.withColumn("t", phrase_tokens(F.col("phrase")))
        .select("phrase", F.concat_ws(" ", "t").alias("gram"), F.size("t").alias("len"))
        .filter("len > 0")
        .groupBy("gram", "len")
        .agg(F.min("phrase").alias("phrase"))
    )
    lengths = words.agg(F.sort_array(F.collect_set("len"))).scalar()  # a few small integers
    tokens = blocks.select("doc_id", "block_no", phrase_tokens(F.col("text")).alias("t"))
    grams = F.flatten(
        F.transform(
            "lens",
            lambda n: F.transform(
                F.when(
                    F.size("t") >= n, F.sequence(F.lit(1), F.size("t") - n + 1)
                ).otherwise(F.expr("array()").cast("array<int>")),
                lambda i: F.struct(
                    i.alias("at"), n.alias("len"), F.concat_ws(" ", F.slice("t", i, n)).alias("gram")
                ),
            ),
        )
    )
    spots = (
        tokens.withColumn("lens", lengths)
        .select("doc_id", "block_no", F.explode(grams).alias("g"))
        .select("doc_id", "block_no", "g.*")
    )
    hits = spots.join(words.select("gram", "phrase"), "gram")
    per_block = hits.groupBy("doc_id", "block_no").agg(
        F.array_sort(
            F.collect_list(F.struct("at", (-F.col("len")).alias("neg"), "len", "phrase"))
        ).alias("h")
    )
    kept = F.aggregate(
        "h",
        F.struct(F.lit(0).alias("free"), F.transform(F.slice("h", 1, 0), lambda x: x["phrase"]).alias("out")),
        lambda s, x: F.when(
            x["at"] >= s["free"],
            F.struct((x["at"] + x["len"]).alias("free"), F.array_append(s["out"], x["phrase"]).alias("out")),
        ).otherwise(s),
        lambda s: s["out"],
    )
    return (
        per_block.select("doc_id", "block_no", F.explode(kept).alias("phrase"))
        .groupBy("doc_id", "block_no", "phrase")
        .agg(F.count(F.lit(1)).alias("matches"))
    )


def phrase_report(matches: DataFrame) -> DataFrame:
    """Distinct and total phrases per document (T5)."""
    return (
        matches.groupBy("doc_id", "phrase")
        .agg(F.sum("matches").alias("m"))
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("distinct_phrases"), F.sum("m").alias("total"))
        .withColumn("severity", F.when(F.col("total") >= 3, "high").otherwise("medium"))
    )


def phrase_density(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Distinct phrases of at least four characters in a text, as plain substrings.

    A text's distinct four-character starts propose phrases; ids and phrases travel,
    the text itself is met once by its few candidates.
    """
    lowered = F.lower("text")
    starts = docs.select("doc_id", F.explode(F.array_distinct(find_all(lowered, r"(?s)(?=(.{4}))", 1))).alias("k"))
    words = phrases.select(F.lower("phrase").alias("phrase")).filter(F.length("phrase") >= 4)
    words = words.withColumn("k", F.substring("phrase", 1, 4)).distinct()
    proposed = starts.join(words, "k").groupBy("doc_id").agg(F.collect_set("phrase").alias("proposed"))
    there = F.filter("proposed", lambda p: F.contains(F.lower("text"), p))
    found = docs.select("doc_id", "text").join(proposed, "doc_id").select("doc_id", F.explode(there).alias("phrase"))
    counts = found.groupBy("doc_id").agg(F.count_distinct("phrase").alias("distinct_phrases"))
    n = F.col("distinct_phrases")
    return counts.withColumn("severity", F.when(n >= 3, "high").when(n >= 2, "medium"))


def build_dictionary(rows: DataFrame, blocklist: list[str]) -> DataFrame:
    """Verified, likely and confident phrases; the first spelling wins.

    ``rows(row_no, phrase, intended, verified, likely, confidence)``.
    """
    phrase = F.lower(F.trim("phrase"))
    kept = rows.withColumn("phrase", phrase).filter(
        F.col("verified")
        & F.col("likely")
        & (F.col("confidence") >= 0.9)
        & (F.length("phrase") >= 4)
        & ~F.col("phrase").isin(*(blocklist or [""]))
    )
    return kept.groupBy("phrase").agg(F.min_by("intended", "row_no").alias("intended"))


# --------------------------------------------------------------------------- passages

WORD = r"[a-z0-9]+"


def shingles(words: Column, k: int = 5) -> Column:
    """Hashes of all 5-grams of a word column, in order."""
    return F.when(
        F.size(words) >= k,
        F.transform(
            F.sequence(F.lit(1), F.size(words) - k + 1),
            lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i, k))),
        ),
    )


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    a = sets.select("doc_id", F.col("set_id").alias("u"), F.col("s").alias("sa"))
    b = sets.select("doc_id", F.col("set_id").alias("v"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.distinct()
        .join(a, ["doc_id", "u"])
        .join(b, ["doc_id", "v"])
        .filter(both / (F.size("sa") + F.size("sb") - both) >= threshold)
        .select("u", "v")
    )


def _shared_shingles(sets: DataFrame) -> DataFrame:
    """(doc_id, first_block, n, g, df) of the shingles that several sets of a document have; all are shuffled once."""
    each = sets.select("doc_id", "first_block", F.size("s").alias("n"), F.explode("s").alias("g"))
    held = W.partitionBy("doc_id", "g")
    return each.withColumn("df", F.count(F.lit(1)).over(held)).filter("df > 1")


def duplicate_passages(
    blocks: DataFrame, min_tokens: int = 30, threshold: float = 0.9, min_members: int = 2
) -> DataFrame:
    """Clusters of near-identical blocks of a document.

    Equal shingle sets are merged first.  Two sets at Jaccard t share one of
    their rarest (1-t) shingles, which key the candidates.  Only clusters
    matter, so each key first links its members to its first set; members that
    are connected by then need no comparison, and the second round pairs only
    sets of different clusters.
    """
    worded = blocks.select("doc_id", "block_no", find_all(F.lower("text"), WORD).alias("w"))
    big = worded.filter(F.size("w") >= min_tokens).select(
        "doc_id", "block_no", F.array_sort(F.array_distinct(shingles(F.col("w")))).alias("s")
    )
    sets = written(
        big.groupBy("doc_id", F.xxhash64("s").alias("sig"), "s")
        .agg(F.count(F.lit(1)).alias("members"), F.min("block_no").alias("first_block"))
        .withColumn("set_id", F.concat_ws("/", "doc_id", "first_block"))
    )
    rare = (
        _shared_shingles(sets)
        .groupBy("doc_id", "first_block", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    )
    # Shingles of one set only come first in the order; they can match nothing.
    lone = F.col("n") - F.size("o")
    prefix = F.floor(F.col("n") * (1 - threshold) + 1e-9) + 1
    keys = written(
        rare.withColumn("take", F.greatest(prefix - lone, F.lit(0)).cast("int"))
        .filter("take > 0")
        .select("doc_id", "first_block", F.explode(F.slice("o", 1, F.col("take"))).alias("k"))
        .select("doc_id", F.concat_ws("/", "doc_id", "first_block").alias("set_id"), F.col("k.g").alias("g"))
    )
    first = keys.groupBy("doc_id", "g").agg(F.min("set_id").alias("u"))
    star = keys.join(first, ["doc_id", "g"]).select("doc_id", "u", F.col("set_id").alias("v")).filter("u <> v")
    edges = written(_similar(star, sets, threshold))
    nodes = sets.select(F.col("set_id").alias("node"))
    known = written(connected_components(nodes, edges))
    labelled = keys.join(known.select(F.col("node").alias("set_id"), "component"), "set_id")
    left = labelled.select("doc_id", "g", F.col("set_id").alias("u"), F.col("component").alias("cu"))
    right = labelled.select("doc_id", "g", F.col("set_id").alias("v"), F.col("component").alias("cv"))
    across = left.join(right, ["doc_id", "g"]).filter("cu < cv").select("doc_id", "u", "v")
    more = _similar(across, sets, threshold)
    final = connected_components(nodes, edges.unionByName(more))
    return (
        sets.join(final.select(F.col("node").alias("set_id"), "component"), "set_id")
        .groupBy("doc_id", "component")
        .agg(F.sum("members").alias("members"), F.min("first_block").alias("first_block"))
        .filter(F.col("members") >= min_members)
        .select(
            "doc_id",
            "first_block",
            "members",
            F.when(F.col("members") >= 3, "high").otherwise("medium").alias("severity"),
        )
    )


def copy_loops(
    blocks: DataFrame, min_tokens: int = 30, min_repeats: int = 2, k: int = 5
) -> DataFrame:
    """A 5-gram repeated at separate places of one block over a long span."""
    worded = blocks.select("doc_id", "block_no", find_all(F.lower("text"), WORD).alias("w"))
    grams = worded.filter(F.size("w") >= min_tokens).select(
        "doc_id", "block_no", F.posexplode(shingles(F.col("w"), k)).alias("pos", "g")
    )
    places = (
        grams.groupBy("doc_id", "block_no", "g")
        .agg(F.array_sort(F.collect_list("pos")).alias("p"))
        .filter(F.size("p") >= min_repeats)
    )
    chosen = F.aggregate(
        "p",
        F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n"), F.lit(-1).alias("start")),
        lambda s, p: F.when(
            p >= s["last"] + k,
            F.struct(
                p.alias("last"),
                (s["n"] + 1).alias("n"),
                F.when(s["start"] < 0, p).otherwise(s["start"]).alias("start"),
            ),
        ).otherwise(s),
    )
    rows = places.withColumn("c", chosen).withColumn("span", F.col("c.last") - F.col("c.start") + k)
    flagged = rows.filter((F.col("c.n") >= min_repeats) & (F.col("span") >= min_tokens))
    return (
        flagged.groupBy("doc_id", "block_no")
        .agg(
            F.min_by(F.struct(F.col("c.n").alias("repetitions"), "span"), F.col("p")[0]).alias("f"),
            F.count(F.lit(1)).alias("grams"),
        )
        .select(
            "doc_id",
            "block_no",
            F.col("f.repetitions").alias("repetitions"),
            F.col("f.span").alias("span"),
            "grams",
            F.when(F.col("f.repetitions") >= 4, "high")
            .when(F.col("f.repetitions") >= 3, "medium")
            .otherwise("low")
            .alias("severity"),
        )
    )


# --------------------------------------------------------------------------- statements


def compliance(docs: DataFrame) -> DataFrame:
    """Required statements that are present, with context, or missing."""
    text = F.col("text")
    plain = lambda p: p.replace("(?i)", "", 1)
    context = lambda p: find_all(text, r"(?is)(.{0,30}" + plain(p) + r".{0,30})")

    def contexts(p: str) -> Column:
        # The lead is tried at every character, so only texts that hold the statement are read for it.
        return F.when(~text.rlike("(?is)" + plain(p)), 0).otherwise(F.size(context(p)))

    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("category"),
                text.rlike(p).alias("present"),
                contexts(p).alias("contexts"),
            )
            for k, p in COMPLIANCE.items()
        ]
    )
    return docs.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


def missing_statements(docs: DataFrame) -> DataFrame:
    """Categories without a statement per document; contexts are not looked for."""
    absent = [F.when(~F.col("text").rlike(p), F.lit(k)) for k, p in COMPLIANCE.items()]
    missing = docs.select("doc_id", F.explode(F.array_compact(F.array(*absent))).alias("category"))
    return missing.groupBy("doc_id").agg(F.sort_array(F.collect_list("category")).alias("missing"))


# Where a byline ends, and the words before which it may start.
BYLINE_END = r"(?i)(?:^|\n)[ \t]*(?:\d+\.?[ \t]*)?(?:abstract|summary|introduction|background|keywords)\b"
CORRESPONDENCE = ("*CORRESPONDENCE", "CORRESPONDENCE", "CITATION")


def ascii_edges(pattern: str) -> str:
    """``pattern`` with word edges between ASCII word characters and all others, as SQL engines have them."""
    word = "[0-9A-Za-z_]"
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def before_body(text: Column) -> Column:
    """The text up to its abstract, introduction or first such heading; all of it without one."""
    return F.split(text, ascii_edges(BYLINE_END), 2)[0]


def byline_emails(docs: DataFrame) -> DataFrame:
    """E-mail checks of the byline, all text before the abstract or first heading."""
    found = docs.select(
        "doc_id", F.explode_outer(find_all(F.lower(before_body(F.col("text"))), EMAIL)).alias("email")
    )
    addresses = found.groupBy("doc_id", "email").agg(F.count("email").alias("c"))
    domains = addresses.withColumn("domain", F.substring_index("email", "@", -1))
    by_domain = domains.groupBy("doc_id", "domain").agg(
        F.sum("c").alias("c"),
        F.count_if(F.col("c") > 1).alias("repeated"),
    )
    per_doc = by_domain.groupBy("doc_id").agg(
        F.sum("c").alias("emails"),
        F.max("c").alias("top_domain"),
        F.sum("repeated").alias("duplicates"),
        F.sum(F.when(F.col("domain").isin(*FREE_MAIL), F.col("c")).otherwise(0)).alias("free_mail"),
    )
    n = F.col("emails")
    checks = F.array_compact(
        F.array(
            F.when(n == 0, F.lit("none")),
            F.when(F.col("duplicates") > 0, F.lit("duplicates")),
            F.when((F.col("top_domain") > n / 2) & (n >= 3), F.lit("one_domain")),
            F.when((F.col("free_mail") > 2) & (F.col("free_mail") > n / 2), F.lit("free_mail")),
        )
    )
    return per_doc.withColumn("checks", checks).withColumn(
        "severity",
        F.when(F.col("duplicates") > 0, "medium").when(F.size("checks") > 0, "low"),
    )


# Affiliation words, author names with index marks, plain author names, parts of other titles.
AFFILIATION = (
    r"(?i)\b(department of|university of|hospital|institute of|school of|college of|college|academy of|faculty of"
    r"|research center|research institute|center for|laboratory of|medical center|clinic of|school)\b"
)
NAME = r"[A-Z][A-Za-zÀ-ɏ'\-]+"
FIRST_AUTHOR = NAME + r"(?:\s+" + NAME + r"){0,3}\s*\d"
AUTHOR_PLACE = r"University|Institute|College|Hospital|Department"
INDEXED_AUTHOR = r"(?<![A-Za-z])(" + NAME + r"(?:\s+" + NAME + r"){1,3})\s*(\d{1,2}(?:\s*,\s*\d{1,2})*)"
PLAIN_AUTHOR = r"\b" + NAME + r"(?:\s+" + NAME + r"){1,3}(?:\s*[*,†‡]?\s*(?:\d{1,2})?\b)*"
NOT_AUTHOR = (
    "university", "department", "school of", "institute", "faculty", "hospital", "evidence", "efficiency",
    "countries", "financing", "retracted", "of technology", "of management", "of economics",
)
AUTHOR_GAP = 220


def byline(text: Column) -> Column:
    """The author block (T8): from the first indexed author before an affiliation, else from the
    correspondence note, else from the start; up to the abstract or first heading behind it."""
    at = F.regexp_instr(text, F.lit(FIRST_AUTHOR))
    behind = F.substring(text, at, F.length(text))
    lead = F.substring(text, F.greatest(at - 80, F.lit(1)), F.least(F.lit(80), at - 1))
    out = before_body(text)
    for marker in reversed(CORRESPONDENCE):
        note = F.instr(F.upper(text), marker)
        early = (note > 0) & (note - 1 < F.floor(F.length(text) / 2))
        out = F.when(early, before_body(F.substring(text, note, F.length(text)))).otherwise(out)
    return F.when((at > 0) & behind.rlike(AUTHOR_PLACE), F.concat(lead, before_body(behind))).otherwise(out)


def affiliations(text: Column) -> Column:
    """Distinct normalized affiliation phrases."""
    parts = F.filter(
        F.transform(F.split(text, r"[.\n]"), lambda c: F.trim(c)),
        lambda c: (F.length(c) >= 8) & (F.length(c) <= 400) & c.rlike(ascii_edges(AFFILIATION)),
    )
    norm = F.transform(
        parts,
        lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z\s]", " "), r"\s+", " ")),
    )
    return F.array_distinct(F.filter(norm, lambda c: F.length(c) >= 10))


def indexed_authors(block: Column) -> Column:
    """Distinct names with index marks that are no part of a title or affiliation."""
    names = F.transform(find_all(block, INDEXED_AUTHOR, 1), lambda x: F.regexp_replace(x, r"\s+", " "))
    is_title = lambda x: F.lower(x).rlike("|".join(NOT_AUTHOR))
    return F.array_distinct(F.filter(names, lambda x: (F.length(x) >= 4) & ~is_title(x)))


def plain_authors(block: Column) -> Column:
    """Names of the first list whose neighbours are at most 220 characters apart.

    What lies between two names is what splitting at names leaves, so gaps run from
    the end of one name to the start of the next, wherever names repeat.
    """
    pattern = ascii_edges(PLAIN_AUTHOR)
    names = F.size(find_all(block, pattern, 0))
    between = F.slice(F.split(block, pattern, -1), 2, F.greatest(names - 1, F.lit(0)))
    far = F.array_position(F.transform(between, lambda x: F.length(x) > AUTHOR_GAP), True)
    return F.when(far > 0, far).otherwise(names).cast("int")


def authorship(docs: DataFrame) -> DataFrame:
    """Authors, affiliations, their ratio and stacked index marks."""
    region = docs.select("doc_id", byline(F.col("text")).alias("b"))
    marks = find_all(F.col("b"), INDEXED_AUTHOR, 2)
    indexed = F.size(indexed_authors(F.col("b")))
    counted = region.select(
        "doc_id",
        F.when(indexed > 0, indexed).otherwise(plain_authors(F.col("b"))).alias("authors"),
        F.size(affiliations(F.col("b"))).alias("affiliations"),
        F.size(F.filter(marks, lambda x: F.size(F.split(x, ",")) >= 3)).alias("stacked_authors"),
    )
    n, stacked = F.col("authors"), F.col("stacked_authors")
    ratio = F.when((n > 0) & (F.col("affiliations") > 0), F.col("affiliations") / n)
    severity = (
        F.when((n >= 15) & (ratio <= 0.25), "high")
        .when(((n >= 8) & (ratio <= 0.35)) | ((n >= 6) & (ratio <= 0.30)), "medium")
        .when((n >= 4) & (ratio <= 0.40), "low")
    )
    stacking = F.when(
        (stacked >= 1) & ((n >= 3) | (stacked >= 2)),
        F.when((stacked >= 2) | (n >= 4), "medium").otherwise("low"),
    )
    return (
        counted.withColumn("ratio", F.round(ratio, 6))
        .withColumn("severity", severity)
        .withColumn("stacking_severity", stacking)
    )


# The reviewer block, what is no name in it, and what a name looks like.
REVIEWER_BLOCK = r"(?is)(reviewed by.*?)(?:correspondence|specialty section|received |citation|\z)"
NOT_A_REVIEWER = (
    r"(?i)university|institute|laboratory|college|department|reviewed by|china|united kingdom|usa|reviewer"
)
REVIEWER = r"^[A-Z][A-Za-zÀ-ɏ'\-]+(?:\s+[A-Z][A-Za-zÀ-ɏ'\-]+){0,3}$"


def thin_review(docs: DataFrame) -> DataFrame:
    """Retracted papers naming one to three reviewers."""
    block = F.regexp_extract("text", REVIEWER_BLOCK, 1)
    lines = F.transform(F.split(block, r"[\n,]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    names = F.filter(
        lines, lambda x: F.length(x).between(5, 60) & ~x.rlike(NOT_A_REVIEWER) & x.rlike(REVIEWER)
    )
    return (
        docs.filter(F.col("text").rlike(r"(?i)retracted"))
        .select("doc_id", F.size(names).alias("reviewers"))
        .filter("reviewers BETWEEN 1 AND 3")
    )


def headings(blocks: DataFrame) -> DataFrame:
    """Section headings, first occurrence of each."""
    line = F.trim("text")
    name = F.trim(F.regexp_extract(line, HEADING, 1))
    norm = F.regexp_replace(F.lower(F.regexp_replace(name, ":+$", "")), r"\s+", " ")
    return (
        blocks.filter((F.length(line) > 0) & (F.length(line) <= 100))
        .select("doc_id", "block_no", name.alias("heading"), norm.alias("norm"))
        .filter("heading <> ''")
        .groupBy("doc_id", "norm")
        .agg(F.min_by("heading", "block_no").alias("heading"), F.min("block_no").alias("block_no"))
    )


def odd_headings(blocks: DataFrame) -> DataFrame:
    """Template headings of a document."""
    pairs = [F.lit(v) for item in HEADINGS.items() for v in item]
    standard = F.try_element_at(F.create_map(*pairs), F.col("norm"))
    return (
        headings(blocks)
        .withColumn("standard", standard)
        .filter("standard IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("odd_headings"))
        .withColumn(
            "severity",
            F.when(F.col("odd_headings") >= 3, "high")
            .when(F.col("odd_headings") >= 2, "medium")
            .otherwise("low"),
        )
    )


# --------------------------------------------------------------------------- references


def references(blocks: DataFrame) -> DataFrame:
    """Reference lines: numbered, with a DOI, or with a year and longer than 30."""
    line = F.trim("text")
    return blocks.select("doc_id", "block_no", line.alias("ref")).filter(
        (F.col("ref") != "")
        & (
            F.col("ref").rlike(REFERENCE_START)
            | F.col("ref").rlike(DOI)
            | (F.col("ref").rlike(YEAR) & (F.length("ref") > 30))
        )
    )


def reference_style(ref: Column) -> Column:
    """Style label from title quotes, year, parentheses and semicolons."""
    quoted, year = ref.rlike(QUOTED_TITLE), ref.rlike(YEAR)
    parens = ref.contains("(") & ref.contains(")")
    semicolon = ref.contains(";")
    return (
        F.when(quoted & parens & ~semicolon, "chicago")
        .when(~quoted & year & semicolon, "vancouver")
        .when(~quoted & year, "ieee")
        .when(year & F.substring(ref, 1, 20).contains(","), "apa")
        .otherwise("unknown")
    )


def reference_styles(refs: DataFrame) -> DataFrame:
    """Distinct styles per document; three or more are an anomaly."""
    return (
        refs.groupBy("doc_id", reference_style(F.col("ref")).alias("style"))
        .agg(F.count(F.lit(1)).alias("refs"))
        .groupBy("doc_id")
        .agg(
            F.sum("refs").alias("refs"),
            F.count_if(F.col("style") != "unknown").alias("styles"),
        )
        .withColumn("severity", F.when(F.col("styles") >= 3, "medium"))
    )


def identifiers(ref: Column) -> Column:
    """DOI, PMID and arXiv keys of a reference."""
    dois = F.transform(find_all(ref, DOI), lambda d: F.concat(F.lit("doi:"), F.regexp_replace(d, "[.,;]+$", "")))
    pmids = F.transform(find_all(ref, PMID, 1), lambda d: F.concat(F.lit("pmid:"), d))
    arxiv = F.transform(find_all(ref, ARXIV, 1), lambda d: F.concat(F.lit("arxiv:"), d))
    return F.concat(dois, pmids, arxiv)


def surname(ref: Column) -> Column:
    """First author's surname: the first capitalized word after the number."""
    return F.lower(F.regexp_extract(F.regexp_replace(ref, r"^(\[\d+\]|\d+[.)])\s*", ""), r"([A-Z][A-Za-z'\-]+)", 1))


def conflicting_references(refs: DataFrame) -> DataFrame:
    """References of one identifier that disagree with its first one.

    The first conflict in reading order is reported.
    """
    keyed = refs.select("doc_id", "block_no", "ref", F.explode(identifiers(F.col("ref"))).alias("id"))
    base = keyed.groupBy("doc_id", "id").agg(F.min(F.struct("block_no", "ref")).alias("base"))
    years = lambda r: find_all(r, YEAR, 1)
    norm = lambda r: F.lower(F.regexp_extract(r, QUOTED_TITLE, 1))
    later = keyed.join(base, ["doc_id", "id"]).filter("block_no > base.block_no")
    a, b = F.col("base.ref"), F.col("ref")
    conflict = (
        F.when((F.size(years(a)) > 0) & (F.size(years(b)) > 0) & (years(a) != years(b)), "year")
        .when((surname(a) != "") & (surname(b) != "") & (surname(a) != surname(b)), "surname")
        .when((norm(a) != "") & (norm(b) != "") & (norm(a) != norm(b)), "title")
    )
    return (
        later.withColumn("conflict", conflict)
        .filter("conflict IS NOT NULL")
        .groupBy("doc_id", "id")
        .agg(F.min(F.struct("block_no", "conflict")).alias("c"))
        .select(
            "doc_id",
            "id",
            F.col("c.conflict").alias("conflict"),
            F.when(F.col("c.conflict") == "title", "low").otherwise("high").alias("severity"),
        )
    )


CITATION = (
    r"[\[(]\s*([A-Z][A-Za-z\-']+(?:\s+(?:and|et\s+al\.?)\s+[A-Z][A-Za-z\-']+)?)(?:,)?(?:\s+(?:et\s+al\.?))?"
    r"[,\s]?\s*(\d{4})[a-z]?\s*[\])]"
)
NUMERIC_CITATION = r"\[\d{1,3}(?:\s*[,–-]\s*\d{1,3})*\]"


def citations(blocks: DataFrame) -> DataFrame:
    """Distinct in-text citations with author and year where given."""
    text = F.col("text")
    whole, who, when = (find_all(text, CITATION, g) for g in (0, 1, 2))
    named = F.transform(
        F.arrays_zip(whole.alias("raw"), who.alias("author"), when.alias("year")),
        lambda z: F.struct(z["raw"].alias("raw"), z["author"].alias("author"), z["year"].alias("year")),
    )
    numeric = F.transform(
        find_all(text, NUMERIC_CITATION),
        lambda r: F.struct(r.alias("raw"), F.lit("").alias("author"), F.lit("").alias("year")),
    )
    return (
        blocks.select("doc_id", "block_no", F.explode(F.concat(named, numeric)).alias("c"))
        .groupBy("doc_id", F.col("c.raw").alias("raw"))
        .agg(F.min_by("c", "block_no").alias("c"), F.min("block_no").alias("block_no"))
        .select("doc_id", "raw", F.col("c.author").alias("author"), F.col("c.year").alias("year"), "block_no")
    )


# --------------------------------------------------------------------------- availability

# Headings of the section, what ends it, and its empty answer.
SECTION_START = (
    r"(?i)(?:^|\n|\.\s+|\?\s+| +)(?<![A-Za-z0-9])(?:\d+(?:\.\d+)?\.?\s+)?"
    r"(?:data availability(?:\s+statement)?|data sharing|data deposition|availability of data|"
    r"data and materials availability|availability of materials|raw data availability|"
    r"availability of data and materials|data availability statement|open research|"
    r"resource availability|code and data availability)(?=[:.\n\s]|$)"
)
SECTION_END = r"\n\s*(?:[A-Z][A-Z\s]{4,}|\d+\.\s+[A-Z][a-z]+)"
NOT_APPLICABLE = r"(?i)\bnot applicable\b"


def availability_section(text: Column) -> Column:
    """Text behind the availability heading up to the next heading."""
    heading = F.regexp_extract(text, SECTION_START, 0)
    at = F.regexp_instr(text, F.lit(SECTION_START))
    tail = F.when(at > 0, F.substring(text, at + F.length(heading), F.length(text)))
    end = F.regexp_instr(tail, F.lit(SECTION_END))
    return F.when(end > 0, F.substring(tail, F.lit(1), end - 1)).otherwise(tail)


def availability_flags(docs: DataFrame) -> DataFrame:
    """Red flags by category, in the section or, without one, in the whole text.

    A section that starts with "not applicable" and a missing section in a long
    text are flags of their own.
    """
    sections = docs.select(
        "doc_id",
        availability_section(F.col("text")).alias("section"),
        "text",
        F.size(F.split(F.trim("text"), r"\s+")).alias("words"),
    )
    rows = [
        F.when(
            F.coalesce("section", "text").rlike(p), F.struct(F.lit(k).alias("category"), F.lit(s).alias("severity"))
        )
        for k, (s, p) in AVAILABILITY_FLAGS.items()
    ]
    rows.append(
        F.when(
            F.substring("section", 1, 250).rlike(NOT_APPLICABLE),
            F.struct(F.lit("not_applicable").alias("category"), F.lit("low").alias("severity")),
        )
    )
    rows.append(
        F.when(
            F.col("section").isNull() & (F.col("words") > 2000),
            F.struct(F.lit("missing_section").alias("category"), F.lit("low").alias("severity")),
        )
    )
    return sections.select("doc_id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select(
        "doc_id", "r.*"
    )


def statement_links(docs: DataFrame) -> DataFrame:
    """URLs of the availability section, once each."""
    section = availability_section(F.col("text"))
    return docs.select(
        "doc_id",
        F.explode(
            F.array_distinct(
                F.transform(find_all(section, URL), lambda u: F.regexp_replace(u, "[.,;]+$", ""))
            )
        ).alias("url"),
    )


# --------------------------------------------------------------------------- search, pages, redaction


def search(docs: DataFrame, pattern: str, *, regex: bool = False, ignore_case: bool = True) -> DataFrame:
    """Matching lines with their numbers."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    if regex:
        return lines.filter(F.col("line").rlike(("(?i)" if ignore_case else "") + pattern))
    if ignore_case:
        return lines.filter(F.contains(F.lower("line"), F.lit(pattern.lower())))
    return lines.filter(F.contains("line", F.lit(pattern)))


def note_fields(notes: DataFrame) -> DataFrame:
    """Front matter, title and inline tags of notes (T26): ``notes(doc_id, text)``."""
    front = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---", 1)
    title = F.coalesce(
        F.nullif(F.trim(F.regexp_extract(front, r"(?m)^title:\s*(.+)$", 1)), F.lit("")),
        F.nullif(F.trim(F.regexp_extract("text", r"(?m)^#\s+(.+)$", 1)), F.lit("")),
    )
    tags = F.array_distinct(
        F.transform(find_all(F.col("text"), r"(?:^|\s)#([A-Za-z][\w/-]*)", 1), lambda t: F.lower(t))
    )
    return notes.select("doc_id", front.alias("front_matter"), title.alias("title"), tags.alias("tags"))


def html_text(html: Column) -> Column:
    """Page text without scripts, styles and tags, single spaces."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


# Redaction patterns and always-sensitive keys.
REDACTIONS = (
    (r"(?:[A-Za-z]:[\\/])?(?:Users|home|root|var)[\\/][A-Za-z0-9._-]+", "<redacted:user_home>"),
    (
        r"(?:sk-[A-Za-z0-9]{16,}|sk-ant-[A-Za-z0-9-]{16,}|ghp_[A-Za-z0-9]{16,}|gho_[A-Za-z0-9]{16,}"
        r"|xox[abprs]-[A-Za-z0-9-]{8,}|ANTHROPIC_API_KEY=[A-Za-z0-9-]{16,}|OPENAI_API_KEY=[A-Za-z0-9-]{16,})",
        "<redacted:api_key>",
    ),
    (r"(-p|--password|--api-key|--token)(\s+)[^\s'\";&|<>]+", "$1$2<redacted:password>"),
    (r"Bearer\s+[A-Za-z0-9._-]{8,}", "<redacted:bearer_token>"),
    (
        r"(?i)((?:api[_-]?key|access[_-]?token|auth[_-]?token|secret|client[_-]?secret|private[_-]?key)\s*[=:]\s*)"
        r"['\"]?[A-Za-z0-9._+/-]{8,}['\"]?",
        "$1<redacted:api_key>",
    ),
)
SENSITIVE_KEYS = (
    "api_key", "apikey", "api-key", "access_token", "access-token", "auth_token", "auth-token",
    "password", "passwd", "secret", "client_secret", "private_key", "token", "bearer",
)


def redacted(text: Column) -> Column:
    """Text without home folders, keys, passwords and tokens."""
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def redacted_map(values: Column) -> Column:
    """Sensitive keys lose their value, other values are redacted as text."""
    return F.transform_values(
        values,
        lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit("<redacted:api_key>")).otherwise(
            redacted(v)
        ),
    )


def sentences(text: Column) -> Column:
    """Sentences ending in . ! or ? before a capital or digit."""
    return F.filter(
        F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9(])"), lambda s: F.trim(s)), lambda s: s != ""
    )


def recent(df: DataFrame, ts: str, limit: int, prefix: str | None = None) -> DataFrame:
    """The newest rows, optionally under a path prefix (K6)."""
    if prefix is not None:
        df = df.filter(F.col("path").startswith(prefix))
    return df.orderBy(F.col(ts).desc()).limit(limit)
