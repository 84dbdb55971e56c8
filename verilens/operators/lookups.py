"""Joins to provided reference tables and document metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import numbers as N


# --------------------------------------------------------------------------- citations and links


def work_key(author: Column, year: Column) -> Column:
    """``lower(first author) year``."""
    return F.concat_ws(" ", F.lower(F.regexp_extract(author, r"^([A-Za-z'\-]+)", 1)), year.cast("string"))


def verify_citations(citations: DataFrame, works: DataFrame) -> DataFrame:
    """Score citations against provided works.

    ``works(key, title, year, authors ARRAY)``, one row per key; ``citations``
    carry raw, author, year.
    """
    named = citations.filter("author <> ''").withColumn("key", work_key(F.col("author"), F.col("year")))
    w = works.select("key", "title", F.col("year").alias("w_year"), "authors", F.lit(True).alias("_known"))
    joined = named.join(w, "key", "left")
    surname = F.lower(F.split("author", r"\s+")[0])
    author_ok = F.exists(F.transform("authors", lambda a: F.lower(a)), lambda a: F.contains(a, surname))
    year_ok = F.abs(F.col("year").try_cast("int") - F.col("w_year")) <= 1
    tokens = F.filter(
        F.regexp_extract_all("raw", F.lit("[A-Za-z]+"), 0), lambda t: F.length(t) > 4
    )
    title_ok = F.exists(tokens, lambda t: F.contains(F.lower("title"), F.lower(t)))
    as_int = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = as_int(author_ok) + as_int(year_ok) + as_int(title_ok)
    acronym = F.split("author", r"\s+")[0].rlike("^[A-Z]{2,}$")
    known = F.coalesce("_known", F.lit(False))
    status = (
        F.when(~known & acronym, "grey_literature")
        .when(~known, "not_found")
        .when(F.col("score") < 2, "mismatch")
        .otherwise("match")
    )
    return (
        joined.withColumn("score", score)
        .withColumn("status", status)
        .select(
            "doc_id", "raw", "author", "year", "score", "status",
            F.when(F.col("status") == "mismatch", "high")
            .when(F.col("status").isin("not_found", "grey_literature"), "info")
            .alias("severity"),
        )
    )


def normalized_doi(text: Column) -> Column:
    """Lower-case DOI without resolver prefix and trailing punctuation."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")
    return F.regexp_replace(bare, r"[.,;)\]]+$", "")


def cited_retractions(dois: DataFrame, retracted: DataFrame) -> DataFrame:
    """All cited DOIs that are retracted (J21): ``dois(doc_id, doi, position)``."""
    first = dois.withColumn("doi", normalized_doi(F.col("doi"))).groupBy("doc_id", "doi").agg(
        F.min("position").alias("position")
    )
    known = retracted.filter("is_retracted").select(normalized_doi(F.col("doi")).alias("doi"), "title").dropDuplicates(["doi"])
    return first.join(known, "doi").withColumn("severity", F.lit("high"))


def link_findings(links: DataFrame, status: DataFrame) -> DataFrame:
    """Availability links against provided link states."""
    joined = links.join(status.select("url", "status"), "url", "left")
    state = F.coalesce("status", F.lit("unknown"))
    return joined.select(
        "doc_id",
        "url",
        state.alias("status"),
        F.when(state.isin("not_found", "dead_page"), "medium").when(state.isin("error", "unknown"), "info").alias("severity"),
    )


def stale_entries(keys: DataFrame, cache: DataFrame, now: float, ttl: float, offline: bool = False) -> DataFrame:
    """Cache state of each key: fresh, stale or missing (J23): ``cache(key, ts)``."""
    joined = keys.join(cache.select("key", "ts", F.lit(True).alias("_hit")), "key", "left")
    old = F.col("ts").isNull() | F.lit(ttl == 0) | (F.lit(now) - F.col("ts") > ttl)
    hit = F.coalesce("_hit", F.lit(False))
    return joined.select(
        "key",
        F.when(~hit, "missing").when(F.lit(offline), "fresh").when(old, "stale").otherwise("fresh").alias("state"),
    )


# --------------------------------------------------------------------------- numbers on two sides


def multiset_missing(query: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """Share of query numbers the reference does not hold, counted as multisets.

    Equal values at 4 decimals are used up first, then what is left at 3 and
    at 2 decimals; counts are compared, values are never paired one by one.
    ``query`` and ``reference`` carry ``keys`` and ``num``.
    """
    total = query.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    left = query.groupBy(*keys, "num").agg(F.count(F.lit(1)).alias("q"))
    right = reference.groupBy(*keys, "num").agg(F.count(F.lit(1)).alias("r"))
    at4 = lambda df, c: df.groupBy(*keys, F.bround("num", 4).alias("k4")).agg(F.sum(c).alias(c))
    unused = (
        F.greatest(F.col("q") - F.col("r"), F.lit(0)).alias("q"),
        F.greatest(F.col("r") - F.col("q"), F.lit(0)).alias("r"),
    )
    both = at4(left, "q").join(at4(right, "r"), [*keys, "k4"], "full").na.fill(0, ["q", "r"])
    # Coarser keys come from the 4-decimal value, never from a rounded one.
    rest = both.select(*keys, F.bround("k4", 3).alias("k3"), F.bround("k4", 2).alias("k2"), *unused)
    for key, kept in (("k3", ["k2"]), ("k2", [])):
        grouped = rest.groupBy(*keys, key).agg(
            F.sum("q").alias("q"), F.sum("r").alias("r"), *[F.min(k).alias(k) for k in kept]
        )
        rest = grouped.select(*keys, *kept, *unused)
    missing = rest.groupBy(*keys).agg(F.sum("q").alias("missing"))
    return (
        total.join(missing, keys, "left")
        .withColumn("missing", F.coalesce("missing", F.lit(0)).cast("long"))
        .withColumn("fraction", F.col("missing") / F.col("n"))
    )


def source_consistency(pdf: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Printed numbers against source data per figure, both ways."""
    forward = multiset_missing(pdf, source, keys)
    back = multiset_missing(source, pdf, keys).select(
        *keys, F.col("missing").alias("unused"), F.col("fraction").alias("unused_fraction")
    )
    joined = forward.join(back, keys)
    miss = (F.col("fraction") >= 0.35) & (F.col("missing") >= 10)
    inverse = (F.col("unused_fraction") >= 0.55) & (F.col("unused") >= 30)
    return joined.withColumn(
        "severity",
        F.when(miss & (F.col("fraction") >= 0.65), "high").when(miss, "medium").when(inverse, "low"),
    )


def figure_key(text: Column) -> Column:
    """``fig3``, ``figs2`` or ``edfig1`` of a label."""
    extended = F.regexp_extract(text, r"(?i)extended\s*data\s*fig(?:ure)?\.?[_\s-]*(\d+[a-z]?)", 1)
    tag = F.lower(F.regexp_extract(text, r"(?i)fig(?:ure)?\.?[_\s-]*(s?\d+[a-z]?)", 1))
    return (
        F.when(extended != "", F.concat(F.lit("edfig"), F.lower(extended)))
        .when(tag.startswith("s"), F.concat(F.lit("figs"), F.substring(tag, F.lit(2), F.length(tag))))
        .when(tag != "", F.concat(F.lit("fig"), tag))
    )


def nearest_percent_gap(sentences: DataFrame, labels: DataFrame, gap: float = 2.0) -> DataFrame:
    """Row labels named in a sentence whose nearest percentage differs.

    ``sentences(doc_id, sentence_no, text)``, ``labels(doc_id, label, value)``.
    Labels meet sentences through their first word, then by containment.
    """
    word = lambda c: F.regexp_extract(F.lower(c), r"([a-z0-9]+)", 1)
    words = sentences.select(
        "doc_id", "sentence_no", F.lower("text").alias("text"),
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))).alias("w"),
    )
    named = labels.select("doc_id", F.lower("label").alias("label"), "value", word(F.col("label")).alias("w"))
    met = words.join(named, ["doc_id", "w"]).filter(F.col("text").contains(F.col("label")))
    at = F.instr(F.col("text"), F.col("label"))
    percents = F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d+)?)\s?%"), 1)
    spots = F.transform(
        percents,
        lambda p: F.struct(F.abs(F.instr(F.col("text"), p) - at).alias("away"), p.cast("double").alias("pct")),
    )
    rows = met.withColumn("near", F.array_min(spots)).filter("near IS NOT NULL")
    delta = F.abs(F.col("near.pct") - F.col("value"))
    return rows.withColumn("delta", delta).filter(F.col("delta") > gap).select(
        "doc_id", "sentence_no", "label", "value", F.col("near.pct").alias("pct"), "delta",
        F.when(F.col("delta") >= 10, "high").otherwise("medium").alias("severity"),
    )


def percent_overlap(
    prose: DataFrame, table: DataFrame, tol: int = 2, top: int | None = None
) -> DataFrame:
    """Documents whose prose percentages are far from every table value.

    ``prose(doc_id, pct)``, ``table(doc_id, pct)``; values are whole buckets, so
    the range join is an equi-join on the 2*tol+1 neighbouring buckets.  ``top``
    ranks: only that many of a document's commonest buckets are looked at.
    """
    bucket = lambda: F.bround("pct", 0).cast("int")
    prose_counts = prose.groupBy("doc_id", bucket().alias("b")).agg(F.count(F.lit(1)).alias("c"))
    best = prose_counts
    if top is not None:
        order = W.partitionBy("doc_id").orderBy(F.col("c").desc(), "b")
        best = best.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).drop("_r")
    near = (
        table.select("doc_id", bucket().alias("b")).distinct()
        .select("doc_id", F.explode(F.sequence(F.col("b") - tol, F.col("b") + tol)).alias("b"))
        .distinct()
        .withColumn("_hit", F.lit(1))
    )
    scored = best.join(near, ["doc_id", "b"], "left").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("buckets"), F.coalesce(F.sum("_hit"), F.lit(0)).alias("matched")
    )
    return scored.join(table.select("doc_id").distinct(), "doc_id", "left_semi").withColumn(
        "fires", F.col("matched") == 0
    )


def nearest_caption(captions: DataFrame, tables: DataFrame, max_gap: int = 120) -> DataFrame:
    """Caption closest above each table of its page.

    ``captions(doc_id, page, caption, bottom, left, right)``,
    ``tables(doc_id, page, table_id, top, left, right)``.
    """
    c = captions.select("doc_id", "page", "caption", "bottom", F.col("left").alias("c_l"), F.col("right").alias("c_r"))
    gap = F.col("top") - F.col("bottom")
    overlap = (F.least("right", "c_r") > F.greatest("left", "c_l")).cast("int")
    return (
        tables.join(c, ["doc_id", "page"])
        .withColumn("gap", gap)
        .filter(F.col("gap").between(0, max_gap))
        .groupBy("doc_id", "page", "table_id")
        .agg(F.min(F.struct((1 - overlap).alias("o"), "gap", "caption")).alias("best"))
        .select("doc_id", "page", "table_id", F.col("best.caption").alias("caption"), F.col("best.gap").alias("gap"))
    )


def with_companions(images: DataFrame, companions: DataFrame) -> DataFrame:
    """Images of supplementary files behind the paper's own pages."""
    return images.unionByName(companions.withColumn("page", F.col("page") + 10000))


# --------------------------------------------------------------------------- metadata

# Metadata vocabularies.
SUSPICIOUS_PRODUCERS = (
    "itext", "itextpdf", "cvbuilder", "paper-factory", "academic-template", "sci-paper-generator",
)
AI_FINGERPRINTS = {
    "midjourney": "high",
    "stable diffusion": "high",
    "comfyui": "high",
    "dall-e": "high",
    "dall·e": "high",
    "firefly": "high",
    "leonardo.ai": "medium",
    "ideogram": "medium",
    "novelai": "medium",
    "krea.ai": "medium",
    "trainedalgorithmicmedia": "high",
    "c2pa": "medium",
    "content credentials": "medium",
}
PROMPT_WORDS = (
    r"(?i)\b(8k|4k|uhd|hdr|photorealistic|hyper-realistic|cinematic lighting|octane render|unreal engine"
    r"|trending on artstation|by greg rutkowski|by wlop)\b"
)
SUSPICIOUS_EXTENSIONS = ("exe", "bat", "cmd", "js", "vbs", "scr", "msi", "dll", "ps1", "sh")


def metadata_rules(meta: DataFrame) -> DataFrame:
    """Rules on document metadata.

    ``meta(doc_id, title, author, producer, creator, subject, creation_date,
    mod_date, embedded, scripts)``.
    """
    made, changed = N.pdf_date(F.col("creation_date")), N.pdf_date(F.col("mod_date"))
    tool = F.lower(F.concat_ws(" ", "producer", "creator"))
    listed = F.exists(F.array(*[F.lit(x) for x in SUSPICIOUS_PRODUCERS]), lambda x: F.contains(tool, x))
    row = lambda gate, check, severity: F.when(
        F.coalesce(gate, F.lit(False)), F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"))
    )
    checks = F.array_compact(
        F.array(
            row(listed, "suspicious_producer", "medium"),
            row(changed < made, "modified_before_created", "high"),
            row(F.datediff(changed, made) > 365, "modified_late", "low"),
            row(F.trim(F.coalesce("author", F.lit(""))) == "", "empty_author", "low"),
            row(F.upper("title").contains("RETRACTED"), "retracted_title", "high"),
            row(tool.contains("tex") & (F.length("subject") > 200), "long_subject_under_tex", "low"),
            row(F.col("embedded") > 0, "embedded_files", "low"),
            row(F.col("scripts") > 0, "scripts", "medium"),
        )
    )
    return meta.select("doc_id", F.explode(checks).alias("c")).select("doc_id", "c.*")


def ai_fingerprints(meta: DataFrame) -> DataFrame:
    """Image-generator names and prompt tokens in metadata values (T23): ``meta(doc_id, field, value)``."""
    text = F.lower("value")
    named = F.array_compact(
        F.array(
            *[
                F.when(text.contains(k), F.struct(F.lit(k).alias("tool"), F.lit(v).alias("severity")))
                for k, v in AI_FINGERPRINTS.items()
            ]
        )
    )
    scored = meta.withColumn("hits", named).withColumn("prompt", F.col("value").rlike(PROMPT_WORDS))
    return scored.filter((F.size("hits") > 0) | F.col("prompt")).select(
        "doc_id",
        "field",
        F.transform("hits", lambda h: h["tool"]).alias("tools"),
        "prompt",
        F.when(F.exists("hits", lambda h: h["severity"] == "high"), "high").otherwise("medium").alias("severity"),
    )


SUPPLEMENT = r"(?i)\b(supplementary (?:material|information|data|file|table|figure)s?|supporting information|additional file)\b"


def supplements(docs: DataFrame, attachments: DataFrame) -> DataFrame:
    """Supplements that are claimed but absent, odd extensions, total size."""
    files = attachments.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size_bytes").alias("bytes"),
        F.count_if(F.lower("ext").isin(*SUSPICIOUS_EXTENSIONS)).alias("suspicious"),
    )
    joined = docs.select("doc_id", F.col("text").rlike(SUPPLEMENT).alias("claimed")).join(files, "doc_id", "left").na.fill(
        0, ["files", "bytes", "suspicious"]
    )
    return joined.withColumn(
        "severity",
        F.when(F.col("suspicious") > 0, "high").when(F.col("claimed") & (F.col("files") == 0), "medium"),
    )


def file_fingerprints(files: DataFrame) -> DataFrame:
    """Three or more spreadsheets with one creator and creation time."""
    return (
        files.filter("creator IS NOT NULL AND created IS NOT NULL")
        .groupBy("doc_id", "creator", "created")
        .agg(F.count(F.lit(1)).alias("files"))
        .filter("files >= 3")
    )


# --------------------------------------------------------------------------- applicability

NEEDS = {
    "table_relationships": "has_tables",
    "table_benford": "has_tables",
    "image_dup": "has_images",
    "ref_duplicate": "has_references",
    "text_patterns": "has_text",
    "compliance": "has_text",
}


def applicable(docs: DataFrame) -> DataFrame:
    """(doc, detector, skip reason) from per-document feature flags."""
    rows = [
        F.struct(F.lit(k).alias("detector"), F.when(~F.col(v), F.lit("no_" + v[4:])).alias("skip"))
        for k, v in NEEDS.items()
    ]
    return docs.select("doc_id", F.explode(F.array(*rows)).alias("r")).select("doc_id", "r.*")


def select_tables(df: DataFrame, table_ids: list[int] | None) -> DataFrame:
    """Restrict to tables; no list keeps all."""
    return df if not table_ids else df.filter(F.col("table_id").isin(table_ids))
