"""Positions, lags and order statistics that never put one hot group in one task.

A plain ``row_number() over (partition by table, col)`` sorts a whole column in
a single task.  Here a column is first cut into chunks by its row index (or by
the magnitude of its values), windows run inside a chunk, and only the small
chunk totals are cumulated per column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

ROW_CHUNK = 1 << 20
BLOCK = 1 << 16
#: Distinct values of one bucket above which it is split again, and the parts it is split into.
FULL = 1 << 16
PARTS = 128


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    pos: str = "pos",
    total: str = "n",
    chunk_size: int = ROW_CHUNK,
    deal: Sequence[str] = (),
    below: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its group and the group size.

    ``order`` must be an integer column that is unique inside a group.  The
    output keeps ``_chunk``, usable as a skew-free extra join key.  With ``deal``,
    some of the keys, all groups of a chunk lie in one task (by ``deal`` and ``_chunk``),
    and ``_loose`` tells whether positions of a chunk may go on in another one: its
    groups begin at different positions.  Without ``deal``, positions may be asked for
    ``below`` a number only; rows that cannot have one are then left out before the shuffle.
    """
    keys = list(keys)
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk_size)).cast("long"))
    offsets = _offsets(chunked, keys, total)
    if deal:
        return _dealt_positions(chunked, offsets, keys, order, pos, total, list(deal))
    inside = W.partitionBy(*keys, "_chunk").orderBy(order)
    ranked = chunked.withColumn("_rn", F.row_number().over(inside))
    if below is not None:
        ranked = ranked.filter(F.col("_rn") <= below)
    # Both sides lie by the window's keys; rows behind an explode are too many for the broadcast their estimate allows.
    return (
        ranked.hint("merge")
        .join(offsets, [*keys, "_chunk"])
        .withColumn(pos, F.col("_offset") + F.col("_rn") - 1)
        .drop("_rn", "_offset")
        .filter(F.lit(True) if below is None else F.col(pos) < below)
    )


def _offsets(chunked: DataFrame, keys: list[str], total: str) -> DataFrame:
    """How many rows of a group lie before each of its chunks, and in all of them."""
    counts = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_cnt"))
    per_key = W.partitionBy(*keys)
    return counts.select(
        *keys,
        "_chunk",
        (F.sum("_cnt").over(per_key.orderBy("_chunk")) - F.col("_cnt")).alias("_offset"),
        F.sum("_cnt").over(per_key).alias(total),
    )


def _heads(offsets: DataFrame, deal: list[str]) -> DataFrame:
    """``offsets`` with ``_loose``: whether groups of a chunk begin at different positions."""
    span = W.partitionBy(*deal, "_chunk")
    uneven = F.max("_offset").over(span) > F.min("_offset").over(span)
    heads = offsets.withColumn("_uneven", uneven).withColumn("_loose", F.max("_uneven").over(W.partitionBy(*deal)))
    return heads.drop("_uneven")


def _dealt_positions(
    chunked: DataFrame, offsets: DataFrame, keys: list[str], order: str, pos: str, total: str, deal: list[str]
) -> DataFrame:
    """Positions where the offset of a chunk is the first row of its window, not a joined one."""
    rows = chunked.unionByName(_heads(offsets, deal), allowMissingColumns=True).repartition(*deal, "_chunk")
    return _behind_heads(rows, keys, order, pos, total)


def _behind_heads(rows: DataFrame, keys: list[str], order: str, pos: str, total: str) -> DataFrame:
    inside = W.partitionBy(*keys, "_chunk").orderBy(F.col(order).asc_nulls_first())
    return (
        rows.withColumn("_rn", F.row_number().over(inside))
        .withColumn("_offset", F.first("_offset").over(inside))
        .withColumn(total, F.first(total).over(inside))
        .withColumn("_loose", F.first("_loose").over(inside))
        .filter("_rn > 1")
        .withColumn(pos, F.col("_offset") + F.col("_rn") - 2)
        .drop("_rn", "_offset")
    )


def row_positions(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    cells_of: Callable[[DataFrame], DataFrame],
    *,
    deal: Sequence[str],
    pos: str = "pos",
    total: str = "n",
    chunk_size: int = ROW_CHUNK,
) -> DataFrame:
    """``with_positions`` with ``deal`` for rows whose cells lie in ``items``, which are shuffled as they are.

    ``items`` holds structs with the keys that are not in ``deal``.  ``cells_of`` takes
    single cells and keeps those that count; it runs on either side of the shuffle.  Rows
    are shuffled field by field, texts as one JSON string, which takes a fraction of what
    as many structs do.  The offsets of a chunk travel as one more row of it.
    """
    keys, deal = list(keys), list(deal)
    own = [k for k in keys if k not in deal]
    fields = {f.name: f.dataType.simpleString() for f in rows.schema["items"].dataType.elementType.fields}
    texts = [f for f, kind in fields.items() if kind == "string" and f not in own]
    chunked = rows.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk_size)).cast("long"))
    cells = cells_of(chunked.withColumn("_c", F.explode("items")).select(*deal, order, "_chunk", "_c.*"))
    heads = _heads(_offsets(cells, keys, total), deal)
    head = F.struct(*own, "_offset", total, "_loose")
    packed = heads.groupBy(*deal, "_chunk").agg(F.collect_list(head).alias("_heads"))
    whole = lambda f: F.to_json(F.col(f"items.{f}")) if f in texts else F.col(f"items.{f}")
    dealt = (
        chunked.select(*deal, order, "_chunk", *[whole(f).alias(f) for f in fields])
        .unionByName(packed, allowMissingColumns=True)
        .repartition(*deal, "_chunk")
    )
    parts = [F.from_json(f, "array<string>").alias(f) if f in texts else F.col(f) for f in fields]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in heads.dtypes if c in ("_offset", total, "_loose")]
    plain = F.transform(F.arrays_zip(*parts), lambda c: F.struct(*[c[f].alias(f) for f in fields], *nothing))
    heading = F.transform(
        "_heads",
        lambda c: F.struct(
            *[c[f].alias(f) if f in own else F.lit(None).cast(t).alias(f) for f, t in fields.items()],
            *[c[f].alias(f) for f in ("_offset", total, "_loose")],
        ),
    )
    single = dealt.select(
        *deal, order, "_chunk", F.explode(F.when(F.col("_heads").isNull(), plain).otherwise(heading)).alias("_c")
    ).select(*deal, order, "_chunk", "_c.*")
    return _behind_heads(cells_of(single, F.col("_offset").isNotNull()), keys, order, pos, total)


def packed_positions(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    field: str,
    value: Callable[[Column], Column],
    *,
    deal: Sequence[str],
    pos: str = "pos",
    total: str = "n",
    chunk_size: int = ROW_CHUNK,
) -> tuple[DataFrame, DataFrame | None]:
    """Positions of packed rows: (rows with their cells in ``items``, the other rows or None).

    ``items`` holds structs with the keys that are not in ``deal`` and ``text``; a cell
    counts where ``value`` of its text, its ``field``, is not null.  Where all rows of a
    group of ``deal`` have the same cells, once each, all of them have the position of their row: rows are
    numbered as they are, their texts one JSON string, and their keys travel once a
    chunk with its offset.  Rows of groups with gaps are given back, for ``row_positions``.
    """
    deal = list(deal)
    own = [k for k in keys if k not in deal]
    chunked = rows.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk_size)).cast("long"))
    texts = F.transform("items", lambda c: F.struct(*[c[k].alias(k) for k in own], c["text"].alias("text")))
    counted = F.array_sort(F.filter(texts, lambda c: value(c["text"]).isNotNull()))
    named = chunked.select(*deal, order, "_chunk", counted.alias("_cells")).filter(F.size("_cells") > 0)
    sign = F.transform("_cells", lambda c: F.struct(*[c[k].alias(k) for k in own]))
    signs = named.select(*deal, "_chunk", sign.alias("_sign")).groupBy(*deal, "_chunk", "_sign").agg(F.count(F.lit(1)).alias("_cnt"))
    per = W.partitionBy(*deal)
    several = F.min("_sign").over(per) < F.max("_sign").over(per)
    marked = written(
        signs.withColumn("_odd", F.max(F.size("_sign") > F.size(F.array_distinct("_sign"))).over(per) | several)
    )
    heads = marked.filter("NOT _odd").select(
        *deal,
        "_chunk",
        (F.sum("_cnt").over(per.orderBy("_chunk")) - F.col("_cnt")).alias("_offset"),
        F.sum("_cnt").over(per).alias(total),
        "_sign",
    )
    odd = marked.filter("_odd")
    packed = named.select(*deal, order, "_chunk", F.to_json("_cells.text").alias("_texts"))
    dealt = packed.unionByName(heads, allowMissingColumns=True).repartition(*deal, "_chunk")
    inside = W.partitionBy(*deal, "_chunk").orderBy(F.col(order).asc_nulls_first())
    single = F.transform(
        F.from_json("_texts", "array<string>"),
        lambda t, i: F.struct(
            *[F.get("_sign", i)[k].alias(k) for k in own], value(t).alias(field), F.col(total).alias(total)
        ),
    )
    placed = (
        dealt.withColumn("_rn", F.row_number().over(inside))
        .select(*deal, "_texts", "_rn", *[F.first(c).over(inside).alias(c) for c in ("_offset", total, "_sign")])
        .filter(F.col("_sign").isNotNull() & (F.col("_rn") > 1))
        .withColumn(pos, F.col("_offset") + F.col("_rn") - 2)
        .select(*deal, F.floor(F.col(pos) / F.lit(BLOCK)).alias("_block"), pos, single.alias("items"))
    )
    if odd.isEmpty():
        return placed, None
    return placed, rows.join(odd.select(*deal).distinct(), deal, "left_semi")


def whole_groups(rows: DataFrame, keys: Sequence[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups of at most ``limit`` rows, whole groups in one task of about as many rows; the other rows or None).

    What is then grouped by the keys and more stays in its task.  Columns of structs are
    best given field by field, texts as one JSON string.
    """
    keys = list(keys)
    sizes = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")))
    over = sizes.agg(F.sum("_rows").alias("rows"), F.max("_rows").alias("longest")).first()
    parts = max(2, (over.rows or 0) // limit + 1)
    if (over.longest or 0) <= limit:
        return rows.repartition(parts, *keys), None
    long = sizes.filter(F.col("_rows") > limit).select(*keys)
    return rows.join(long, keys, "left_anti").repartition(parts, *keys), rows.join(long, keys, "left_semi")


def gathered(
    df: DataFrame, keys: Sequence[str], pos: str = "pos", block: int = BLOCK, parts: int | None = None
) -> DataFrame:
    """Deal out whole blocks of positions, with ``_block``.

    What is then grouped by (keys, ``_block``, position) stays in its task, and sums
    per group leave it as one row per block, however many tasks there are.  ``parts``
    keeps tasks small where they hold much more than their rows.
    """
    blocks = df.withColumn("_block", F.floor(F.col(pos) / F.lit(block)))
    return blocks.repartition(*([parts] if parts else []), *keys, "_block")


def haloed(df: DataFrame, pos: str, width: int, block: int = BLOCK) -> DataFrame:
    """Copy the last ``width`` rows of each block of positions into the next block.

    Windows over (keys, ``_block``) then see every neighbour within ``width``
    rows; keep only rows where ``_own`` is true.
    """
    home = F.floor(F.col(pos) / F.lit(block))
    near_end = F.pmod(F.col(pos), F.lit(block)) >= block - width
    return df.withColumn(
        "_block", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home)))
    ).withColumn("_own", F.col("_block") == home)


def lagged(
    df: DataFrame, keys: Sequence[str], pos: str, columns: dict[str, str], block: int = BLOCK
) -> DataFrame:
    """Add ``columns[name] = value of name at the previous position``."""
    window = W.partitionBy(*keys, "_block").orderBy(pos)
    out = haloed(df, pos, 1, block)
    for source, target in columns.items():
        out = out.withColumn(target, F.lag(source).over(window))
    return out.filter("_own").drop("_block", "_own")


def magnitude_bucket(value: Column) -> Column:
    """An integer that never decreases with the value: 64 buckets per power of two."""
    value = value.cast("double")
    size = F.floor((F.log2(F.abs(value)) + 1100) * 64).cast("long")
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)


def _split_full(dist: DataFrame, keys: list[str], value: str, full: int) -> DataFrame:
    """Split every bucket of more than ``full`` distinct values at its sampled quantiles, until none is left.

    ``_bucket`` becomes the path of splits; paths rise with the value.  Quantiles are
    mergeable summaries of the bucket's own values, so splits only decide balance.
    """
    group = [*keys, "_bucket"]
    quantiles = [k / PARTS for k in range(1, PARTS)]
    while True:
        sizes = dist.groupBy(*group).agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > full)
        if sizes.isEmpty():
            return dist
        if dict(dist.dtypes)["_bucket"] == "bigint":
            path = dist.withColumn("_bucket", F.array("_bucket"))
            sizes = sizes.withColumn("_bucket", F.array("_bucket"))
        else:
            path = dist
        chunked = path.withColumn("_chunk", F.pmod(F.xxhash64(value), F.lit(64)))
        inside = attach_group_values(chunked, sizes, group)
        splits = inside.groupBy(*group).agg(F.percentile_approx(value, quantiles, 1000).alias("_splits"))
        chunks = inside.select(*group, "_chunk").distinct()
        part = F.size(F.filter("_splits", lambda s: s < F.col(value))).cast("long")
        dist = written(
            chunked.join(chunks.join(splits, group), [*group, "_chunk"], "left")
            .withColumn("_bucket", F.when(F.col("_splits").isNotNull(), F.array_append("_bucket", part)).otherwise(F.col("_bucket")))
            .drop("_splits", "_chunk")
        )


def value_distribution(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None, full: int = FULL
) -> DataFrame:
    """One row per distinct value: count, ranks below it, previous value, group size.

    Equal values are merged before any shuffle on the group, so a constant hot
    column is one row; distinct values are ranked bucket by bucket with cumulated
    bucket totals.  Buckets are magnitudes; one that holds too many distinct values
    (a long column in a narrow range) is split at quantiles of its values.
    """
    keys = list(keys)
    df = df.drop("_bucket") if value != "_bucket" else df
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    dist = written(
        df.groupBy(*keys, value)
        .agg(amount.alias("cnt"))
        .withColumn("_bucket", magnitude_bucket(F.col(value)))
    )
    dist = _split_full(dist, keys, value, full)
    per_key = W.partitionBy(*keys)
    by_bucket = per_key.orderBy("_bucket")
    buckets = (
        dist.groupBy(*keys, "_bucket")
        .agg(F.sum("cnt").alias("_b_cnt"), F.max(value).alias("_b_max"))
        .select(
            *keys,
            "_bucket",
            (F.sum("_b_cnt").over(by_bucket) - F.col("_b_cnt")).alias("_b_before"),
            F.lag("_b_max").over(by_bucket).alias("_b_prev"),
            F.sum("_b_cnt").over(per_key).alias("n"),
        )
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(value)
    return (
        dist.withColumn("_run", F.sum("cnt").over(inside) - F.col("cnt"))
        .withColumn("_lag", F.lag(value).over(inside))
        .join(buckets, [*keys, "_bucket"])
        .select(
            *keys,
            value,
            "cnt",
            (F.col("_b_before") + F.col("_run")).alias("before"),
            F.coalesce("_lag", "_b_prev").alias("prev"),
            "n",
            "_bucket",
        )
    )


def at_rank(value: str, rank: Column) -> Column:
    """Aggregate over a value distribution: the value with 0-based rank ``rank``."""
    inside = (F.col("before") <= rank) & (rank < F.col("before") + F.col("cnt"))
    return F.max(F.when(inside, F.col(value)))


def upper_median(value: str) -> Column:
    return at_rank(value, F.floor(F.col("n") / 2))


def attach_group_values(
    df: DataFrame, values: DataFrame, keys: Sequence[str], chunk: str = "_chunk"
) -> DataFrame:
    """Join one row per group onto rows that carry a chunk, without one hot join key.

    The small side is first spread over the chunks that really occur, so the
    join key is (group, chunk).
    """
    keys = list(keys)
    chunks = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_u")).drop("_u")
    return df.join(chunks.join(values, keys), [*keys, chunk])
