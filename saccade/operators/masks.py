"""Binary masks as run-length rows.

A mask row carries its keys, the image size ``h``, ``w`` and ``counts``: lengths of alternating background
and foreground stretches, column by column, the first one background (0 where the mask starts set).
Everything that concerns one mask is computed inside its row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

MASK_KEYS = ("participant_id", "frame", "label_ord")

# Clamp for the scores of objects that lose a pixel, and score of an object that is not there.
SUPPRESSED_SCORE = -10.0
MISSING_SCORE = -1024.0

_BLOCK = 64
#: Pixels of a score array that meet those of the frame's other objects at once.
SCORE_BLOCK = 4096


def rle_encode(masks: DataFrame, values: str, is_set: Callable[[Column], Column] = lambda v: v) -> DataFrame:
    """Replaces a row-major array of pixel values by ``counts``; ``is_set`` tells which values are foreground."""
    n = F.col("h") * F.col("w")
    places = F.slice(F.sequence(F.lit(0), n), F.lit(1), n)  # none of an image without pixels
    turned = masks.withColumn("_bits", F.transform(
        places, lambda j: is_set(F.get(values, (j % F.col("h")) * F.col("w") + F.floor(j / F.col("h")).cast("int")))))
    marked = turned.withColumn("_edges", F.concat(
        F.filter(places, lambda j: (j == 0) | (F.get("_bits", j) != F.get("_bits", j - 1))), F.array(n)))
    lengths = F.transform(F.slice("_edges", F.lit(2), F.size("_edges") - 1),
                          lambda edge, i: edge - F.get("_edges", i))
    lead = F.when(F.coalesce(F.get("_bits", F.lit(0)), F.lit(False)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return marked.withColumn("counts", F.concat(lead, lengths)).drop("_bits", "_edges", values)


def rle_from_pixels(masks: DataFrame, pixels: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Encodes rows of set pixels (keys, x, y); ``masks`` gives keys, h, w, also of masks without a pixel."""
    keys = list(keys)
    columns = (
        pixels.select(*keys, "x", "y").distinct().join(masks.select(*keys, "h"), keys)
        .select(*keys, (F.col("x") * F.col("h") + F.col("y")).alias("run_start"))
        .withColumn("run_end", F.col("run_start") + 1)
    )
    return rle_from_spans(masks, columns, keys)


def rle_from_spans(masks: DataFrame, spans: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Encodes disjoint offset ranges [run_start, run_end) per mask; an array is bounded by the image."""
    keys = list(keys)
    gathered = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("run_start", "run_end"))).alias("_spans"))
    held = masks.drop("counts").join(gathered, keys, "left").withColumn(
        "_spans", F.coalesce("_spans", F.array().cast("array<struct<run_start:int,run_end:int>>")))
    merged = held.withColumn("_starts", F.transform(F.filter(
        "_spans", lambda s, i: (i == 0) | (F.get("_spans", i - 1)["run_end"] != s["run_start"])), lambda s: s["run_start"])
    ).withColumn("_ends", F.transform(F.filter(
        "_spans", lambda s, i: (i == F.size("_spans") - 1) | (F.get("_spans", i + 1)["run_start"] != s["run_end"])),
        lambda s: s["run_end"]))
    n = F.col("h") * F.col("w")
    pairs = F.flatten(F.transform("_starts", lambda start, i: F.array(
        start - F.when(i == 0, 0).otherwise(F.get("_ends", i - 1)), F.get("_ends", i) - start)))
    rest = n - F.coalesce(F.try_element_at("_ends", F.lit(-1)), F.lit(0))
    tail = F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>"))
    return merged.withColumn("counts", F.concat(pairs, tail)).drop("_spans", "_starts", "_ends")


def with_runs(masks: DataFrame, out: str = "runs") -> DataFrame:
    """Adds the foreground stretches of each mask as offset ranges [run_start, run_end).

    Offsets are running sums of ``counts``; they are built block by block to stay near linear.
    """
    n = F.size("counts")
    block = F.lit(_BLOCK)

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, c: acc + c)

    blocks = masks.withColumn("_sums", F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")),
        lambda b: total(F.slice("counts", b * block + 1, block))))
    heads = blocks.withColumn("_heads", F.transform(
        "_sums", lambda s, b: total(F.slice("_sums", F.lit(1), b))))
    ends = heads.withColumn("_ends", F.flatten(F.transform("_heads", lambda head, b: F.transform(
        F.slice("counts", b * block + 1, block),
        lambda c, i: head + total(F.slice("counts", b * block + 1, i + 1))))))
    numbers = F.sequence(F.lit(1), F.size("_ends") - 1)
    odd = F.when(F.size("_ends") > 1, F.filter(numbers, lambda i: i % 2 == 1)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(odd, lambda i: F.struct(
        F.get("_ends", i - 1).alias("run_start"), F.get("_ends", i).alias("run_end")))
    return ends.withColumn(out, F.filter(runs, lambda r: r["run_end"] > r["run_start"])).drop("_sums", "_heads", "_ends")


def _each_run(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per foreground stretch.

    The outer form keeps the optimizer from copying the whole run expression into a filter under the explode.
    """
    rows = with_runs(masks).select(*keys, "h", F.explode_outer("runs").alias("run"))
    return rows.filter(F.col("run").isNotNull())


def mask_runs(masks: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """One row per foreground stretch, with offsets and the pixels of both ends."""
    cell = _each_run(masks, keys)
    last = F.col("run.run_end") - 1
    return cell.select(
        *keys, "run.run_start", "run.run_end",
        F.floor(F.col("run.run_start") / F.col("h")).cast("int").alias("x_first"),
        (F.col("run.run_start") % F.col("h")).alias("y_first"),
        F.floor(last / F.col("h")).cast("int").alias("x_last"),
        (last % F.col("h")).alias("y_last"))


def column_segments(masks: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Foreground stretches cut at column borders: keys, h, x, y0, y1 (inclusive)."""
    cut = _each_run(masks, keys).select(*keys, "h", "run", F.explode_outer(F.sequence(
        F.floor(F.col("run.run_start") / F.col("h")).cast("int"),
        F.floor((F.col("run.run_end") - 1) / F.col("h")).cast("int"))).alias("x"))
    base = F.col("x") * F.col("h")
    return cut.select(
        *keys, "h", "x",
        F.greatest(F.col("run.run_start") - base, F.lit(0)).alias("y0"),
        F.least(F.col("run.run_end") - 1 - base, F.col("h") - 1).alias("y1"))


def rle_decode(masks: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """One row per set pixel: keys, x, y."""
    return column_segments(masks, keys).select(
        *keys, "x", F.explode_outer(F.sequence("y0", "y1")).alias("y"))


def rle_area(counts: Column) -> Column:
    return F.aggregate(F.filter(counts, lambda c, i: i % 2 == 1), F.lit(0), lambda acc, c: acc + c)


def complement(masks: DataFrame) -> DataFrame:
    """Swaps foreground and background."""
    counts = F.col("counts")
    return masks.withColumn("counts", F.when(F.get(counts, F.lit(0)) == 0, F.slice(counts, F.lit(2), F.size(counts)))
                            .otherwise(F.concat(F.array(F.lit(0)), counts)))


def mask_box(masks: DataFrame, empty: str = "zero") -> DataFrame:
    """Adds the inclusive bounds x0, y0, x1, y1; empty masks give 0,0,0,0 or, with ``inverted``, w,h,-1,-1."""
    if empty not in ("zero", "inverted"):
        raise ValueError("empty must be 'zero' or 'inverted'")
    h = F.col("h")
    drawn = with_runs(masks)
    first = F.get("runs", F.lit(0))["run_start"]
    last = F.try_element_at("runs", F.lit(-1))["run_end"] - 1
    wraps = F.exists("runs", lambda r: F.floor(r["run_start"] / h) != F.floor((r["run_end"] - 1) / h))
    top = F.when(wraps, 0).otherwise(F.array_min(F.transform("runs", lambda r: r["run_start"] % h)))
    bottom = F.when(wraps, h - 1).otherwise(F.array_max(F.transform("runs", lambda r: (r["run_end"] - 1) % h)))
    bare = {"x0": F.lit(0), "y0": F.lit(0), "x1": F.lit(0), "y1": F.lit(0)} if empty == "zero" else {
        "x0": F.col("w"), "y0": h, "x1": F.lit(-1), "y1": F.lit(-1)}
    sides = {"x0": F.floor(first / h), "y0": top, "x1": F.floor(last / h), "y1": bottom}
    return drawn.select(
        *masks.columns,
        *[F.when(F.size("runs") == 0, bare[s]).otherwise(side).cast("int").alias(s) for s, side in sides.items()])


def mask_stats(masks: DataFrame, empty: str = "zero") -> DataFrame:
    """Area and bounds of each mask."""
    return mask_box(masks, empty).withColumn("area", rle_area(F.col("counts")))


def threshold_pixels(logits: Column, threshold: float = 0.0) -> Column:
    """Boolean array of the scores above ``threshold``."""
    return F.transform(logits, lambda v: v.cast("double") > threshold)


def stability(logits: Column, threshold: float = 0.0, offset: float = 1.0, guarded: bool = False) -> Column:
    """Pixels above the high threshold over pixels above the low one.

    With no pixel above the low one the score is 1.0 if ``guarded``, else not a number.
    """
    inner = F.size(F.filter(logits, lambda v: v.cast("double") > threshold + offset))
    outer = F.size(F.filter(logits, lambda v: v.cast("double") > threshold - offset))
    empty = 1.0 if guarded else float("nan")
    return F.when(outer > 0, inner / F.nullif(outer, F.lit(0))).otherwise(F.lit(empty))


def logit_pixels(logits: DataFrame, keys: Sequence[str] = MASK_KEYS, column: str = "logits") -> DataFrame:
    """One row per pixel of a row-major score array: keys, x, y, logit."""
    place = logits.select(*keys, "w", F.posexplode_outer(column).alias("place", "logit"))
    return place.select(*keys, (F.col("place") % F.col("w")).alias("x"),
                        F.floor(F.col("place") / F.col("w")).cast("int").alias("y"), "logit")


def non_overlap(pixels: DataFrame, frame_keys: Sequence[str] = ("participant_id", "frame"),
                obj: str = "label_ord") -> DataFrame:
    """Leaves each pixel to its best object (the lowest number on ties) and clamps the others.

    The winner is found by an aggregate, which combines before the shuffle.
    """
    spot = [*frame_keys, "x", "y"]
    best = pixels.groupBy(*spot).agg(F.min_by(obj, F.struct(-F.col("logit"), F.col(obj))).alias("_best"))
    clamped = F.least(F.col("logit"), F.lit(SUPPRESSED_SCORE).cast("float"))
    return (
        pixels.join(best, spot)
        .withColumn("logit", F.when(F.col(obj) == F.col("_best"), F.col("logit")).otherwise(clamped))
        .drop("_best")
    )


def non_overlap_scores(logits: DataFrame, frame_keys: Sequence[str] = ("participant_id", "frame"), obj: str = "label_ord",
                       column: str = "logits", block: int = SCORE_BLOCK) -> DataFrame:
    """:func:`non_overlap` on whole row-major score arrays; the objects of a frame share one image size.

    Arrays are cut into blocks of pixels. A block meets the same block of the frame's other objects, where one pass in the
    order of objects finds the winners, so no pixel becomes a row. A missing score never wins and stays missing."""
    keys = [*frame_keys, obj]
    size = F.size(column)
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(size - 1, F.lit(0)) / block).cast("int")),
                        lambda b: F.slice(column, b * block + 1, block))
    cut = logits.select(*keys, F.posexplode(parts).alias("_block", "_part"))
    met = cut.groupBy(*frame_keys, "_block").agg(F.sort_array(F.collect_list(F.struct(F.col(obj).alias("obj"), F.col("_part").alias("part")))).alias("_all"))
    none = F.struct(F.lit(None).cast("float").alias("best"), F.lit(None).cast(logits.schema[obj].dataType).alias("obj"))

    def better(held: Column, x: Column) -> Column:
        return F.zip_with(held, x["part"], lambda a, v: F.when(
            v.isNotNull() & (a["best"].isNull() | (v > a["best"])), F.struct(v.cast("float").alias("best"), x["obj"].alias("obj"))).otherwise(a))

    won = met.withColumn("_won", F.transform(F.aggregate(
        "_all", F.transform(F.get("_all", F.lit(0))["part"], lambda _: none), better), lambda a: a["obj"]))
    each = won.select(*frame_keys, "_block", "_won", F.explode("_all").alias("_one"))
    left = F.zip_with("_one.part", "_won", lambda v, who: F.when(
        (who == F.col("_one.obj")) | v.isNull(), v).otherwise(F.least(v, F.lit(SUPPRESSED_SCORE).cast("float"))))
    settled = each.select(*frame_keys, F.col("_one.obj").alias(obj), "_block", left.alias("_part")).groupBy(*keys).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_block", "_part"))), lambda p: p["_part"])).alias(column))
    return logits.drop(column).join(settled, keys).select(*logits.columns)


def uncrop_masks(masks: DataFrame, crop: Sequence[str], full_h: Column, full_w: Column,
                 keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Moves masks of a crop (columns x0, y0 named by ``crop``) into the full image."""
    dx, dy = (F.col(c) for c in crop)
    full = masks.select(*keys, full_h.cast("int").alias("h"), full_w.cast("int").alias("w"))
    moved = column_segments(masks, [*keys, *crop]).join(full.withColumnRenamed("h", "full_h"), list(keys)).select(
        *keys, ((F.col("x") + dx) * F.col("full_h") + F.col("y0") + dy).cast("int").alias("run_start"),
        ((F.col("x") + dx) * F.col("full_h") + F.col("y1") + dy + 1).cast("int").alias("run_end"))
    return rle_from_spans(full, moved, keys)


def _both_sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of two masks by column, as two sorted lists; both lists are disjoint inside a column, so they are short."""
    a = column_segments(left, keys).withColumn("side", F.lit(1))
    b = column_segments(right, keys).withColumn("side", F.lit(2))
    return a.unionByName(b).groupBy(*keys, "x").agg(*[
        F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("y0", "y1")))).alias(name) for side, name in ((1, "one"), (2, "two"))])


def _minus(one: str, two: str) -> Column:
    """What the pieces ``one`` of a column have beyond the pieces ``two``."""
    def rest(piece: Column) -> Column:
        cuts = F.filter(two, lambda q: (q["y1"] >= piece["y0"]) & (q["y0"] <= piece["y1"]))
        opens = F.concat(F.array(piece["y0"]), F.transform(cuts, lambda q: q["y1"] + 1))
        closes = F.concat(F.transform(cuts, lambda q: q["y0"] - 1), F.array(piece["y1"]))
        return F.filter(F.zip_with(opens, closes, lambda y0, y1: F.struct(y0.alias("y0"), y1.alias("y1"))), lambda p: p["y0"] <= p["y1"])
    return F.flatten(F.transform(one, rest))


def mask_error_pieces(truth: DataFrame, predicted: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Column pieces set in only one of two masks: keys, x, y0, y1, kind (false_positive or false_negative)."""
    keys = list(keys)
    column = _both_sides(truth, predicted, keys)
    def named(pieces: Column, kind: str) -> Column:
        return F.transform(pieces, lambda p: F.struct(F.lit(kind).alias("kind"), p["y0"].alias("y0"), p["y1"].alias("y1")))

    kinds = F.concat(named(_minus("two", "one"), "false_positive"), named(_minus("one", "two"), "false_negative"))
    return column.select(*keys, "x", F.explode(kinds).alias("p")).select(*keys, "x", "p.y0", "p.y1", "p.kind")


def mask_errors(truth: DataFrame, predicted: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Pixels set in only one of two masks: kind is false_positive or false_negative. Only these become pixel rows."""
    return mask_error_pieces(truth, predicted, keys).select(*keys, "x", F.explode_outer(F.sequence("y0", "y1")).alias("y"), "kind")


def mask_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Areas, intersection, union and their ratio, and whether both masks are equal."""
    keys = list(keys)
    a = column_segments(left, keys).withColumn("side", F.lit(1))
    b = column_segments(right, keys).withColumn("side", F.lit(2))
    pieces = a.unionByName(b)
    # Both lists are disjoint inside a column, so a column is compared as two short arrays.
    column = pieces.groupBy(*keys, "x").agg(
        F.collect_list(F.when(F.col("side") == 1, F.struct("y0", "y1"))).alias("one"),
        F.collect_list(F.when(F.col("side") == 2, F.struct("y0", "y1"))).alias("two"),
        F.sum(F.when(F.col("side") == 1, F.col("y1") - F.col("y0") + 1).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("side") == 2, F.col("y1") - F.col("y0") + 1).otherwise(0)).alias("b"))
    common = F.aggregate(F.flatten(F.transform("one", lambda p: F.transform("two", lambda q: F.greatest(
        F.least(p["y1"], q["y1"]) - F.greatest(p["y0"], q["y0"]) + 1, F.lit(0))))), F.lit(0), lambda acc, v: acc + v)
    sums = column.select(*keys, "a", "b", common.alias("both")).groupBy(*keys).agg(
        F.sum("a").alias("area_left"), F.sum("b").alias("area_right"), F.sum("both").alias("intersection"))
    everything = left.select(*keys).unionByName(right.select(*keys)).distinct().join(sums, keys, "left").fillna(
        0, ["area_left", "area_right", "intersection"])
    union = F.col("area_left") + F.col("area_right") - F.col("intersection")
    return everything.select(
        "*", union.alias("union_area"), (F.col("intersection") / F.nullif(union, F.lit(0))).alias("iou"),
        ((F.col("area_left") == F.col("intersection")) & (F.col("area_right") == F.col("intersection"))).alias("all_correct"))
