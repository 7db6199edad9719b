"""Joins between captures, receipts, truth tables, raters, models and labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions.ordered import previous
from lotlens.plans.session import materialise


def latest_revision(receipts: DataFrame, by: Sequence[str] = ("lot_id",), rev: str = "rev", seen: str = "receipt_no") -> DataFrame:
    """The highest revision per lot (the first seen among equal ones), as an aggregate rather than a window."""
    row = F.struct(*[c for c in receipts.columns if c not in by])
    best = receipts.groupBy(*by).agg(F.max_by(row, F.struct(F.col(rev), -F.col(seen))).alias("_r"))
    return best.select(*by, "_r.*")


def with_truth(truth: DataFrame, latest: DataFrame, on: str = "lot_id") -> DataFrame:
    """Truth rows that have a receipt; unmatched rows drop out."""
    return truth.join(latest, on)


def positional_join(truth: DataFrame, detected: DataFrame, by: str, truth_order: str, detected_order: str,
                    detected_tie: Sequence[str] = ()) -> DataFrame:
    """The n-th truth row of a photo against its n-th detection."""
    a = _numbered(truth, by, [truth_order], "rn")
    b = _numbered(detected, by, [detected_order, *detected_tie], "rn")
    return a.join(b, [by, "rn"])


def _numbered(rows: DataFrame, by: str, order: Sequence[str], name: str) -> DataFrame:
    """1-based position within a photo. A photo's rows are one small group, so a window by photo does, without slices."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*[F.col(c) for c in order])).cast("bigint")
    return rows.select(*[c for c in rows.columns if c != name], place.alias(name))


def reading_order(items: DataFrame, by: str = "capture_id", x: str = "x", y: str = "y", height: str = "h") -> DataFrame:
    """Rows top to bottom, then left to right; rows are bands of 0.6 median heights.

    The original comparator is not transitive, so rows are banded instead. Adds ``row`` and 1-based ``ord``. Photos
    without any height are left out. All windows are by photo, so the items are shuffled once.
    """
    photo = Window.partitionBy(by)
    ranked = items.where(F.col(by).isNotNull()).select(by, *[c for c in items.columns if c != by],
                                                       F.row_number().over(photo.orderBy(F.col(height).asc_nulls_last())).alias("_k"), F.count(height).over(photo).alias("_n"))
    middle = F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, F.col(height))).over(photo)
    banded = ranked.withColumn("_h", middle).where("_n > 0").withColumn("row", F.floor(F.col(y) / (F.col("_h") * 0.6))).drop("_h", "_k", "_n")
    return _numbered(banded, by, ["row", x, *[c for c in ("pos",) if c in items.columns]], "ord")


def rated_by_all(ratings: DataFrame, model: DataFrame, raters: int) -> DataFrame:
    """Items that every rater and the model graded."""
    full = ratings.groupBy("item").agg(F.count_distinct("rater").alias("k")).where(F.col("k") == raters).select("item")
    return full.join(model.select("item").distinct(), "item")


def correction_items(corrections: DataFrame, captures: DataFrame, items: DataFrame) -> DataFrame:
    """Corrections whose capture and item still exist."""
    return corrections.join(captures, "capture_id").join(items, ["capture_id", "pos"])


def centres_with_runs(centres: DataFrame, runs: DataFrame) -> DataFrame:
    """Every centre with its number of reference runs; centres without any read NO DATA."""
    n = runs.groupBy(F.col("centre_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return (centres.join(n, "id", "left").withColumn("n_runs", F.coalesce("n", F.lit(0).cast("bigint")))
            .withColumn("status", F.when(F.col("n").isNull(), "NO DATA").otherwise("OK")).drop("n"))


def without_labels(images: DataFrame, boxes: DataFrame, on: Sequence[str] = ("image_id",)) -> DataFrame:
    return images.join(boxes.select(*on).distinct(), list(on), "left_anti")


def with_pack_by_hash(receipts: DataFrame, packs: DataFrame) -> DataFrame:
    """Packs are found by content hash, never by the id a receipt claims."""
    known = packs.select("pack_hash", F.col("pack_id").alias("known_pack_id"))
    return receipts.join(known, "pack_hash", "left").withColumn("pack_known", F.col("known_pack_id").isNotNull())


def with_predecessor(receipts: DataFrame, leaves: DataFrame) -> DataFrame:
    """Each receipt beside the receipt its chain link names and its log leaf."""
    p = receipts.select(F.col("hash").alias("prev"), F.col("receipt_no").alias("prev_no"))
    return receipts.join(p, "prev", "left").join(leaves.select(F.col("cert_hash").alias("hash"), F.col("idx").alias("log_idx")), "hash", "left")


def same_items(a: DataFrame, b: DataFrame, on: str = "id") -> DataFrame:
    """Scores of two models on the items both scored: on, label, score_a, score_b."""
    return a.select(on, "label", F.col("score").alias("score_a")).join(b.select(on, F.col("score").alias("score_b")), on)


def missing_from(a: DataFrame, b: DataFrame, on: str = "id") -> DataFrame:
    return a.select(on).join(b.select(on), on, "left_anti")


def iou(a: str, b: str) -> Column:
    """Intersection over union of two x0,y0,x1,y1 column groups."""
    return _overlap(lambda c: F.col(f"{a}{c}"), lambda c: F.col(f"{b}{c}"))


def _overlap(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a("x1"), b("x1")) - F.greatest(a("x0"), b("x0")))
    h = F.greatest(F.lit(0.0), F.least(a("y1"), b("y1")) - F.greatest(a("y0"), b("y0")))
    area = lambda p: (p("x1") - p("x0")) * (p("y1") - p("y0"))
    inter = w * h
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def candidate_matches(predicted: DataFrame, truth: DataFrame, threshold: float = 0.5, cells: int = 8) -> DataFrame:
    """Pairs of same-class boxes in an image with IoU at or above the threshold.

    Predictions go to the grid cell of their centre and truth boxes to every cell they cover, so only neighbours meet.
    IoU >= t needs an overlap of at least t of the prediction's side, so its centre lies within the truth box grown by
    max(0, 0.5 / t - 1) of its side, and no pair is lost.
    """
    margin = max(0.0, 0.5 / threshold - 1.0) + 1e-9
    at = lambda lo, hi: F.floor((F.col(lo) + F.col(hi)) / 2 * cells).cast("int")
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) * cells).cast("int"), F.floor(F.col(hi) * cells).cast("int"))
    p = predicted.select("image_id", "cls", "pred_id", "conf", *[F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")],
                         at("x0", "x1").alias("cx"), at("y0", "y1").alias("cy"))
    grow = lambda a, b, s: F.col(a) + (F.col(b) - F.col(a)) * s
    g = truth.withColumn("gx0", grow("x0", "x1", -margin)).withColumn("gx1", grow("x0", "x1", 1.0 + margin)).withColumn("gy0", grow("y0", "y1", -margin)).withColumn("gy1", grow("y0", "y1", 1.0 + margin))
    g = (g.select("image_id", "cls", "gt_id", *[F.col(c).alias(f"g_{c}") for c in ("x0", "y0", "x1", "y1")],
                  F.explode(span("gx0", "gx1")).alias("cx"), "gy0", "gy1")
         .select("*", F.explode(span("gy0", "gy1")).alias("cy")))
    pairs = p.join(g, ["image_id", "cls", "cx", "cy"]).withColumn("iou", iou("p_", "g_"))
    return pairs.where(F.col("iou") >= threshold).select("image_id", "cls", "pred_id", "conf", "gt_id", "iou")


#: Images with more boxes than this, predictions and truth together, are matched by joins on cells.
IMAGE_BOXES = 512


def _crowded(a: DataFrame, b: DataFrame) -> DataFrame | None:
    """(image_id) of the images with over IMAGE_BOXES rows in both tables together; None without any."""
    images = a.select("image_id").unionByName(b.select("image_id")).where(F.col("image_id").isNotNull())
    found = materialise(images.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > IMAGE_BOXES).select("image_id"))
    return None if found.isEmpty() else found


def _together(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """by..., as, bs: the other columns' rows of both tables per group, which a count has shown to be small. One shuffle of both."""
    row = lambda df: F.struct(*[c for c in df.columns if c not in by])
    none = lambda df: F.lit(None).cast(df.select(row(df).alias("r")).schema["r"].dataType)
    both = a.select(*by, row(a).alias("a"), none(b).alias("b")).unionByName(b.select(*by, none(a).alias("a"), row(b).alias("b")))
    return both.repartition(*by).groupBy(*by).agg(F.collect_list("a").alias("as"), F.collect_list("b").alias("bs"))


def greedy_match(predicted: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One-to-one matching, most confident prediction first: pred_id, conf, correct, gt_id.

    A prediction takes its best free truth box (ties: smaller id) among those of its image and class. Images of up to
    IMAGE_BOXES boxes are small groups whose pairs are walked in order; both tables are shuffled once for them. The boxes of
    larger ones meet on grid cells (``_greedy_rounds``), so no group grows beyond that. Ids are those of an image and class.
    """
    p, g, crowded = _boxes(predicted, "pred_id", "conf"), _boxes(truth, "gt_id"), _crowded(predicted, truth)
    out = ["pred_id", "image_id", "cls", "conf", "gt_id"]
    hit = lambda df: df.withColumn("gt_id", F.lit(None).cast(truth.schema["gt_id"].dataType)).select(*out)
    placed = F.col("image_id").isNotNull() & F.col("cls").isNotNull()
    found = hit(p.where(~placed))
    p, g = p.where(placed), g.where(placed)
    if crowded is not None:
        found = found.unionByName(_greedy_rounds(p.join(crowded, "image_id", "left_semi"), g.join(crowded, "image_id", "left_semi"), threshold).select(*out))
        p, g = p.join(crowded, "image_id", "left_anti"), g.join(crowded, "image_id", "left_anti")
    pairs = F.flatten(F.transform(F.array_distinct("as"), lambda a: F.transform(F.array_distinct("bs"), lambda b: F.struct(
        a.conf.isNull().alias("none"), (-a.conf).alias("first"), a.pred_id.alias("pred_id"), (-_overlap(a.getField, b.getField)).alias("worse"), b.gt_id.alias("gt_id")))))
    pairs = F.array_sort(F.filter(pairs, lambda x: (-x.worse >= threshold) & x.pred_id.isNotNull() & x.gt_id.isNotNull()))
    none = lambda of, c: F.array().cast(f"array<{of.schema[c].dataType.simpleString()}>")
    matched = F.aggregate("pairs", F.struct(none(p, "pred_id").alias("p"), none(g, "gt_id").alias("g")), lambda s, x: F.when(
        F.array_contains(s.p, x.pred_id) | F.array_contains(s.g, x.gt_id), s).otherwise(F.struct(F.array_append(s.p, x.pred_id).alias("p"), F.array_append(s.g, x.gt_id).alias("g"))))
    groups = _together(p, g, ["image_id", "cls"]).where(F.size("as") > 0).withColumn("pairs", pairs).select("image_id", "cls", "as", matched.alias("m"))
    each = groups.select("image_id", "cls", F.explode("as").alias("a"), "m")
    place = F.array_position("m.p", F.col("a.pred_id")).cast("int")
    small = each.select("a.pred_id", "image_id", "cls", "a.conf", F.when(place > 0, F.get("m.g", place - 1)).alias("gt_id"))
    return small.unionByName(found).withColumn("correct", F.col("gt_id").isNotNull().cast("int"))


def _boxes(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("image_id", "cls", *columns, "x0", "y0", "x1", "y1")


def _greedy_rounds(predicted: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """``greedy_match`` for images of any number of boxes.

    A prediction takes its best free truth box (ties: smaller id) once no more confident one (ties: smaller id, no
    confidence last) still has that box among its candidates: nothing can change its turn any more. Rounds of such pairs,
    each two aggregates and a join over the pairs left, end when none are left; no image is ever one group.
    """
    c = materialise(candidate_matches(predicted, truth, threshold).select("pred_id", "conf", "gt_id", "iou"))
    left, hits = c, None
    while hits is None or not left.isEmpty():
        best = left.groupBy("pred_id").agg(F.min(F.struct((-F.col("iou")).alias("order"), "gt_id")).alias("b")).select("pred_id", "b.gt_id")
        first = left.groupBy("gt_id").agg(F.min(F.struct(F.col("conf").isNull().alias("none"), (-F.col("conf")).alias("order"), "pred_id")).alias("f")).select("gt_id", "f.pred_id")
        won = materialise(best.join(first, ["gt_id", "pred_id"]))
        hits = won if hits is None else hits.unionByName(won)
        left = materialise(left.join(won.select("pred_id"), "pred_id", "left_anti").join(won.select("gt_id"), "gt_id", "left_anti"))
    return predicted.select("pred_id", "image_id", "cls", "conf").join(hits.select("pred_id", "gt_id"), "pred_id", "left")


def nearest_centre(queries: DataFrame, targets: DataFrame, cap: Column) -> DataFrame:
    """Closest target centre within the query's image, if within ``cap`` (ties: smaller t_id).

    queries(image_id, q_id, q_x, q_y, ...), targets(image_id, t_id, t_x, t_y). Images of up to IMAGE_BOXES centres are small
    groups, and both tables are shuffled once for them; the centres of larger ones meet on grid cells (``_nearest_by_cells``).
    """
    q = queries.withColumn("_cap", cap.cast("double")).where("_cap >= 0 AND image_id IS NOT NULL AND q_x IS NOT NULL AND q_y IS NOT NULL")
    t = targets.select("image_id", "t_id", "t_x", "t_y").where(F.col("image_id").isNotNull())
    crowded, found = _crowded(q, t), None
    if crowded is not None:
        found = _nearest_by_cells(q.join(crowded, "image_id", "left_semi"), t.join(crowded, "image_id", "left_semi"), queries.columns)
        q, t = q.join(crowded, "image_id", "left_anti"), t.join(crowded, "image_id", "left_anti")
    groups = _together(q, t, ["image_id"]).select("image_id", F.explode(F.array_distinct("as")).alias("a"), "bs")
    near = F.array_min(F.filter(F.transform("bs", lambda b: F.struct(F.hypot(F.col("a.q_x") - b.t_x, F.col("a.q_y") - b.t_y).alias("dist"), b.t_id.alias("t_id"))),
                                lambda x: x.dist <= F.col("a._cap")))
    near = groups.select("image_id", "a", near.alias("_b")).where(F.col("_b").isNotNull())
    out = near.select(*[F.col(c) if c == "image_id" else F.col("a")[c].alias(c) for c in queries.columns], "_b.*")
    return out if found is None else out.unionByName(found)


def _nearest_by_cells(q: DataFrame, targets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``nearest_centre`` for images of any number of centres, with the cap as ``_cap``.

    Cells are as wide as four times the cap's next power of two and a query goes to those that its circle's box touches,
    four at most and one or two as a rule. Targets stand in the grid of every cap that their image's queries have, a few
    powers of two.
    """
    level = F.greatest(F.lit(-30), F.ceil(F.log2(F.greatest(F.col("_cap"), F.lit(2.0**-30)))))
    cell = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("_level") + 2))
    reach = lambda c: F.col("_cap") * (1 + 1e-9) + F.abs(c) * 1e-15  # noqa: E731  # a rounded distance may reach a little further
    touched = lambda c: F.explode(F.sequence(cell(F.col(c) - reach(c)), cell(F.col(c) + reach(c))))
    q = q.withColumn("_level", level)
    grids = q.select("image_id", "_level").distinct()
    q = q.withColumn("_cx", touched("q_x")).withColumn("_cy", touched("q_y"))
    t = targets.join(grids, "image_id").withColumns({"_cx": cell(F.col("t_x")), "_cy": cell(F.col("t_y"))})
    j = q.join(t, ["image_id", "_level", "_cx", "_cy"]).withColumn("dist", F.hypot(F.col("q_x") - F.col("t_x"), F.col("q_y") - F.col("t_y"))).where("dist <= _cap")
    return j.groupBy(*columns).agg(F.min(F.struct("dist", "t_id")).alias("_b")).select(*columns, "_b.*")


def pair_images_with_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Image and label files of the same folder, split and stem."""
    return images.join(labels, ["folder", "split", "stem"])


def successive(df: DataFrame, by: str, order: str, values: dict[str, str]) -> DataFrame:
    return previous(df, order, values, [by])
