"""Splits, samples and quality checks of labelled image sets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions.numeric import num
from lotlens.functions.ordered import row_index
from lotlens.operators.measure import CLASS_NAMES


def block_split(image_id) -> Column:
    """Blocks of 25 consecutive ids: every fifth block tunes, the last of five is held out, the rest train."""
    b = F.floor(num(image_id) / 25) % 5
    return F.when(b == 0, "tune").when(b == 4, "holdout").otherwise("train")


def exclude_viewed(images: DataFrame, viewed: DataFrame, on: str = "id") -> DataFrame:
    return images.join(viewed.select(on), on, "left_anti")


def _cell_size(df: DataFrame, by: Sequence[str], name: str = "_n") -> DataFrame:
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    return df.join(sizes, list(by))


def even_spread(pool: DataFrame, n: int, by: Sequence[str], order: str = "id") -> DataFrame:
    """At most n rows per cell at positions floor(k * size / n), k = 0..n-1."""
    idx = _cell_size(row_index(pool, order, by, "_rn"), by).withColumn("_i", F.col("_rn") - 1)
    m = F.least(F.lit(n), F.col("_n"))
    # Position i is picked when some k has floor(k * size / m) = i: the smallest k with k * size >= i * m.
    k = F.ceil(F.col("_i") * m / F.col("_n"))
    return idx.where((k < m) & (F.floor(k * F.col("_n") / m) == F.col("_i"))).select(*pool.columns)


LAYERS = ("top", "middle", "bottom")


def draw_sacks(lots: DataFrame, k: int) -> DataFrame:
    """Uniform k distinct sacks per lot and a layer for each, seeded by both parties' codes.

    Sacks are ranked by a hash of seed and number, so anyone can recheck one sack without replaying the draw.
    """
    material = F.concat_ws("|", F.col("lot_id").cast("string"), "farmer_code", "officer_code", F.date_format("purchase_date", "yyyy-MM-dd"),
                           F.col("sacks").cast("string"), F.lit(str(k)))
    s = lots.select("lot_id", "sacks", F.sha2(material, 256).alias("seed")).selectExpr("*", "explode(sequence(1, sacks)) AS sack")
    s = s.withColumn("h", F.sha2(F.concat_ws("|", "seed", F.col("sack").cast("string")), 256))
    w = Window.partitionBy("lot_id").orderBy("h", "sack")
    kept = s.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= F.least(F.lit(k), F.col("sacks")))
    layer = F.array(*[F.lit(x) for x in LAYERS])
    return kept.select("lot_id", "draw", "sack", F.get(layer, (F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % 3).cast("int")).alias("layer"))


def suggested_draws(n) -> Column:
    """At least 3, otherwise the square root rounded up and never more than there are."""
    return F.greatest(F.lit(3), F.least(num(n), F.ceil(F.sqrt(num(n)))))


def stride_cap(images: DataFrame, cap: int, by: Sequence[str], order: str = "id") -> DataFrame:
    """Every ceil(size/cap)-th row of cells larger than the cap."""
    idx = _cell_size(row_index(images, order, by, "_rn"), by)
    stride = F.when(F.col("_n") > cap, F.ceil(F.col("_n") / cap)).otherwise(F.lit(1))
    return idx.where((F.col("_rn") - 1) % stride == 0).select(*images.columns)


def shard(images: DataFrame, index: int, of: int, order: str = "id") -> DataFrame:
    return images.where(F.col(order) % of == index)


def capped_balance(image_classes: DataFrame, caps: dict[str, int], sound: str = "sound") -> DataFrame:
    """Images kept by running caps, those with most defect classes first, ties by image_id: (image_id, n_defects).

    image_classes(image_id, class). An image is kept while one of its defect classes is below its cap; it then uses up the
    caps of all its classes. Images without a defect fill what is left of the sound cap, in order of image_id. The rule
    only changes when a class fills, which happens once per class: each round finds the next place where one does, from
    at most cap images per class, and no image passes through the driver.
    """
    images = (image_classes.where(F.col("class").isin(*caps)).groupBy("image_id").agg(F.collect_set("class").alias("has"))
              .select("image_id", "has", (F.size("has") - F.array_contains("has", sound).cast("int")).cast("long").alias("n_defects")))
    left, open_, after, kept = {sound: 0} | caps, [c for c in caps if c != sound and caps[c] > 0], F.lit(True), []
    rich = images.where("n_defects > 0")

    def use(rows: DataFrame) -> None:
        for r in rows.select(F.explode("has").alias("class")).groupBy("class").agg(F.count("*").alias("n")).collect():  # a row per class
            left[r["class"]] -= r.n
    while open_:
        taken = rich.where(after & F.arrays_overlap("has", F.array(*map(F.lit, open_))))
        rows = taken.select("image_id", "n_defects", F.explode("has").alias("class")).where(F.col("class").isin(*open_))
        w = Window.partitionBy("class").orderBy(F.desc("n_defects"), "image_id")
        limit = F.expr("CASE class " + " ".join(f"WHEN '{c}' THEN {left[c]}" for c in open_) + " END")
        top = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max(left[c] for c in open_))
        full = top.where(F.col("_k") == limit).orderBy(F.desc("n_defects"), "image_id").select("n_defects", "image_id").first()
        if full is None:
            kept.append(taken)
            use(taken)
            break
        upto = (F.col("n_defects") > full.n_defects) | (F.col("n_defects") == full.n_defects) & (F.col("image_id") <= F.lit(full.image_id))
        kept.append(taken.where(upto))
        use(kept[-1])
        open_, after = [c for c in open_ if left[c] > 0], ~upto
    out = images.where("n_defects = 0").orderBy("image_id").limit(max(0, left[sound]))
    for part in kept:
        out = out.union(part)
    return out.select("image_id", "n_defects")


def hash_holdout(key, share: float = 0.1) -> Column:
    """Stable holdout flag from an md5 of the key."""
    bucket = F.conv(F.substring(F.md5(num(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    return F.when(bucket < int(share * 100), "holdout").otherwise("train")


def group_cap(images: DataFrame, cap: int, by: Sequence[str], order: str = "id") -> DataFrame:
    """First ``cap`` rows of each group."""
    w = Window.partitionBy(*by).orderBy(order)
    return images.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k")


def inverse_frequency_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    n = rows.groupBy(label).agg((F.lit(1.0) / F.count(F.lit(1))).alias("weight"))
    return rows.join(n, label)


# Corrected buckets that make a training label.
CORRECTION_LABELS = {"REJECT": 1, "GRADE_A": 0, "URS": 0}


def correction_labels(corrections: DataFrame, id_offset: int = 9_000_000) -> DataFrame:
    """Training rows from human corrections; contests carry no label and drop out."""
    label = F.expr("CASE to_bucket " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CORRECTION_LABELS.items()) + " END")
    x = corrections.withColumn("label", label).where(F.col("label").isNotNull())
    n = row_index(x, "correction_id", (), "_rn")
    return n.select((F.col("_rn") - 1 + id_offset).alias("image_id"), "label", F.lit("field").alias("variety"), F.lit("single").alias("qty"),
                    F.lit("train").alias("split"), "correction_id")


def cross_split_leakage(images: DataFrame) -> DataFrame:
    """Hashes present in more than one split."""
    return images.groupBy("hash").agg(F.count_distinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n_images")).where(F.col("n_splits") > 1)


#: Ways to cut 64 bits into groups, coarse to fine, and candidate pairs per hash and choice of groups that ask for the next one.
GROUPS, PAIRS_PER_HASH = (8, 9, 10, 12), 4


def near_duplicates(hashes: DataFrame, distance: int = 5, groups: int | None = None) -> DataFrame:
    """Pairs of distinct 64-bit hashes (16 hex digits) within a Hamming distance of at most 5: a, b, distance.

    Copies are collapsed first. With the bits cut into r groups, two hashes within the distance agree in at least
    r - distance of them, so hashes meet on the bits of every choice of so many groups and no pair is lost; a pair is kept
    under the first choice it shares only, so it appears once without a distinct. More groups mean longer keys: r grows
    until the keys, as counted, make few candidates per hash, so that hashes crowded on some bits meet on others.
    """
    if not 0 <= distance <= 5:
        raise ValueError("distance must be between 0 and 5")
    number = "shiftleft(CAST(conv(substr(hash, 1, 8), 16, 10) AS BIGINT), 32) | CAST(conv(substr(hash, 9, 8), 16, 10) AS BIGINT)"
    h = hashes.select("hash").distinct().selectExpr(f"{number} AS h")
    for r in GROUPS if groups is None else (groups,):
        cuts = [64 * i // r for i in range(r + 1)]
        parts = [((1 << cuts[i + 1]) - (1 << cuts[i])) for i in reversed(range(r))]
        parts = [m - (1 << 64) if m >> 63 else m for m in parts]
        choices = list(combinations(range(r), r - distance))
        masks = ", ".join(f"{sum(parts[i] for i in x)}L" for x in choices)
        keyed = h.selectExpr("h", f"posexplode(transform(array({masks}), m -> h & m)) AS (c, k)")
        if groups is not None or r == GROUPS[-1]:
            break
        load = keyed.groupBy("c", "k").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum("n") / len(choices)).first()
        if (load[0] or 0) <= PAIRS_PER_HASH * len(choices) * (load[1] or 0):
            break
    # Groups before the choice's last one that it leaves out: the first choice of a pair leaves out only groups that differ.
    out = ", ".join("array(" + ", ".join(f"{parts[i]}L" for i in range(x[-1] if x else 0) if i not in x) + ")" if x and x[-1] >= len(x) else "CAST(array() AS ARRAY<BIGINT>)" for x in choices)
    # The planner does not know how many keys a hash has and would broadcast them all.
    pairs = keyed.selectExpr("c", "k", "h AS a").join(keyed.selectExpr("c", "k", "h AS b").hint("merge"), ["c", "k"]).where("a < b").selectExpr("c", "a", "b", "CAST(bit_count(a ^ b) AS INT) AS distance")
    first = pairs.where(F.col("distance") <= distance).where(F.expr(f"forall(array({out})[c], g -> ((a ^ b) & g) <> 0)"))
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    # Hexadecimal order is that of unsigned numbers.
    return first.select(F.least(text("a"), text("b")).alias("a"), F.greatest(text("a"), text("b")).alias("b"), "distance")


def class_balance(boxes: DataFrame, minimum: int = 150) -> DataFrame:
    """Boxes per class and split (rollup), with share of all and an under-represented flag on class totals."""
    name = F.expr("CASE cls " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLASS_NAMES)) + " ELSE concat('UNKNOWN_', cls) END")
    r = boxes.withColumn("class", name).rollup("class", "split").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    total = boxes.agg(F.count(F.lit(1)).alias("t")).scalar()
    return r.where(F.col("g") < 3).select("class", F.when(F.col("g") == 1, "all").otherwise(F.col("split")).alias("split"), "n", (F.col("n") * 100.0 / total).alias("share"),
                                          ((F.col("g") == 1) & (F.col("n") < minimum)).alias("under"), F.col("class").startswith("UNKNOWN_").alias("unknown"))


def box_count_outliers(boxes: DataFrame, low: int = 5, high: int = 60) -> DataFrame:
    return boxes.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_boxes")).where((F.col("n_boxes") < low) | (F.col("n_boxes") > high))


def qa_verdict(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Blocking problems of a dataset: leaked hashes, unknown classes, unlabelled images. One row."""
    from lotlens.operators.joins import without_labels
    leaks = cross_split_leakage(images).agg(F.count(F.lit(1)).alias("n")).scalar()
    unknown = boxes.agg(F.count_distinct(F.when((F.col("cls") >= len(CLASS_NAMES)) | (F.col("cls") < 0), F.col("cls"))).alias("n")).scalar()
    bare = without_labels(images, boxes).agg(F.count(F.lit(1)).alias("unlabelled"))
    out = bare.withColumn("leaks", leaks).withColumn("unknown_classes", unknown)
    blockers = F.col("leaks") + F.col("unknown_classes") + F.col("unlabelled")
    return out.select("leaks", "unknown_classes", "unlabelled", blockers.alias("blockers"), F.when(blockers == 0, "safe to train").otherwise("fix before training").alias("verdict"))
