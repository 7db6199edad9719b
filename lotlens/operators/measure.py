"""Per-item measurement columns: quantisation, size and weight models, flags, gates, legacy grades."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.numeric import half_up, num
from lotlens.functions.ordered import row_index
from lotlens.sources.packs import DEFECTS


def usable_bulbs(captures: DataFrame, time: str = "at") -> DataFrame:
    """Explode captures(lot_id, capture_id, tray, look, at, bulbs[]), drop excluded items, number the rest b0..bN.

    Numbering follows capture time, then capture id and position inside the capture. Text times are ISO 8601 in one zone,
    whose order as text is that in time; those that are no time come first.
    """
    flat = (captures.select("lot_id", "capture_id", "tray", "look", time, F.posexplode("bulbs").alias("pos", "b"))
            .where(F.col("b.excluded").isNull()))
    order, tie = time, ["capture_id", "pos"]
    if flat.schema[time].dataType.typeName() == "string":
        order, tie = "_time", [time, *tie]
        flat = flat.withColumn(order, F.try_to_timestamp(F.col(time)))
    numbered = row_index(flat, order, ["lot_id"], "_rn", tie=tie)
    return numbered.select("lot_id", F.concat(F.lit("b"), (F.col("_rn") - 1).cast("string")).alias("bulb_id"), "capture_id",
                           "pos", "tray", "look", "b.*").drop("excluded")


def quantise(bulbs: DataFrame) -> DataFrame:
    """Millimetres, shares and grams to the integer units that rules compare (half-up; sd at least 1, weight capped)."""
    i = lambda c, k: half_up(F.col(c) * float(k)).cast("int")
    cap = lambda c: F.least(F.lit(65535), i(c, 10))
    drop = {"min_mm", "max_mm", "sd_mm", "fsd", "conf", "weight_g", "weight_sd_g", *(f"{d}_share" for d in DEFECTS)}
    return bulbs.select(*[c for c in bulbs.columns if c not in drop], i("min_mm", 10).alias("size_min"), i("max_mm", 10).alias("size_max"),
                        F.greatest(F.lit(1), i("sd_mm", 10)).alias("size_sd"), *[i(f"{d}_share", 1000).alias(d) for d in DEFECTS],
                        i("fsd", 1000).alias("fsd"), i("conf", 1000).alias("conf"), cap("weight_g").alias("w"), cap("weight_sd_g").alias("wsd"))


def height_correct(d, camera_height) -> Column:
    """Diameter at the equator from the plane-scale diameter; unchanged without a camera height."""
    d, h = num(d), num(camera_height)
    return F.when(h > 0, d / (F.lit(1.0) + d / (h * 2.0))).otherwise(d)


# Relative scale uncertainty per calibration tier.
TIER_SCALE_SD = {"aruco": 0.006, "a4": 0.015, "coin": 0.03, "intrinsics": 0.25}
EDGE_JITTER_PX = 1.5


def size_sigma(d, tier, mm_per_px, camera_height, camera_height_sd) -> Column:
    """Root sum of squares of scale, boundary and camera-height uncertainty, in mm."""
    d, h, tier = num(d), num(camera_height), num(tier)
    per_tier = F.create_map(*[F.lit(x) for kv in TIER_SCALE_SD.items() for x in kv])
    scale = d * per_tier[tier]
    edge = num(mm_per_px) * EDGE_JITTER_PX
    height = F.when(h > 0, d * d / (h * h * 2.0) * num(camera_height_sd)).otherwise(F.lit(0.0))
    return F.sqrt(scale * scale + edge * edge + height * height)


# Sphere of density 0.95 g/cm3.
WEIGHT_A, WEIGHT_B, WEIGHT_SD = 0.95 * math.pi / 6 / 1000, 3.0, 0.18


def predict_weight(d, a: float = WEIGHT_A, b: float = WEIGHT_B, residual_sd: float = WEIGHT_SD) -> tuple[Column, Column]:
    """Weight in grams a*d^b and its standard deviation."""
    g = F.lit(a) * F.pow(num(d), F.lit(b))
    return g, g * residual_sd


def fold_second_opinion(bulbs: DataFrame, p: str = "p1", high: float = 0.7, gate: float = 0.0) -> DataFrame:
    """Fold a classifier's probability of "unhealthy" into measured shares.

    Below the gate the known shares are cleared; a confident "unhealthy" without measured rot or blackening lowers the
    confidence so that a person looks.
    """
    gated = F.col(p) < gate
    bad = F.coalesce(F.col("rot_share"), F.lit(0.0)) + F.coalesce(F.col("blackening_share"), F.lit(0.0))
    disagree = ~gated & (F.col(p) >= high) & (bad < 0.01)
    out = bulbs.withColumn("gated", gated).withColumn("disagree", disagree)
    out = out.withColumn("conf", F.when(F.col("disagree"), F.least(F.col("conf"), F.lit(0.45))).otherwise(F.col("conf")))
    for d in DEFECTS:
        c = F.col(f"{d}_share")
        out = out.withColumn(f"{d}_share", F.when(F.col("gated") & c.isNotNull(), F.lit(0.0)).otherwise(c))
    return out


def logit_probability(z_healthy, z_unhealthy) -> Column:
    """Two-class softmax probability of the second class."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(num(z_healthy) - num(z_unhealthy)))


# Item size window (mm) and shape limits.
MIN_MM, MAX_MM, MAX_ASPECT, MIN_SOLIDITY, GREEN_SHARE = 22.0, 120.0, 3.0, 0.6, 0.6
DOUBLE_SOLIDITY, SPLIT_SOLIDITY, NECK_ASPECT, NECK_SHARE, CONF_MIN_PX = 0.86, 0.78, 1.3, 0.12, 900


def exclusion_reason(edge="edge", tier="tier", min_mm="min_mm", max_mm="max_mm", green="sprouting_share", aspect="aspect",
                     solidity="solidity") -> Column:
    """edge, then small (outside the size window, real scale only), then shape; NULL keeps the item."""
    out_of_window = (num(tier) != "intrinsics") & ((num(max_mm) < MIN_MM) | (num(min_mm) > MAX_MM))
    return (F.when(num(edge), "edge").when(out_of_window, "small")
            .when(F.coalesce(num(green), F.lit(0.0)) > GREEN_SHARE, "shape")
            .when((num(aspect) > MAX_ASPECT) | (num(solidity) < MIN_SOLIDITY), "shape"))


def shape_flags(solidity="solidity", aspect="aspect", neck="neck_share") -> list[Column]:
    s = num(solidity)
    return [(s < DOUBLE_SOLIDITY).alias("is_double"), (s < SPLIT_SOLIDITY).alias("is_split"),
            ((num(neck) > NECK_SHARE) & (num(aspect) > NECK_ASPECT)).alias("is_bottleneck")]


def confidence(area_px="area_px", solidity="solidity", n_ref="n_ref", tier="tier") -> Column:
    """0.95 less deductions, never under 0.05."""
    less = lambda cond, v: F.when(cond, F.lit(v)).otherwise(F.lit(0.0))
    c = (F.lit(0.95) - less(num(area_px) < CONF_MIN_PX, 0.35) - less(num(solidity) < 0.8, 0.25)
         - less(num(n_ref) < 50, 0.2) - less(num(tier) == "intrinsics", 0.05))
    return F.greatest(F.lit(0.05), c)


# Capture limits.
MIN_SHARP, MIN_LIGHT, MAX_LIGHT, MAX_CLIPPED, MAX_TILT, MIN_ITEMS = 55.0, 25.0, 92.0, 0.12, 12.0, 1


def capture_gates(tilt="tilt", sharp="sharp", light="light", clipped="clipped", target="target_found", items="n_items") -> Column:
    """Six checks in order, as array<struct(id, ok, value, msg)>."""
    tilt, sharp, light, clipped, target, items = map(num, (tilt, sharp, light, clipped, target, items))

    def gate(name, ok, value, msg):
        return F.struct(F.lit(name).alias("id"), ok.alias("ok"), value.cast("double").alias("value"),
                        (F.lit(msg) if isinstance(msg, str) else msg).alias("msg"))
    dark = F.when(light < MIN_LIGHT, "too dark").otherwise("too bright")
    return F.array(
        gate("level", tilt.isNull() | (tilt <= MAX_TILT), F.coalesce(tilt, F.lit(0.0)), "hold the phone level"),
        gate("sharp", sharp >= MIN_SHARP, sharp, "blurred"),
        gate("exposure", (light >= MIN_LIGHT) & (light <= MAX_LIGHT), light, dark),
        gate("glare", clipped <= MAX_CLIPPED, clipped, "glare"),
        gate("target", target, target.cast("int"), "calibration sheet not in view"),
        gate("bulbs", items >= MIN_ITEMS, items, "nothing to grade in view"))


def first_failing_gate(gates) -> Column:
    """Id of the first failed check, NULL when all pass."""
    return F.get(F.filter(num(gates), lambda g: ~g["ok"]), F.lit(0))["id"]


def tilt(beta, gamma) -> Column:
    """Degrees from flat; NULL without both angles."""
    c = F.cos(F.radians(num(beta))) * F.cos(F.radians(num(gamma)))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def capture_verdict(brightness="brightness", sharpness="sharpness") -> list[Column]:
    """blocked, reason (dark / overexposed) and warnings (dim, blurry) of a frame; unmeasured frames pass unchecked."""
    b, s = num(brightness), num(sharpness)
    checked = b.isNotNull() & s.isNotNull()
    reason = F.when(checked & (b < 40.0), "dark").when(checked & (b > 246.0), "overexposed")
    warn = F.array_compact(F.array(F.when(checked & reason.isNull() & (b < 70.0), "dim"),
                                   F.when(checked & reason.isNull() & (s < 20.0), "blurry")))
    return [checked.alias("checked"), reason.isNotNull().alias("blocked"), reason.alias("reason"), warn.alias("warnings")]


# Size bands in mm, accept threshold, class names.
CLASS_NAMES = ("sound", "rotten", "sprouted", "black_smut", "damaged_skin", "doubles")
GRADES = ("A", "B", "C", "UNDERSIZED", "UNKNOWN")
ACCEPT_THRESHOLD = 0.75


def size_grade(mm="diameter_mm") -> Column:
    """Size band; lower edges belong to the band, unknown diameters get their own band."""
    d = num(mm)
    return (F.when(d.isNull(), "UNKNOWN").when(d >= 80.0, "A").when(d >= 50.0, "B").when(d >= 30.0, "C")
            .otherwise("UNDERSIZED"))


def decide(conf="confidence", threshold: float = ACCEPT_THRESHOLD) -> Column:
    return F.when(num(conf) >= threshold, "ACCEPT").otherwise("REFER")


def class_name(raw="cls") -> Column:
    """Class from an index or a name; anything else counts as sound."""
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    index = num(raw).try_cast("int")
    by_index = F.when((index >= 0) & (index < len(CLASS_NAMES)), F.get(names, index))
    by_name = F.when(num(raw).isin(*CLASS_NAMES), num(raw))
    return F.coalesce(by_name, by_index, F.lit("sound"))


def box_sanity(w, h, tiny: float = 0.001, huge: float = 0.20) -> Column:
    """tiny / huge / ok by box area as a share of the image."""
    area = num(w) * num(h)
    return F.when(area < tiny, "tiny").when(area > huge, "huge").otherwise("ok")


# Grade-A surface limits used when screening photos.
GRADE_A_SHARES = {"blackening": 0.05, "spots": 0.1, "sunburn": 0.02, "peeled": 0.1, "rot": 0.01, "sprouting": 0.01}


def fails_grade_a(suffix: str = "_share") -> Column:
    """Any share above its limit, unknown shares counting as none."""
    return F.expr("(" + " OR ".join(f"coalesce({m}{suffix}, 0D) > {v}D" for m, v in GRADE_A_SHARES.items()) + ")")


# Confidence attached to each source of scale, and the floor for certified sizes.
SCALE_CONFIDENCE = {"homography": 1.0, "homography_weak": 0.85, "single_marker": 0.70, "carried": 0.40, "mat_edge": 0.25,
                    "none": 0.0}
CERTIFY_ABOVE = 0.35


def certifiable(source="scale_source", calibrated="calibrated") -> list[Column]:
    """Scale confidence by source and whether sizes may be certified."""
    table = F.create_map(*[F.lit(x) for kv in SCALE_CONFIDENCE.items() for x in kv])
    conf = F.coalesce(table[num(source)], F.lit(0.0))
    return [conf.alias("scale_confidence"), (num(calibrated) & (conf > CERTIFY_ABOVE)).alias("certifiable")]
