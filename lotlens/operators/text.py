"""Text, time and number hygiene for submitted records, label names, search, evidence lists."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lotlens import schema
from lotlens.functions.numeric import num

# Control characters except tab, newline and carriage return; explicit bidirectional formatting controls.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F‪-‮⁦-⁩]"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode canonical composition; Spark has no built-in normaliser."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def clean_text(value, max_len: int, normalise: bool = True) -> list[Column]:
    """(text, error): control and bidi characters removed, NFC, over-limit rejected before trimming."""
    raw = F.coalesce(num(value), F.lit(""))
    stripped = F.regexp_replace(raw, CONTROL, "")
    text = nfc(stripped) if normalise else stripped
    long = F.char_length(text) > max_len
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return [F.when(~long, trimmed).alias("text"), F.when(long, F.lit("too long")).alias("error")]


def trusted_time(client, server, tolerance_seconds: int = 86400) -> list[Column]:
    """(trusted_at, reason): the client time if readable and within tolerance of the server, else server time."""
    raw, now = num(client), num(server)
    blank = F.trim(raw) == ""
    parsed = F.try_to_timestamp(F.trim(raw))
    skewed = F.abs(F.unix_timestamp(parsed) - F.unix_timestamp(now)) > tolerance_seconds
    reason = (F.when(raw.isNull(), F.lit(None).cast("string")).when(blank, "not usable text").when(parsed.isNull(), "unreadable")
              .when(skewed, "clock off by more than the tolerance"))
    at = F.when(raw.isNull() | reason.isNotNull(), now).otherwise(parsed)
    return [at.alias("trusted_at"), reason.alias("reason")]


def finite_or_reject(value) -> list[Column]:
    """(number, error) from submitted text: blank is absent, unreadable and non-finite values are refused."""
    raw = F.trim(num(value))
    present = raw.isNotNull() & (raw != "")
    v = raw.try_cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    error = F.when(present & v.isNull(), "not a number").when(present & ~finite, "not finite")
    return [F.when(present & finite, v).alias("number"), error.alias("error")]


# External label names and the class they map to; the first contained name wins.
LABEL_MAP = (("rotten", "rotten"), ("rot", "rotten"), ("sprout", "sprouted"), ("sprouted", "sprouted"),
             ("blacksmut", "black_smut"), ("blacksmutinfected", "black_smut"), ("black_smut", "black_smut"),
             ("damaged", "damaged_skin"), ("discoloured", "damaged_skin"), ("good", "sound"), ("healthy", "sound"),
             ("mold", "black_smut"))


def remap_label(name, mapping=LABEL_MAP) -> Column:
    """Class of an external label, NULL when nothing matches. A data set's own names come as further (name, class) pairs."""
    clean = F.regexp_replace(F.lower(num(name)), r"[-_ ]", "")
    out = None
    for source, dest in mapping:
        hit = clean.contains(source.replace("_", ""))
        out = F.when(hit, dest) if out is None else out.when(hit, dest)
    return out


def polygon_to_box(coords) -> Column:
    """struct(xc, yc, w, h): four numbers are a box already, longer lists are x,y pairs."""
    c = num(coords)
    xs, ys = F.filter(c, lambda _, i: i % 2 == 0), F.filter(c, lambda _, i: i % 2 == 1)
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    box = F.struct(c[0].alias("xc"), c[1].alias("yc"), c[2].alias("w"), c[3].alias("h"))
    hull = F.struct(((x0 + x1) / 2).alias("xc"), ((y0 + y1) / 2).alias("yc"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))
    return F.when(F.size(c) == 4, box).otherwise(hull)


def search_lots(lots: DataFrame, q: str, state: str = "all") -> DataFrame:
    """Case-folded substring over farmer, lot, variety and centre; state is all, signed, draft or refer."""
    s = q.strip().lower()
    text = F.lower(F.concat_ws(" ", "farmer_ref", F.col("lot_id").cast("string"), "variety", "centre"))
    cond = {"all": F.lit(True), "signed": F.col("receipt_hash").isNotNull(), "draft": F.col("receipt_hash").isNull(),
            "refer": F.col("decision") == "REFER_TO_HUMAN"}[state]
    return lots.where(cond & (text.contains(s) if s else F.lit(True)))


# Photo evidence limits.
SHOT_PREFIX, MAX_SHOT_BYTES, MAX_SHOTS = "data:image/jpeg;base64,", 512 * 1024, 12


def valid_shots(lots: DataFrame, shots: str = "shots", max_shots: int = MAX_SHOTS) -> DataFrame:
    """One row per readable photo among the first ``max_shots``: lot_id, look_index, tray_id, n_bytes."""
    s = lots.select("lot_id", F.posexplode(F.slice(shots, 1, max_shots)).alias("look_index", "s"))
    body = F.when(F.col("s.annotated").startswith(SHOT_PREFIX), F.substring(F.col("s.annotated"), len(SHOT_PREFIX) + 1, 2**31 - 1))
    size = F.octet_length(F.try_to_binary(body, F.lit("base64")))
    return (s.withColumn("n_bytes", size).where((F.col("n_bytes") > 0) & (F.col("n_bytes") <= MAX_SHOT_BYTES))
            .select("lot_id", "look_index", F.coalesce("s.tray_id", F.lit("")).alias("tray_id"), "n_bytes"))


def shot_counts(lots: DataFrame, shots: str = "shots", max_shots: int = MAX_SHOTS) -> DataFrame:
    """Valid and skipped photos per lot."""
    kept = valid_shots(lots, shots, max_shots).groupBy("lot_id").agg(F.count(F.lit(1)).alias("n_valid"))
    seen = lots.select("lot_id", F.least(F.coalesce(F.size(shots), F.lit(0)), F.lit(max_shots)).alias("n_seen"))
    j = seen.join(kept, "lot_id", "left").withColumn("n_valid", F.coalesce("n_valid", F.lit(0).cast("bigint")))
    return j.select("lot_id", "n_valid", (F.col("n_seen") - F.col("n_valid")).alias("n_skipped"))


def parse_manifest(text) -> Column:
    """Evidence list from JSON text: the objects of a JSON array, whatever fields they have.

    Unreadable text, or JSON that is no array, gives an empty list; elements that are no objects are dropped.
    """
    body = F.trim(num(text))
    elements = F.from_json(F.when(body.startswith("["), body), "array<string>")
    objects = F.filter(F.coalesce(elements, F.array().cast("array<string>")), lambda e: F.coalesce(F.ltrim(e).startswith("{"), F.lit(False)))
    return F.transform(objects, lambda e: F.from_json(e, schema.MANIFEST.elementType))


SNAPSHOT_COLUMNS = ("id", "lot_id", "look_index", "cls", "confidence", "diameter_mm", "size_grade", "decision", "disputed")


def bulb_snapshot(bulbs: DataFrame, lot_id=None) -> DataFrame:
    """The public columns of one lot's items, or of every lot."""
    return (bulbs if lot_id is None else bulbs.where(F.col("lot_id") == lot_id)).select(*SNAPSHOT_COLUMNS)
