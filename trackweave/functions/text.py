"""Labels, numbers read from images, and class names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.sources.court_template import TEMPLATE

#: Letters that look like digits, and these digits.
LETTERS, DIGITS = "OoQIli|ZSsB", "00011112558"
#: Class names are matched as parts of the name, in this order.
CLASS_PARTS = (("player", 3), ("referee", 8), ("ref", 8), ("ball", 0), ("basketball", 0), ("rim", 9), ("hoop", 9))
UNKNOWN_CLASS = 99
REFEREE_OFFSET = 1000
GOLDEN, SATURATION, VALUE = 0.618033988749895, 0.85, 0.95


def clean_number(text: Column) -> Column:
    """Letters that look like digits become digits, anything else goes, two digits stay; nothing left gives NULL."""
    looked = F.translate(text, LETTERS, DIGITS)
    out = F.substring(F.regexp_replace(looked, "[^0-9]", ""), 1, 2)
    return F.when(out == "", F.lit(None)).otherwise(out)


def class_of(name: Column, raw: Column) -> Column:
    """Class id of a name: the first part that it contains, else the raw id, else the unknown class."""
    out = F.lit(None).cast("int")
    for part, number in reversed(CLASS_PARTS):
        out = F.when(F.contains(F.lower(name), F.lit(part)), F.lit(number)).otherwise(out)
    return F.coalesce(out, raw, F.lit(UNKNOWN_CLASS))


def keypoint_label(*fields: Column) -> Column:
    """The label of a keypoint: the digits of the first of its name fields that has any, padded to two; longer ones stay whole."""
    def padded(field: Column) -> Column:
        digits = F.regexp_replace(field, "[^0-9]", "")
        return F.when(digits == "", F.lit(None)).when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)

    return F.coalesce(*(padded(f) for f in fields), F.lit(None).cast("string"))


def raw_index(class_id: Column, name: Column, keypoint_id: Column, position: Column, base: int = 0) -> Column:
    """The index that a model gives a keypoint: the first of its fields that is there, or its position if that is no whole number."""
    first = F.coalesce(*(c.cast("string") for c in (class_id, name, keypoint_id)))
    return F.coalesce(first.try_cast("bigint"), position.cast("bigint")) - base


def keypoint_index(label: Column, raw: Column, values: Column | None = None) -> Column:
    """The template's index of a keypoint, by its label, or else by the raw index where that is one of the template's; -1 if neither is.
    With `values` (an array over the template) the entry there instead."""
    labels = F.array(*(F.lit(row[0]) for row in TEMPLATE))
    at = F.coalesce(F.when(F.array_position(labels, label) > 0, F.array_position(labels, label) - 1), F.when(raw.between(0, len(TEMPLATE) - 1), raw), F.lit(-1)).cast("bigint")
    return at if values is None else F.when(at < 0, F.lit(-1)).otherwise(F.get(values, at.cast("int"))).cast("bigint")


def old_index(label: Column, raw: Column) -> Column:
    """The index of a keypoint in the older model; -1 if it has none there."""
    return keypoint_index(label, raw, F.array(*(F.lit(row[3]) for row in TEMPLATE)))


def confidence_of(confidence: Column, conf: Column) -> Column:
    """The first confidence that is there; 1 if none is, 0 if it isn't a number."""
    raw = F.coalesce(confidence, conf)
    return F.when(raw.isNull(), F.lit(1.0)).otherwise(F.coalesce(raw.try_cast("double"), F.lit(0.0)))


def display_label(track_id: Column, jersey: Column, is_referee: Column) -> Column:
    return F.when(is_referee, F.lit("REF")).otherwise(F.coalesce(F.concat(F.lit("#"), jersey), track_id.cast("string")))


def role_id(track_id: Column, is_referee: Column) -> Column:
    """Referee ids are set apart by an offset."""
    return F.when(is_referee, track_id + REFEREE_OFFSET).otherwise(track_id)


def hue(track_id: Column) -> Column:
    """A hue from 0 to 1 for an id: golden-ratio steps over 60 ids."""
    v = (track_id % 60) * F.lit(GOLDEN)
    return v - F.floor(v)


def color(track_id: Column) -> Column:
    """0xRRGGBB of the id's hue, cut to integers."""
    h6 = hue(track_id) * 6
    sector, part = F.floor(h6).cast("int"), h6 - F.floor(h6)
    shade = lambda v: F.floor(v * 255).cast("long")
    up, down = shade(VALUE * (1.0 - SATURATION * (1.0 - part))), shade(VALUE * (1.0 - SATURATION * part))
    rgb = lambda r, g, b: r * 65536 + g * 256 + b
    full, none = shade(F.lit(VALUE)), shade(F.lit(VALUE) * (1.0 - SATURATION))
    return (
        F.when(sector == 0, rgb(full, up, none)).when(sector == 1, rgb(down, full, none)).when(sector == 2, rgb(none, full, up))
        .when(sector == 3, rgb(none, down, full)).when(sector == 4, rgb(up, none, full)).otherwise(rgb(full, none, down))
    )
