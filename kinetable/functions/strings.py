"""String, path and JSON helpers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def last_number(s: Column) -> Column:
    """Trailing digits as a number; NULL if there are none."""
    return F.regexp_extract(s, "([0-9]+)$", 1).try_cast("bigint")


def fixed_length(n: Column, length: int) -> Column:
    """Zero-padded number; NULL when it needs more digits or is negative."""
    text = n.cast("string")
    return F.when((n >= 0) & (F.length(text) <= length), F.lpad(text, length, "0"))


def split_on(s: Column, delimiter: str) -> Column:
    return F.split(s, r"\Q" + delimiter + r"\E")


def strip_leading_zeros(s: Column) -> Column:
    """Zeros in front of another digit go; a single zero stays."""
    return F.regexp_replace(s, "^0+([0-9])", "$1")


def leading_number(s: Column) -> Column:
    return F.regexp_extract(s, "^([0-9]*)", 1)


def natural_key(s: Column) -> Column:
    """Sort key: digits before other characters, numbers by value, letters without case."""
    runs = F.regexp_extract_all(F.upper(s), F.lit("([0-9]+|[^0-9]+)"), 1)

    def token(t):
        number = strip_leading_zeros(t)
        return F.when(
            t.rlike("^[0-9]"), F.concat(F.lit("\x01"), F.lpad(F.length(number).cast("string"), 4, "0"), number)
        ).otherwise(t)

    return F.array_join(F.transform(runs, token), "")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)[^/]*$", 1)


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    return F.lower(extension(path)).isin(*[e.lower().lstrip(".") for e in extensions])


def clean_name(s: Column) -> Column:
    """Only letters and digits, lower case."""
    return F.lower(F.regexp_replace(s, "[^0-9A-Za-z]", ""))


def remove_substring(s: Column, part: str) -> Column:
    """Remove ``part`` until none is left, including ones formed by a removal."""
    n = len(part)

    def push(acc, ch):
        grown = F.concat(acc, ch)
        return F.when(F.endswith(grown, F.lit(part)), F.left(grown, F.length(grown) - n)).otherwise(grown)

    folded = F.aggregate(F.split(s, ""), F.lit(""), push)
    return F.when(F.contains(s, F.lit(part)), folded).otherwise(s)


def replace_char(s: Column, old: str, new: str) -> Column:
    return F.translate(s, old, new)


def stable_hash(salt: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt), key.cast("string")), 256)


def label_from_name(name: Column) -> Column:
    """Label named inside a recording name; NULL (to be dropped) otherwise."""
    return F.when(F.contains(name, F.lit("_fall_")), "fall").when(F.contains(name, F.lit("_normal_")), "normal")


# Fixed value: archive directory pattern and category codes.
ARCHIVE_PATTERN = "^(nf|f)_mask_([bcs])_([0-9])_(?:keypoints|ketpoints)_csv$"
CATEGORIES = {"b": "bed", "c": "chair", "s": "stand"}


def parse_clip_id(archive: Column, clip: Column, prefix: str) -> Column:
    """Struct (label, category, archive, video_id); NULL when the archive name does not match."""
    from .columns import literal_map

    def part(i):
        return F.regexp_extract(archive, ARCHIVE_PATTERN, i)

    label = F.when(part(1) == "nf", "normal").otherwise("fall")
    category = literal_map(CATEGORIES)[part(2)]
    video = F.concat(F.lit(prefix), F.lit("_"), label, F.lit("_"), category, F.lit("_a"), part(3), F.lit("_"), F.lower(clip))
    return F.when(
        archive.rlike(ARCHIVE_PATTERN),
        F.struct(label.alias("label"), category.alias("category"), part(3).alias("archive"), video.alias("video_id")),
    )


def parse_variant_label(s: Column) -> Column:
    """``LABEL=PATH`` as struct (label, path); NULL unless both sides are non-blank."""
    at = F.instr(s, "=")
    label, path = F.trim(F.left(s, at - 1)), F.substring(s, at + 1, F.length(s))
    return F.when((at > 0) & (label != "") & (F.trim(path) != ""), F.struct(label.alias("label"), path.alias("path")))
