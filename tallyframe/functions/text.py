"""Paths, label lines and class names as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of frame images.
IMAGES = ("jpg", "jpeg")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def frame_id(path: Column) -> Column:
    """The number before the first dot of a file name."""
    return F.substring_index(basename(path), ".", 1).try_cast("long")


def is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1)).isin(*IMAGES)


def natural(path: Column) -> list[Column]:
    """Sorting keys by which names with one prefix come in numeric order."""
    return [F.length(path), path]


def sibling(path: Column, folder: str, extension: str | None = None, of: str = "images") -> Column:
    """The path of a frame's other file: all occurrences of the folder and the extension are replaced."""
    out = F.replace(path, F.lit(of), F.lit(folder))
    return out if extension is None else F.replace(out, F.lit("jpg"), F.lit(extension))


def lines(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def last_class(line: Column, separator: str = ",") -> Column:
    """The class id that ends a line, written as a float."""
    return F.element_at(F.split(line, separator), -1).cast("double").cast("int")


def detection_line(*values: Column) -> Column:
    """Numbers joined by commas."""
    return F.concat_ws(",", *(v.cast("string") for v in values))


def elapsed_parts(seconds: Column) -> tuple[Column, Column, Column]:
    """Days, seconds and microseconds of a duration."""
    days = F.floor(seconds / 86400)
    whole = F.floor(seconds) - days * 86400
    return days.cast("long"), whole.cast("long"), F.floor((seconds - F.floor(seconds)) * 1e6 + 0.5).cast("long")
