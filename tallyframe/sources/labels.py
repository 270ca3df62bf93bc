"""Files of paths, labels, boxes, counts, distributions, timings and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Fields of a detection line.
DETECTION = ("x1", "y1", "x2", "y2", "obj_conf", "cls_conf", "class_id")
COUNTS = "timestamp long, count int, image_path string"
UNCERTAIN = "timestamp long, prob array<double>, image_path string"


def path_list(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path and frame_id of a list of images; `most` keeps the first ones in numeric order of names."""
    lines = spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")
    out = lines.select("path", X.frame_id(F.col("path")).alias("frame_id"))
    return out if most is None else out.orderBy(*X.natural(F.col("path"))).limit(most)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, frame_id and content of the images in a folder."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.filter(X.is_image(F.col("path"))).withColumn("frame_id", X.frame_id(F.col("path")))


def whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of each file of a folder."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def detection_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each line of a folder's files, one for each frame, whose name tells it."""
    return parsed_detections(whole_texts(spark, folder))


def parsed_detections(files: DataFrame) -> DataFrame:
    """frame_id, rank and the fields of each line of files (path, text)."""
    own = files.select(X.frame_id(F.col("path")).alias("frame_id"), F.posexplode(X.lines(F.col("text"))).alias("rank", "line"))
    parts = F.split("line", ",")
    cast = lambda i, c: F.get(parts, F.lit(i)).cast("double").cast("int" if c == "class_id" else "double").alias(c)
    return own.select("frame_id", "rank", *(cast(i, c) for i, c in enumerate(DETECTION)))


def truth_files(spark: SparkSession, folder: str) -> DataFrame:
    """frame_id, rank, class_id, xc, yc, w, h of files of normalised boxes."""
    return parsed_truth(whole_texts(spark, folder))


def parsed_truth(files: DataFrame) -> DataFrame:
    """The same of files (path, text)."""
    own = files.select(X.frame_id(F.col("path")).alias("frame_id"), F.posexplode(X.lines(F.col("text"))).alias("rank", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    return own.select("frame_id", "rank", F.get(parts, F.lit(0)).cast("int").alias("class_id"), *(F.get(parts, F.lit(i)).cast("double").alias(c) for i, c in enumerate(("xc", "yc", "w", "h"), 1)))


def class_names(text: str) -> list[str]:
    """Names by id from a file's text; only an empty last line is left out."""
    names = text.split("\n")
    return names[:-1] if names and names[-1] == "" else names


def class_table(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, n.strip()) for i, n in enumerate(names)], "class_id int, class_name string")


def class_id(names: list[str], name: str) -> int:
    """The id of a name, whatever its case and surrounding space; an unknown one is an error."""
    known = [n.strip().lower() for n in names]
    if name.strip().lower() not in known:
        raise ValueError(f"no class {name!r}")
    return known.index(name.strip().lower())


def count_labels(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """timestamp, count and image_path; `most` keeps the first ones by timestamp."""
    out = records(spark, path, COUNTS)
    return out if most is None else out.orderBy("timestamp").limit(most)


def uncertain_table(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path, UNCERTAIN)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records of files that hold one on each line, or lists of them on lines, such as one list in all.

    Files are read line by line in parallel. A list that is broken over several lines, which none of the writers makes, needs
    Spark's own `multiLine` reader.
    """
    return spark.read.schema(schema).json(path)


def timing(text: str) -> float:
    """Seconds from `key:value` lines of days, seconds and microseconds."""
    parts = dict(line.split(":", 1) for line in text.splitlines() if ":" in line)
    return int(parts["days"]) * 86400 + int(parts["seconds"]) + int(parts["microseconds"]) / 1e6


def timing_text(seconds: float) -> str:
    days, rest = divmod(seconds, 86400)
    return f"days:{int(days)}\nseconds:{int(rest)}\nmicroseconds:{round(rest % 1 * 1e6)}\n"


def timings(spark: SparkSession, path: str) -> DataFrame:
    """baseline and ours, the seconds of inference, from nested JSON records."""
    own = records(spark, path, "baseline struct<inference:double>, ours struct<inference:double>")
    return own.select(F.col("baseline.inference").alias("baseline"), F.col("ours.inference").alias("ours"))


def settings(text: str) -> dict[str, str]:
    """`key=value` lines; comments and blank lines don't count, gpus and num_workers have defaults."""
    out = {"gpus": "0,1,2,3", "num_workers": "10"}
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#"):
            key, _, value = line.partition("=")
            out[key.strip()] = value.strip()
    return out


def network(text: str) -> list[dict[str, str]]:
    """Blocks of a network definition, in order; a block's name is its `type`, and convolutions have batch_normalize 0 unless they say otherwise."""
    blocks: list[dict[str, str]] = []
    for line in map(str.strip, text.splitlines()):
        if not line or line.startswith("#"):
            continue
        if line.startswith("["):
            blocks.append({"type": line.strip("[]").rstrip()})
            if blocks[-1]["type"] == "convolutional":
                blocks[-1]["batch_normalize"] = "0"
        else:
            key, _, value = line.partition("=")
            blocks[-1][key.strip()] = value.strip()
    return blocks


def merged_options(given: dict, defaults: dict) -> dict:
    """What was given, and defaults where it is missing or None."""
    return defaults | {k: v for k, v in given.items() if v is not None}
