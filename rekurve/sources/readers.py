"""Readers of recordings and result records, and rules on file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rekurve.plans.session import cut_lineage
from rekurve.sources.schema import ALIASES, STABILIZATION

DATA_FILE = r"(?i)\.(json|csv|xls|xlsx)$"
# Accepted result keys per metric, first non-null number wins.
METRICS = {
    "mobile_fraction": ["mobile_fraction", "mobile", "Mobile Fraction"],
    "diffusion": ["diffusion_coeff", "D_eff", "D", "Diffusion Coefficient"],
    "residency": ["residency_time", "tau", "residency", "Residency Time"],
}
# Bleach radius in micrometres, wider for these keywords in the group name.
RADIUS_DEFAULT, RADIUS_WIDE, WIDE_KEYWORDS = 6 * 0.12, 12 * 0.12, ["laser", "ir", "infrared"]


def _positions(names: Column, count: Column) -> tuple[dict[str, Column], Column]:
    """Where each standard column is in a header, by the rules of ``schema.resolve_columns``, and if all of them were found by name."""
    found: dict[str, Column] = {}

    def fits(i: Column, words: list[str], taken: list[Column]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.get(names, i), F.lit(w))
        for t in taken:
            hit = hit & (t.isNull() | (i != t))
        return F.coalesce(hit, F.lit(False))

    for std, words in ALIASES.items():
        taken = list(found.values())
        found[std] = F.get(F.filter(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: fits(i, words, taken)), F.lit(0))
    every = F.lit(True)
    for t in found.values():
        every = every & t.isNotNull()
    return found, every


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """All CSV recordings below ``path``, in one pass whatever the number of layouts.

    ``curve_id`` is the file's place below ``path`` without its extension, so files of the same name in two folders stay two curves.
    Columns are found by the names in each file's own first line, whatever their order; a first line of numbers only is a row like the
    others, and columns then go by position.  Motion columns are given if any file has them.  A value that is no number is NULL; a file
    whose columns can't be told is an error.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "[!.~]*.csv")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = files.text(path).select(F.col("_metadata.file_path").alias("path"), "value", place.alias("place"))
    heads = cut_lineage(lines.groupBy("path").agg(F.min_by("value", "place").alias("head"), F.min("place").alias("first")))
    width = heads.agg(F.max(F.size(F.split("head", ",")))).first()[0] or len(ALIASES)
    fields = [f"_c{i}" for i in range(width)]
    cells = lambda c: F.from_csv(c, ", ".join(f"{f} string" for f in fields))
    h = heads.withColumn("r", cells(F.col("head"))).withColumn("count", F.size(F.split("head", ",")))
    h = h.withColumn("names", F.transform(F.array(*[f"r.{f}" for f in fields]), lambda x: F.lower(F.trim(x))))
    here = F.filter("names", lambda x: x.isNotNull())
    h = h.withColumn("plain", F.forall(here, lambda x: x.try_cast("double").isNotNull()) & (F.size(here) > 0))
    at, every = _positions(F.col("names"), F.col("count"))
    known = F.coalesce(every & ~F.col("plain"), F.lit(False))
    by_place = F.col("count") >= len(at)
    wrong = F.raise_error(F.concat(F.lit("columns of "), F.col("path"), F.lit(" can't be told: "), F.col("head"))).cast("int")
    where = [F.when(known, c).when(by_place, F.lit(i)).otherwise(wrong).alias(f"_at_{std}") for i, (std, c) in enumerate(at.items())]
    motion = [F.when(~F.col("plain"), F.array_position("names", c) - 1).cast("int").alias(f"_at_{c}") for c in STABILIZATION]
    h = cut_lineage(h.select("path", "first", "plain", *where, *motion))
    some = h.agg(*[F.max(F.col(f"_at_{c}") >= 0).alias(c) for c in STABILIZATION]).first()  # one row
    extra = [c for c in STABILIZATION if some[c]]
    body = lines.join(h, "path").filter((F.col("plain") | (F.col("place") != F.col("first"))) & (F.trim("value") != ""))
    body = body.withColumn("_r", cells(F.col("value"))).withColumn("_f", F.array(*[f"_r.{f}" for f in fields]))
    value = lambda c: F.when(F.col(f"_at_{c}") >= 0, F.get("_f", F.col(f"_at_{c}")))
    out = body.select("path", *[value(std).try_cast("double").alias(std) for std in ALIASES], *[value(c).alias(c) for c in extra])
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
    below = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z][\w+.-]*:(//[^/]*)?", ""), r"\.[^./]+$", "")
    own = F.when(below.startswith(root), F.substring(below, len(root) + 1, 1 << 20))
    return out.withColumn("curve_id", F.coalesce(own, F.regexp_extract(below, r"([^/]+)$", 1)))


def is_data_file(name: Column) -> Column:
    return name.rlike(DATA_FILE) & ~name.startswith("~$") & ~name.startswith(".")


def keyword_group(folder: Column, groups: dict[str, list[str]]) -> Column:
    """First group with a keyword contained in the folder name, else NULL."""
    out = F.lit(None).cast("string")
    for g, words in reversed(list(groups.items())):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(folder), F.lit(w.lower()))
        out = F.when(hit, g).otherwise(out)
    return out


def subfolder(path: Column) -> Column:
    """Name of the folder that holds the file."""
    return F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)


def usable_folder(folder: Column) -> Column:
    return (folder != "") & ~folder.startswith(".") & ~folder.startswith("__")


def field_of_view(name: Column) -> Column:
    """Number after fov/fld/field/view, else NULL."""
    m = F.regexp_extract(name, r"(?i)(fov|fld|field|view)[_-]?(\d+)", 2)
    return F.when(m != "", m.cast("int"))


def bleach_radius(group: Column) -> Column:
    hit = F.lit(False)
    for w in WIDE_KEYWORDS:
        hit = hit | F.contains(F.lower(group), F.lit(w))
    return F.when(hit, RADIUS_WIDE).otherwise(RADIUS_DEFAULT)


def first_metric(record: Column, keys: list[str]) -> Column:
    """First of ``keys`` in a JSON object that holds a number."""
    return F.coalesce(*[F.get_json_object(record, f"$['{k}']").try_cast("double") for k in keys])


def result_rows(df: DataFrame, record: str, keep: list[str], metrics: dict[str, list[str]] = METRICS) -> DataFrame:
    """One row per record with its metrics; records without any metric are dropped."""
    rows = df.select(*keep, *[first_metric(F.col(record), k).alias(m) for m, k in metrics.items()])
    return rows.dropna(how="all", subset=list(metrics))


def first_row_per_file(df: DataFrame, file: str, order: list[str]) -> DataFrame:
    """First record of each file (a min over the order key, so no file is ever sorted whole)."""
    rest = [c for c in df.columns if c != file]
    return df.groupBy(file).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(file, "_r.*")


def distinct_contents(df: DataFrame, content: str, order: list[str]) -> DataFrame:
    """Non-empty inputs, one per distinct content: the first by ``order``."""
    d = df.filter(F.length(content) > 0).withColumn("content_hash", F.sha2(content, 256))
    ids = [c for c in df.columns if c != content]
    return d.groupBy("content_hash").agg(F.min_by(F.struct(*ids), F.struct(*order)).alias("_r"), F.count(F.lit(1)).alias("copies")).select("content_hash", "_r.*", "copies")


def best_per_file(df: DataFrame, file: list[str], order: list[str]) -> DataFrame:
    """Flag exactly one row per file as best; a file's rows are never sorted, only the least is found.  Rows must differ in ``order``."""
    best = df.groupBy(*file).agg(F.min(F.struct(*order)).alias("_best"))
    return df.join(best, file).withColumn("is_best", F.struct(*order) == F.col("_best")).drop("_best")
