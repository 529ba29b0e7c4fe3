"""Parameter files and tables: JSON, YAML and CSV sources and sinks, listings, resume by what is missing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.arrays import json_number

Box = tuple[int, int, int, int]


def stitch_para(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STITCH_PARA).option("multiLine", True).json(path)


def crop_para(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CROP_PARA).option("multiLine", True).json(path)


def patch_specs(crop: DataFrame) -> DataFrame:
    return crop.select(F.explode("patch_specs").alias("s")).select("s.*")


def mapping(spark: SparkSession, paths: list[str], needs: list[str]) -> dict:
    """The first of several JSON or YAML files that is there and has the keys; {} if none is. One small file each."""
    for path in paths:
        try:
            text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        except Exception as e:  # Spark says by its error class that a path is not there
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        if path.endswith(".json"):
            found = json.loads(text)
        else:
            import yaml

            found = yaml.safe_load(text)
        if isinstance(found, dict) and all(k in found for k in needs):
            return found
    return {}


STAGE_FILES = ("selection.json", "para.yaml", "paa.yaml")  # older names of a stage's parameters, fixed values
VERSION = 1


def stage_para(spark: SparkSession, path: str, shapes: tuple[tuple[int, int], tuple[int, int]]) -> tuple[Box, Box, Box] | None:
    """(reference box, moving box, window) of a stage that was run before, each (y0, y1, x0, x1); None if no file has them.

    Older names beside the path are tried after it. A file of another version, or without three whole boxes, is passed
    over. Boxes are moved inside images of these shapes, and cut to them if they are larger.
    """
    folder = path.rpartition("/")[0]
    for candidate in (path, *(f"{folder}/{name}" for name in STAGE_FILES)):
        try:
            found = mapping(spark, [candidate], ["reference_roi", "moving_roi", "fit_window"])
        except ValueError:  # no JSON
            continue
        boxes = [found.get(k) for k in ("reference_roi", "moving_roi", "fit_window")]
        if found.get("version", VERSION) == VERSION and all(_is_box(b) for b in boxes):
            return _moved_inside(boxes[0], shapes[0]), _moved_inside(boxes[1], shapes[1]), tuple(map(int, boxes[2]))
    return None


def _is_box(box) -> bool:
    return isinstance(box, list) and len(box) == 4 and all(isinstance(v, int | float) for v in box) and box[0] < box[1] and box[2] < box[3]


def _moved_inside(box: list, shape: tuple[int, int]) -> Box:
    out = []
    for low, high, most in ((*box[:2], shape[0]), (*box[2:], shape[1])):
        size = min(int(high) - int(low), most)
        first = min(max(int(low), 0), most - size)
        out += [first, first + size]
    return tuple(out)


def qc_stats(spark: SparkSession, root: str) -> DataFrame:
    """(metric, scale, mean, std) of an extraction: stats/stats.json, or stats.json where older runs left it."""
    paths = [f"{root}/stats/stats.json", f"{root}/stats.json"]
    there = next((p for p in paths if _there(spark, p)), None)
    if there is None:
        raise FileNotFoundError(f"bounds need the fits of the metrics, but there is neither of {paths}")
    found = mapping(spark, [there], [])
    rows = [(k, v.get("scale"), *(None if v.get(n) is None else float(v[n]) for n in ("mean", "std"))) for k, v in found.items() if isinstance(v, dict)]
    return spark.createDataFrame(rows, "metric string, scale string, mean double, std double")


#: What a run may save, each under its name: fixed values.
OUTPUTS = ("Bc", "ACsum", "ACYrAsum", "ACsum-qc", "ACYrAsum-qc", "Bf", "B", "AC", "ACYrA", "AC-qc", "ACYrA-qc")


def missing_outputs(spark: SparkSession, folder: str, asked: list[str] | None = None) -> list[str]:
    """The outputs that are asked for (all, if not said) and have no file, or an empty one, in their order."""
    names = list(OUTPUTS if asked is None else asked)
    unknown = [n for n in names if n not in OUTPUTS]
    if unknown:
        raise ValueError(f"unknown outputs: {unknown}")
    if not _there(spark, folder):
        return names
    full = listing(spark, folder, ".tif").where("length > 0")
    done = {r.name for r in full.where(F.col("name").isin([f"{n}.tif" for n in names])).collect()}
    return [n for n in names if f"{n}.tif" not in done]


def complete_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(patch): the profiles of a folder whose header has every column that one needs."""
    own = [c.split()[0] for c in schemas.PROFILE.split(", ")[1:]]
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path).select("value", F.col("_metadata.file_name").alias("name"))
    heads = lines.where(~F.col("name").startswith("._")).where(F.size(F.array_except(F.lit(own), F.transform(F.split("value", ","), F.trim))) == 0)
    return heads.select(F.regexp_replace("name", r"(\.tif)?\.csv$", "").alias("patch")).distinct()


def pending_patches(spark: SparkSession, patches: DataFrame, models: str, profile: str, suffix: str = ".hdf5") -> DataFrame:
    """The patches (column name) that lack a model file with anything in it, or a complete profile."""
    made = listing(spark, models, suffix).where("length > 0") if _there(spark, models) else None
    if made is None or not _there(spark, profile):
        return patches
    stems = made.select(F.regexp_replace("name", rf"(\.tif)?\{suffix}$", "").alias("name"))
    done = stems.join(complete_profiles(spark, profile).withColumnRenamed("patch", "name"), "name")
    return patches.join(done, "name", "left_anti")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile CSVs of a file or folder, with the patch their file is named by; hidden copies are passed over."""
    own = schemas.PROFILE.removeprefix("patch string, ")
    rows = spark.read.schema(own).option("header", True).option("nanValue", "nan").csv(path)
    name = F.col("_metadata.file_name")
    patch = F.regexp_replace(name, r"(\.tif)?\.csv$", "")
    return rows.where(~name.startswith("._")).select(patch.alias("patch"), *(c.split()[0] for c in own.split(", ")))


def write_profiles(profile: DataFrame, path: str) -> None:
    """A folder of CSV files for each patch; an empty profile leaves one file with its header."""
    if profile.isEmpty():
        profile.drop("patch").coalesce(1).write.option("header", True).csv(f"{path}/empty")
    else:
        profile.write.partitionBy("patch").option("header", True).csv(path)


def listing(spark: SparkSession, path: str, suffix: str, fold_case: bool = True) -> DataFrame:
    """(path, name, length) of a folder's files of one suffix, in name order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length")
    rows = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(~F.col("name").startswith("._"))
    return rows.orderBy(F.lower("name") if fold_case else F.col("name"))


def points_json(neurons: DataFrame, metrics: list[str]) -> DataFrame:
    """One JSON text for each neuron; numbers that are not finite are null."""
    return neurons.select(F.to_json(F.struct("id", "x", "y", *(json_number(F.col(m)).alias(m) for m in metrics)), {"ignoreNullFields": "false"}).alias("value"))


def stats_json(stats: DataFrame) -> DataFrame:
    """One JSON text {metric: {scale, mean, std}}; there are a few metrics."""
    entry = F.struct("metric", F.struct("scale", "mean", "std").alias("fit"))
    return stats.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("value"))


def fingerprint(files: DataFrame, *settings: str) -> str:
    """What a cached result depends on: names and lengths of its inputs, and settings."""
    total = files.agg(F.sum(F.xxhash64("name", "length").cast("decimal(38,0)")), F.count("*")).first()
    return "-".join([str(total[0]), str(total[1]), *settings])


def _there(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()).exists(own)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, replaced if it is there."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = own.getFileSystem(spark._jsc.hadoopConfiguration()).create(own, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def write_stats(spark: SparkSession, root: str, stats: DataFrame) -> None:
    """The fits of an extraction where qc_stats finds them; one text, as there are a few metrics."""
    put_text(spark, f"{root}/stats/stats.json", stats_json(stats).first().value)


def write_metadata(spark: SparkSession, folder: str, sources: dict[str, str], shape: tuple[int, int], frames: int, rate: float, neurons: int, traces: dict[str, str]) -> None:
    """folder/metadata.json: what the tables of a viewer were made from, and the file of each kind of trace."""
    named = {name: {"file": file, "dtype": "float32"} for name, file in traces.items()}
    size = {"full_height": shape[0], "full_width": shape[1], "trace_length": frames, "frame_rate_hz": rate, "neuron_count": neurons}
    put_text(spark, f"{folder}/metadata.json", json.dumps({**sources, **size, "trace_sources": named}, indent=2))


def cached(spark: SparkSession, path: str, make, key: str = "") -> DataFrame:
    """The table under path that belongs to a key; if it is not there, make() is written to it first.

    key: what the result depends on, such as fingerprint() of its inputs: other inputs find another table.
    """
    own = f"{path}/{key}" if key else path
    if not _there(spark, f"{own}/_SUCCESS"):
        make().write.mode("overwrite").parquet(own)
    return spark.read.parquet(own)


def cache_is_valid(spark: SparkSession, folder: str, sources: dict[str, str], needs: list[str]) -> bool:
    """Whether folder/metadata.json was made from these sources (name to path), and the files it needs and names are there.

    The trace sources it names as {"trace_sources": {name: {"file": ...}}} are among them.
    """
    found = mapping(spark, [f"{folder}/metadata.json"], [*sources, "trace_sources"])
    named = found.get("trace_sources")
    if not isinstance(named, dict) or not all(isinstance(v, dict) and isinstance(v.get("file"), str) and v["file"] for v in named.values()):
        return False
    same = all(str(found[k]).rstrip("/") == v.rstrip("/") for k, v in sources.items())
    return same and all(_there(spark, f"{folder}/{f}") for f in [*needs, *(v["file"] for v in named.values())])


def composed(spark: SparkSession, paths: list[str], changes: dict[str, object] | None = None) -> dict:
    """Configuration files one over the other, later ones over earlier ones, key by key; then changes, by dotted names.

    A file that is not there is passed over; a change of a name that no file has is an error.
    """
    out: dict = {}
    for path in paths:
        _merge(out, mapping(spark, [path], []))
    for name, value in (changes or {}).items():
        *groups, last = name.split(".")
        at = out
        for g in groups:
            at = at.get(g) if isinstance(at, dict) else None
        if not isinstance(at, dict) or last not in at:
            raise KeyError(name)
        at[last] = value
    return out


def _merge(into: dict, more: dict) -> None:
    for k, v in more.items():
        if isinstance(v, dict) and isinstance(into.get(k), dict):
            _merge(into[k], v)
        else:
            into[k] = v
