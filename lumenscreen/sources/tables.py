"""Sources and sinks: tables with declared schemas, registration texts, field indexes, cohorts, manifests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; without that setting a local one, if all tasks run in this process.

    All of an application's work folders are deleted when it ends.
    """
    context = spark.sparkContext
    base = getattr(context, "_lumenscreen_work", None)
    if base is None:
        root, master = spark.conf.get("spark.checkpoint.dir", None), context.master
        if not root and not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = context._lumenscreen_work = f"{(root or 'file://' + tempfile.mkdtemp(prefix='lumen-')).rstrip('/')}/work-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        path = context._jvm.org.apache.hadoop.fs.Path(base)
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
    return f"{base}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to a work folder and read again: later steps neither repeat it nor lose it with an executor."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_tables(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """One or many CSV tables with a header; NaN becomes null. A table may have folders for each plate and well."""
    source = spark.read.schema(schema).option("header", True).option("nanValue", "nan").option("positiveInf", "inf").option("negativeInf", "-inf")
    first, *others = [paths] if isinstance(paths, str) else paths
    out = source.csv(first)
    for path in others:
        out = out.unionByName(source.csv(path))
    return out.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(t)) for c, t in out.dtypes if t in ("double", "float")})


def write_tables(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A folder for each plate and well."""
    df.write.partitionBy("plate", "well").format(fmt).option("header", True).save(path)


def read_registrations(spark: SparkSession, folder: str) -> DataFrame:
    """S3: the numbers are read from the end of a line, seven or (old form) three, behind the image's path; the last line of a file wins."""
    lines = spark.read.option("wholetext", True).text(folder).select(F.col("_metadata.file_path").alias("file_40x"), F.posexplode(F.split(F.rtrim("value"), "\r?\n")).alias("n", "line"))
    last = lines.where("trim(line) <> ''").groupBy("file_40x").agg(F.max_by("line", "n").alias("line"))
    words = F.split(F.trim("line"), r"\s+")
    number = lambda k: F.try_element_at("_w", F.lit(k)).try_cast("double")
    numeric = F.forall(F.slice("_w", -7, 7), lambda x: x.try_cast("double").isNotNull())
    rows = last.withColumn("_w", words).withColumn("_new", F.when(F.size("_w") >= 8, numeric).otherwise(False))
    names = ["cc_mag", "shift_x", "shift_y", "expected_x", "expected_y", "actual_x", "actual_y"]
    image = F.regexp_replace(F.array_join(F.slice("_w", 1, F.greatest(F.lit(1), F.size("_w") - F.when(F.col("_new"), 7).otherwise(3))), " "), "//+", "/")
    values = [F.when(F.col("_new"), number(k - 7)).otherwise(number(k - 3) if k < 3 else F.lit(None)).alias(n) for k, n in enumerate(names)]
    return rows.select("file_40x", image.alias("image_10x"), *values)


def read_field_index(spark: SparkSession, path: str, well: str, channel: str = "-ch1") -> DataFrame:
    """Positions of a well's images of one channel from an XML index."""
    rows = spark.read.format("xml").option("rowTag", "Image").schema("URL string, PositionX double, PositionY double").load(path)
    return rows.where(F.col("URL").contains(channel) & F.col("URL").startswith(well)).select(F.col("URL").alias("url"), F.col("PositionX").alias("position_x"), F.col("PositionY").alias("position_y"))


def sites_10x(sites: DataFrame) -> DataFrame:
    """X is negated."""
    return sites.withColumn("x", -F.col("x_raw")).withColumn("y", F.col("y_raw"))


def read_barcodes(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """S6."""
    return spark.read.schema("barcode string").option("header", header).csv(path).where("barcode IS NOT NULL").distinct()


def cohort(cells: DataFrame, plate_map: DataFrame, sublib: str, rep: int, base_dir: str | None = None, paths: tuple[str, ...] = ()) -> DataFrame:
    """Wells whose plate map names the sub-library and replicate. The filter reaches the small table first."""
    wanted = plate_map.where((F.col("sublib") == sublib) & (F.col("rep") == rep)).select("plate", "well", F.col("rep").alias("replicate"))
    out = cells.join(wanted, ["plate", "well"])
    return out.withColumns({p: F.concat(F.lit(base_dir), F.col(p)) for p in paths}) if base_dir else out


def with_extra_features(cells: DataFrame, extra: DataFrame, key: str = "cell_img_gfp_file", rewrite: tuple[Column, Column] | None = None, prefix: Column | None = None, parameters: DataFrame | None = None, feature: str | None = None) -> DataFrame:
    """Features of another analysis of the same cells.

    Their key becomes that of the cells: a part of it is replaced (old, new) and a prefix put before it, both of which
    may depend on the row. With parameters, the one feature is calibrated as in F10; extra has plate and well then.
    """
    path = F.col(key) if rewrite is None else F.replace(F.col(key), *rewrite)
    extra = extra.withColumn(key, path if prefix is None else F.concat(prefix, path))
    if parameters is not None:
        extra = calibrate(extra, parameters, [feature])
    known = [c for c in ("plate", "well") if c in extra.columns and c in cells.columns]
    return cells.join(extra.dropDuplicates([key]).drop(*known), key)


def pixel_bands(pixels: DataFrame, height: int, width: int, keys: list[str], rows: int = 32) -> DataFrame:
    """Pixel rows -> keys, channel, band and its pixels: ``rows`` image rows at once, null where there is no pixel.

    Pixels at one place count once: the largest value, null only if all are. Pixels outside the image are left out. One
    shuffle, by band; a task holds the pixels of a band.
    """
    inside = pixels.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    at = ((F.col("row") % rows) * width + F.col("col")).cast("int")
    placed = inside.select(*keys, "channel", F.floor(F.col("row") / rows).cast("int").alias("band"), at.alias("at"), F.col("value").cast("double").alias("value"))
    own = [*keys, "channel", "band"]
    once = placed.repartition(*own).groupBy(*own, "at").agg(F.max("value").alias("value"))
    lists = once.groupBy(*own).agg(F.collect_list(F.struct("at", "value")).alias("pixels"))
    schema = T.StructType([*lists.schema.fields[:-1], T.StructField("pixels", T.ArrayType(T.DoubleType()))])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat, sizes = lists.flatten(), np.asarray(pa.compute.list_value_length(lists), np.int64)
            band = batch.column(batch.num_columns - 2).to_numpy()
            places = np.minimum(rows, height - band * rows).astype(np.int64) * width
            first = np.cumsum(places) - places
            value = flat.field("value")
            known = np.asarray(value.is_valid())
            place = (np.repeat(first, sizes) + flat.field("at").to_numpy())[known]
            out, there = np.zeros(places.sum()), np.zeros(places.sum(), bool)
            out[place], there[place] = value.drop_null().to_numpy(), True
            packed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(places)), pa.int32()), pa.array(out, mask=~there))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=batch.schema.names)

    return lists.mapInArrow(scatter, schema)


def image_rows(pixels: DataFrame, height: int, width: int, keys: list[str], rows: int = 32) -> DataFrame:
    """Pixel rows -> keys, channel, height, width and the pixels row by row, null where there is none."""
    bands = pixel_bands(pixels, height, width, keys, rows)
    joined = bands.groupBy(*keys, "channel").agg(F.map_from_entries(F.collect_list(F.struct("band", "pixels"))).alias("_bands"))
    gap = lambda b: F.array_repeat(F.lit(None).cast("double"), (F.least(F.lit(rows), height - b * rows) * width).cast("int"))
    every = F.transform(F.sequence(F.lit(0), F.lit((height - 1) // rows)), lambda b: F.coalesce(F.try_element_at("_bands", b), gap(b)))
    return joined.select(*keys, "channel", F.lit(height).alias("height"), F.lit(width).alias("width"), F.flatten(every).alias("pixels"))


def pixel_rows(images: DataFrame, keys: list[str]) -> DataFrame:
    """Array rows (height, width, pixels) -> keys, channel, row, col, value. A null image or pixel has no row."""
    flat = images.select(*keys, "channel", "width", F.posexplode("pixels").alias("_at", "value")).where("value IS NOT NULL AND width > 0")
    return flat.select(*keys, "channel", F.floor(F.col("_at") / F.col("width")).cast("int").alias("row"), (F.col("_at") % F.col("width")).cast("int").alias("col"), "value")


def calibrate(cells: DataFrame, parameters: DataFrame, features: list[str]) -> DataFrame:
    """one select for all features; wells without parameters are unchanged."""
    from ..functions.coords import calibrated

    p = parameters.select("plate", "well", F.col("slope").alias("_slope"), F.col("offset").alias("_offset"))
    return cells.join(p, ["plate", "well"], "left").withColumns({f: calibrated(F.col(f), F.col("_slope"), F.col("_offset")) for f in features}).drop("_slope", "_offset")


def manifest(expected: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """The number of files of every expected key, and whether it is one."""
    return expected.join(files.groupBy(*keys).agg(F.count("*").alias("n_files")), keys, "left").withColumn("n_files", F.coalesce("n_files", F.lit(0))).withColumn("ok", F.col("n_files") == 1)


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """S11."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def usable_fields(fields: DataFrame, registrations: DataFrame, partners: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(fields with a registration and a partner file, the others with a reason)."""
    r, p = registrations.select(*keys).distinct().withColumn("_r", F.lit(True)), partners.select(*keys).distinct().withColumn("_p", F.lit(True))
    marked = fields.join(r, keys, "left").join(p, keys, "left")
    good = F.col("_r").isNotNull() & F.col("_p").isNotNull()
    reason = F.when(F.col("_r").isNull(), "no registration").otherwise("no partner file")
    return marked.where(good).drop("_r", "_p"), marked.where(~good).withColumn("reason", reason).drop("_r", "_p")
