"""Registered queries of the library over the whole given tables, with the same results as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords, names
from ..operators import clean, match, pixels, reads, regions, registration, robust, stats, track
from ..sources import commits, tables
from . import views as v

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def _rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _long(df, *columns: str):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


CELL_KEYS = "plate, well, tile_10x, cell"
SEQ = "ord, line, cell_barcode_0, cell_barcode_1, intensity, num_condensates, feature, area, sublib"
FIRST = f"first_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {CELL_KEYS} ORDER BY {SEQ.replace(', feature', ', feature NULLS FIRST').replace('cell_barcode_1', 'cell_barcode_1 NULLS FIRST')}) AS rn FROM cells) WHERE rn = 1)"
SHOWN = ["plate", "well", "tile_10x", "cell", "ord", "line"]


@_query("w1_first_rows", f"WITH {v.CELLS}, {FIRST} SELECT plate, well, tile_10x, cell, ord, line FROM first_rows")
def _(spark, d):
    return clean.first_of_key(v.cells(spark, d), SEQ.split(", ")).select(*SHOWN)


@_query("p3_bad_barcodes", f"WITH {v.CELLS} SELECT plate, well, count(*) AS n FROM cells WHERE cell_barcode_0 NOT IN ('Brand#1', 'Brand#7') AND (cell_barcode_1 IS NULL OR cell_barcode_1 <> 'ECONOMY') GROUP BY plate, well")
def _(spark, d):
    part = v.table(spark, d, "part")
    bad = part.where("p_brand IN ('Brand#1', 'Brand#7')").select(F.col("p_brand").alias("barcode")).union(part.where("p_type = 'ECONOMY'").select("p_type"))
    return clean.without_bad_barcodes(v.cells(spark, d), bad).groupBy("plate", "well").agg(F.count("*").alias("n"))


@_query("p1_valid_reads", f"WITH {v.READS} SELECT read, barcode, Q_min FROM reads WHERE barcode <> 'error' AND Q_min > 0.05 AND barcode IN ('click', 'view', 'purchase')")
def _(spark, d):
    rows = v.reads(spark, d)
    known = rows.where("barcode IN ('click', 'view', 'purchase')").select("barcode")
    return reads.valid_reads(rows, known, artefact=F.lit("error")).select("read", "barcode", "Q_min")


@_query("p2_valid_reads_binary", f"WITH {v.READS}, b AS (SELECT *, CASE WHEN length(barcode) % 2 = 0 THEN '10' ELSE '01' END AS binary_barcode FROM reads) SELECT read, binary_barcode FROM b WHERE barcode <> 'error' AND Q_min > 0.05 AND binary_barcode = '01'")
def _(spark, d):
    rows = v.reads(spark, d).withColumn("binary_barcode", F.when(F.length("barcode") % 2 == 0, "10").otherwise("01"))
    known = rows.where("binary_barcode = '01'").select("binary_barcode")
    return reads.valid_reads(rows, known, key="binary_barcode", artefact=F.lit("error")).select("read", "binary_barcode")


@_query("a1_call_reads", """WITH b AS (SELECT event_id, user_id, c, ch, (event_id * 31 + c * 17 + ascii(ch) * 7 + (event_id * c) % 13) % 101 AS i FROM events, (SELECT unnest(range(1, 6)) AS c), (SELECT unnest(['G', 'T', 'A', 'C']) AS ch)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id, c ORDER BY i DESC, ch) AS k FROM b),
q AS (SELECT event_id, user_id, c, max(CASE WHEN k = 1 THEN ch END) AS base, max(CASE WHEN k = 1 THEN i END)::DOUBLE AS f, max(CASE WHEN k = 2 THEN i END)::DOUBLE AS s FROM r GROUP BY event_id, user_id, c)
SELECT event_id AS read, string_agg(base, '' ORDER BY c) AS barcode, round(min(CASE WHEN f > 0 THEN (f - s) / f ELSE 0 END), 6) AS Q_min FROM q GROUP BY event_id""")
def _(spark, d):
    e = v.table(spark, d, "events").select(F.lit("p").alias("plate"), F.lit("w").alias("well"), (F.col("user_id") % 10).alias("tile"), F.col("user_id").alias("cell"), F.col("event_id").alias("read"))
    rows = e.withColumn("cycle", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("channel", F.explode(F.array(*[F.lit(x) for x in "GTAC"])))
    value = (F.col("read") * 31 + F.col("cycle") * 17 + F.ascii("channel") * 7 + (F.col("read") * F.col("cycle")) % 13) % 101
    return _rounded(reads.call_reads(rows.withColumn("intensity", value.cast("double"))).select("read", "barcode", "Q_min"), "Q_min")


@_query("a2_call_cells", f"""WITH {v.READS}, c AS (SELECT tile, cell, barcode, count(*) AS n FROM reads WHERE cell <> 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tile, cell ORDER BY n DESC, barcode) AS rn FROM c)
SELECT tile, cell, max(CASE WHEN rn = 1 THEN barcode END) AS cell_barcode_0, max(CASE WHEN rn = 1 THEN n END)::BIGINT AS cell_barcode_count_0, max(CASE WHEN rn = 2 THEN barcode END) AS cell_barcode_1, coalesce(max(CASE WHEN rn = 2 THEN n END), 0)::BIGINT AS cell_barcode_count_1, sum(n)::BIGINT AS barcode_count FROM r GROUP BY tile, cell""")
def _(spark, d):
    return reads.call_cells(v.reads(spark, d)).drop("plate", "well")


@_query("a15_quality_sweep", f"""WITH {v.READS}, t AS (SELECT unnest([0.05, 0.5, 1.0, 2.0])::DOUBLE AS threshold) SELECT threshold, count(*) AS reads, round(count(*) FILTER (barcode IN ('click', 'view')) / count(*), 6) AS mapped, count(DISTINCT CASE WHEN barcode IN ('click', 'view') THEN (tile, cell) END) AS cells FROM reads JOIN t ON Q_min > threshold GROUP BY threshold""")
def _(spark, d):
    rows = v.reads(spark, d)
    return _rounded(reads.quality_sweep(rows, rows.where("barcode IN ('click', 'view')").select("barcode"), [0.05, 0.5, 1.0, 2.0], ["tile", "cell"]), "mapped")


@_query("j6_barcode_table", f"""WITH {v.READS}, c AS (SELECT tile, cell, barcode, count(*) AS n FROM reads WHERE cell <> 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tile, cell ORDER BY n DESC, barcode) AS rn FROM c), p AS (SELECT user_id % 10 AS tile, user_id AS cell, round(sum(value), 4) AS total FROM events GROUP BY ALL)
SELECT r.tile, r.cell, r.barcode AS cell_barcode_0, total, r.barcode AS library_barcode FROM r LEFT JOIN p USING (tile, cell) WHERE rn = 1""")
def _(spark, d):
    rows = v.reads(spark, d)
    phenotype = v.table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("tile"), F.col("user_id").alias("cell")).agg(F.round(F.sum("value"), 4).alias("total"))
    return reads.with_barcode_table(reads.call_cells(rows), phenotype, rows.select("barcode").distinct(), 4, ["tile", "cell"]).select("tile", "cell", "cell_barcode_0", "total", "library_barcode")


@_query("p5_p6_in_range", f"WITH {v.CELLS} SELECT cell_barcode_0, count(*) AS n FROM cells WHERE cell_barcode_1 IS NULL AND intensity > 1000 AND intensity < 5000 GROUP BY 1")
def _(spark, d):
    return stats.single_barcode(v.cells(spark, d)).where(stats.between_open(F.col("intensity"), 1000, 5000)).groupBy("cell_barcode_0").agg(F.count("*").alias("n"))


@_query("p7_between", f"WITH {v.CELLS} SELECT cell_barcode_0, count(*) AS n FROM cells WHERE intensity BETWEEN 1500 AND 2000 GROUP BY 1")
def _(spark, d):
    return v.cells(spark, d).where(F.col("intensity").between(1500, 2000)).groupBy("cell_barcode_0").agg(F.count("*").alias("n"))


@_query("p8_floor", f"WITH {v.CELLS}, f AS (SELECT cell_barcode_0, quantile_cont(intensity, 0.1) AS q FROM cells GROUP BY 1) SELECT cell_barcode_0, count(*) AS n, round(min(intensity), 4) AS least FROM cells JOIN f USING (cell_barcode_0) WHERE intensity > q GROUP BY 1")
def _(spark, d):
    return stats.above_floor(v.cells(spark, d), "intensity", 10).groupBy("cell_barcode_0").agg(F.count("*").alias("n"), F.round(F.min("intensity"), 4).alias("least"))


@_query("p10_representative", f"""WITH {v.CELLS}, b AS (SELECT * FROM cells WHERE intensity > 300), s AS (SELECT plate, well, avg(area) AS ma, stddev_pop(area) AS sa, avg(num_condensates) AS mn, stddev_pop(num_condensates) AS sn FROM b GROUP BY 1, 2)
SELECT plate, well, count(*) AS n FROM b JOIN s USING (plate, well) WHERE area BETWEEN ma - sa AND ma + sa AND num_condensates BETWEEN mn - sn AND mn + sn GROUP BY 1, 2""")
def _(spark, d):
    return stats.representative(v.cells(spark, d), ["area", "num_condensates"], "intensity").groupBy("plate", "well").agg(F.count("*").alias("n"))


@_query("a4_shared_means", f"""WITH {v.CELLS}, m AS (SELECT well, cell_barcode_0, count(*) AS n, avg(intensity) AS x FROM cells WHERE cell_barcode_1 IS NULL GROUP BY 1, 2)
SELECT a.cell_barcode_0, round(a.x, 6) AS mean_1, round(b.x, 6) AS mean_2 FROM m a JOIN m b USING (cell_barcode_0) WHERE a.well = 'F' AND b.well = 'O' AND a.n >= 30 AND b.n >= 30""")
def _(spark, d):
    c = v.cells(spark, d)
    return _rounded(stats.shared_means(c.where("well = 'F'"), c.where("well = 'O'"), "intensity", v.barcodes(spark, d)), "mean_1", "mean_2")


@_query("a5_mean_condensates", f"WITH {v.CELLS}, {v.BARCODES} SELECT barcode AS cell_barcode_0, round(avg(CASE WHEN intensity > 100 AND intensity < 10000 THEN num_condensates END), 6) AS mean_num_cond FROM barcodes LEFT JOIN (SELECT * FROM cells WHERE cell_barcode_1 IS NULL) c ON barcode = cell_barcode_0 GROUP BY 1")
def _(spark, d):
    return _rounded(stats.mean_condensates(v.cells(spark, d), v.barcodes(spark, d), "intensity"), "mean_num_cond")


@_query("a6_average_property", f"""WITH {v.CELLS}, {v.BARCODES}, s AS (SELECT * FROM cells WHERE cell_barcode_1 IS NULL), f AS (SELECT cell_barcode_0, quantile_cont(intensity, 0.05) AS q FROM s GROUP BY 1), k AS (SELECT s.* FROM s JOIN f USING (cell_barcode_0) WHERE intensity > q),
g AS (SELECT cell_barcode_0, count(*) FILTER (intensity > 1000 AND intensity < 8000) AS n, count(*) AS t, avg(CASE WHEN intensity > 1000 AND intensity < 8000 THEN feature END) AS x FROM k GROUP BY 1)
SELECT barcode AS cell_barcode_0, CASE WHEN n >= 30 AND n >= 0.3 * t THEN round(x, 6) END AS value, coalesce(n, 0) AS n_in_range FROM barcodes LEFT JOIN g ON barcode = cell_barcode_0""")
def _(spark, d):
    return _rounded(stats.average_property(v.cells(spark, d), v.barcodes(spark, d), "feature", "intensity", low=1000, high=8000, floor_percent=5), "value")


A7 = "WITH {cells}, {barcodes}, s AS (SELECT *, coalesce(intensity > 1000 AND intensity < 8000, false) AS r FROM {source} WHERE cell_barcode_1 IS NULL), g AS (SELECT cell_barcode_0, count(*) FILTER (r) AS n, count(*) AS t, count(*) FILTER (r AND num_condensates > 0) AS nc, avg(feature) FILTER (r) AS mf, stddev_pop(feature) FILTER (r) AS sf, avg(area) FILTER (r AND num_condensates > 0) AS ma, stddev_pop(area) FILTER (r AND num_condensates > 0) AS sa FROM s GROUP BY 1) SELECT barcode AS cell_barcode_0, coalesce(n, 0) AS n_in_range, CASE WHEN n >= {gate} AND n >= 0.3 * t THEN round(mf, 6) END AS mean_feature, CASE WHEN n >= {gate} AND n >= 0.3 * t THEN round(sf, 6) END AS std_feature, CASE WHEN n >= {gate} AND n >= 0.3 * t AND nc >= {gate} THEN round(ma, 6) END AS mean_area, CASE WHEN n >= {gate} AND n >= 0.3 * t AND nc >= {gate} THEN round(sa, 6) END AS std_area FROM barcodes LEFT JOIN g ON barcode = cell_barcode_0"


@_query("a7_barcode_statistics", A7.replace("{cells}", v.CELLS + ", " + FIRST + ", good AS (SELECT * FROM first_rows WHERE cell_barcode_0 <> 'Brand#1' AND (cell_barcode_1 IS NULL OR cell_barcode_1 <> 'Brand#1'))").replace("{barcodes}", v.BARCODES).replace("{source}", "good").replace("{gate}", "30"))
def _(spark, d):
    """Duplicates, bad barcodes, single-barcode cells, range, statistics: the whole path to a result."""
    known = v.barcodes(spark, d)
    rows = clean.first_of_key(v.cells(spark, d), SEQ.split(", "))
    rows = clean.without_bad_barcodes(rows, known.where("barcode = 'Brand#1'"))
    out = stats.barcode_statistics(rows, known, ["feature", "area"], "intensity", ("area",), low=1000, high=8000)
    return _rounded(out, "mean_feature", "std_feature", "mean_area", "std_area")


@_query("a7_medians", f"""WITH {v.CELLS}, {v.BARCODES}, s AS (SELECT * FROM cells WHERE cell_barcode_1 IS NULL AND intensity > 1000 AND intensity < 8000), t AS (SELECT cell_barcode_0, count(*) AS t FROM cells WHERE cell_barcode_1 IS NULL GROUP BY 1),
g AS (SELECT cell_barcode_0, count(*) AS n, median(area) AS m, mad(area) AS d FROM s GROUP BY 1) SELECT barcode AS cell_barcode_0, coalesce(n, 0) AS n_in_range, CASE WHEN n >= 30 AND n >= 0.3 * t THEN round(m, 6) END AS median_area, CASE WHEN n >= 30 AND n >= 0.3 * t THEN round(d, 6) END AS mad_area FROM barcodes LEFT JOIN g ON barcode = g.cell_barcode_0 LEFT JOIN t ON barcode = t.cell_barcode_0""")
def _(spark, d):
    return _rounded(stats.barcode_statistics(v.cells(spark, d), v.barcodes(spark, d), ["area"], "intensity", how="median", low=1000, high=8000), "median_area", "mad_area")


@_query("a8_condensate_share", f"WITH {v.CELLS}, {v.BARCODES} SELECT barcode AS cell_barcode_0, round(count(*) FILTER (num_condensates > 0) / nullif(count(cell_barcode_0), 0), 6) AS fraction, count(cell_barcode_0) AS n FROM barcodes LEFT JOIN (SELECT * FROM cells WHERE cell_barcode_1 IS NULL AND intensity > 100 AND intensity < 9000) c ON barcode = cell_barcode_0 GROUP BY 1")
def _(spark, d):
    return _rounded(stats.condensate_share(v.cells(spark, d), v.barcodes(spark, d), "intensity", high=9000), "fraction")


@_query("a9_percentiles", f"WITH {v.CELLS} SELECT cell_barcode_0, round(quantile_cont(area, 0.05), 6) AS p5, round(quantile_cont(area, 0.5), 6) AS p50, round(quantile_cont(area, 0.95), 6) AS p95, count(*) AS n FROM cells WHERE cell_barcode_1 IS NULL AND intensity > 0 AND intensity < 100000 GROUP BY 1")
def _(spark, d):
    out = stats.percentiles(v.cells(spark, d), v.barcodes(spark, d), "area", "intensity", [5, 50, 95], min_cells=1, min_frac=0.0)
    return out.where("n > 0").select("cell_barcode_0", *[F.round(F.get("percentiles", F.lit(i)), 6).alias(n) for i, n in enumerate(("p5", "p50", "p95"))], "n")


@_query("a11_line_fit", f"WITH {v.CELLS} SELECT plate, well, round(regr_slope(intensity, area), 6) AS slope, round(regr_intercept(intensity, area), 6) AS intercept, round(regr_r2(intensity, area), 6) AS r2 FROM cells GROUP BY 1, 2")
def _(spark, d):
    return _rounded(clean.line_fit(v.cells(spark, d), "area", "intensity", ["plate", "well"]), "slope", "intercept", "r2")


@_query("a12_robust_line")
def _(spark, d):
    return robust.robust_line(v.cells(spark, d), "area", "intensity", ["plate", "well"])


SWEEP = ", ".join(f"avg(CASE WHEN abs(slope * area + icpt - intensity) < area * {s} + 100 THEN 0.0 ELSE 1.0 END) AS f{i}" for i, s in enumerate((10, 20, 40, 80)))


@_query("a10_scalar_sweep", f"""WITH {v.CELLS}, l AS (SELECT plate, well, regr_slope(intensity, area) AS slope, regr_intercept(intensity, area) AS icpt FROM cells GROUP BY 1, 2), f AS (SELECT plate, well, {SWEEP} FROM cells JOIN l USING (plate, well) GROUP BY 1, 2)
SELECT plate, well, CASE WHEN f0 < 0.2 THEN 10.0 WHEN f1 < 0.2 THEN 20.0 WHEN f2 < 0.2 THEN 40.0 WHEN f3 < 0.2 THEN 80.0 END::DOUBLE AS selected_scalar, round(f0, 6) AS f0, round(f3, 6) AS f3 FROM f""")
def _(spark, d):
    rows = v.cells(spark, d)
    lines = clean.line_fit(rows, "area", "intensity", ["plate", "well"])
    _, status = clean.scalar_sweep(rows, lines, "area", "intensity", ["plate", "well"], [10, 20, 40, 80], 100, 0.2)
    return status.select("plate", "well", "selected_scalar", F.round(F.get("fractions", F.lit(0)), 6).alias("f0"), F.round(F.get("fractions", F.lit(3)), 6).alias("f3"))


@_query("p12_band_a17_loss", f"""WITH {v.CELLS}, l AS (SELECT plate, well, regr_slope(intensity, area) AS slope, regr_intercept(intensity, area) AS icpt FROM cells GROUP BY 1, 2), k AS (SELECT plate, well, abs(slope * area + icpt - intensity) < area * 20 + 100 AS k FROM cells JOIN l USING (plate, well))
SELECT plate, well, count(*) AS n_cells, count(*) FILTER (NOT k) AS n_lost, round(count(*) FILTER (NOT k) / count(*), 6) AS fraction_filtered FROM k GROUP BY 1, 2""")
def _(spark, d):
    rows = v.cells(spark, d)
    fitted = rows.join(clean.line_fit(rows, "area", "intensity", ["plate", "well"]), ["plate", "well"])
    kept = clean.in_band(F.col("area"), F.col("intensity"), F.col("slope"), F.col("intercept"), F.lit(20.0), 100)
    return _rounded(clean.loss(fitted, kept, ["plate", "well"]), "fraction_filtered")


@_query("a16_duplicate_census", f"WITH {v.CELLS}, c AS (SELECT {CELL_KEYS}, count(*) AS n FROM cells GROUP BY ALL) SELECT n > 1 AS duplicated, count(*) AS n_keys, sum(n)::BIGINT AS n_rows FROM c GROUP BY 1")
def _(spark, d):
    return clean.duplicate_census(v.cells(spark, d))


@_query("w3_first_n", f"WITH {v.CELLS} SELECT cell_barcode_0, ord, line, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cell_barcode_0 ORDER BY ord, line, cell, intensity) AS rn FROM cells WHERE intensity > 150) WHERE rn <= 30")
def _(spark, d):
    order = ["ord", "line", "cell", "intensity"]
    return _long(stats.grid(stats.first_n(v.cells(spark, d).where("intensity > 150"), 30, order), order).select("cell_barcode_0", "ord", "line", "rank"), "rank")


W4 = f"WITH {v.CELLS} SELECT cell_barcode_0, sublib, ord, line, cell FROM (SELECT *, row_number() OVER (PARTITION BY cell_barcode_0, sublib ORDER BY md5('1|' || ord || '|' || line || '|' || cell), ord, line, cell) AS rn FROM cells) WHERE rn <= 10"


@_query("w4_random_n", W4)
def _(spark, d):
    return stats.random_n(v.cells(spark, d), 10, ["ord", "line", "cell"], 1, ["cell_barcode_0", "sublib"]).select("cell_barcode_0", "sublib", "ord", "line", "cell")


@_query("w5_grid", f"WITH {v.CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY cell_barcode_0 ORDER BY intensity, ord, line, cell) AS rank FROM cells) SELECT cell_barcode_0, ord, line, cell, rank, (rank - 1) // 20 AS grid_row, (rank - 1) % 20 AS grid_col FROM r")
def _(spark, d):
    return _long(stats.grid(v.cells(spark, d), ["intensity", "ord", "line", "cell"]).select("cell_barcode_0", "ord", "line", "cell", "rank", "grid_row", "grid_col"), "rank", "grid_row", "grid_col")


@_query("j8_sublibrary", f"WITH {v.CELLS} SELECT cell_barcode_0, sublib, count(*) AS n FROM cells WHERE (cell_barcode_0, sublib) IN (SELECT p_brand, p_type FROM part WHERE p_size > 45) GROUP BY 1, 2")
def _(spark, d):
    wanted = v.table(spark, d, "part").where("p_size > 45").select(F.col("p_brand").alias("barcode"), F.col("p_type").alias("sublib"))
    return stats.with_sublibrary(v.cells(spark, d), wanted).groupBy("cell_barcode_0", "sublib").agg(F.count("*").alias("n"))


@_query("j9_paired_by_rank", f"""WITH {v.CELLS}, n AS (SELECT cell_barcode_0, least(count(*), 25) AS take FROM cells WHERE well = 'F' GROUP BY 1), s AS (SELECT cells.*, take, row_number() OVER (PARTITION BY well, cell_barcode_0 ORDER BY md5('1|' || ord || '|' || line || '|' || cell), ord, line, cell) AS r FROM cells JOIN n USING (cell_barcode_0)),
k AS (SELECT *, row_number() OVER (PARTITION BY well, cell_barcode_0 ORDER BY intensity, ord, line, cell) AS rank FROM s WHERE r <= take)
SELECT a.cell_barcode_0, a.rank, round(a.intensity, 4) AS pooled_intensity, round(b.intensity, 4) AS arrayed_intensity FROM k a JOIN k b ON a.cell_barcode_0 = b.cell_barcode_0 AND a.rank = b.rank WHERE a.well = 'F' AND b.well = 'O'""")
def _(spark, d):
    c = v.cells(spark, d)
    out = stats.paired_by_rank(c.where("well = 'F'"), c.where("well = 'O'"), 25, ["ord", "line", "cell"], "intensity")
    return _rounded(_long(out.select("cell_barcode_0", "rank", "pooled_intensity", "arrayed_intensity"), "rank"), "pooled_intensity", "arrayed_intensity", digits=4)


PLATES = "(VALUES ('A', 'F', 'L7', 0), ('N', 'O', 'L7', 1), ('R', 'F', 'L7', 0)) AS m(plate, well, sublib, rep)"


@_query("s8_cohort_f10", f"WITH {v.CELLS} SELECT c.plate, c.well, rep AS replicate, count(*) AS n, round(sum(CASE WHEN c.plate = 'A' THEN 1.5 * (area - 2) + 2 ELSE area END), 4) AS area FROM cells c JOIN {PLATES} ON c.plate = m.plate AND c.well = m.well WHERE m.sublib = 'L7' AND rep = 0 GROUP BY 1, 2, 3")
def _(spark, d):
    plates = spark.createDataFrame([("A", "F", "L7", 0), ("N", "O", "L7", 1), ("R", "F", "L7", 0)], "plate string, well string, sublib string, rep int")
    parameters = spark.createDataFrame([("A", "F", 1.5, 2.0)], "plate string, well string, slope double, offset double")
    rows = tables.calibrate(tables.cohort(v.cells(spark, d).drop("sublib"), plates, "L7", 0), parameters, ["area"])
    return rows.groupBy("plate", "well", "replicate").agg(F.count("*").alias("n"), F.round(F.sum("area"), 4).alias("area"))


@_query("s9_extra_features", """SELECT 'again_' || o_orderstatus || '/new/' || o_orderkey AS path, round(CASE WHEN o_orderstatus = 'F' THEN 1.5 * (o_totalprice - 2) + 2 ELSE o_totalprice END, 4) AS price, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def _(spark, d):
    orders = v.table(spark, d, "orders")
    extra = orders.select(F.concat(F.lit("old_"), "o_orderstatus", F.lit("/"), "o_orderkey").alias("path"), F.col("o_orderstatus").alias("plate"), F.lit("w").alias("well"), F.col("o_totalprice").alias("price"))
    cells = v.table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("again_"), "o_orderstatus", F.lit("/new/"), "o_orderkey").alias("path"))
    parameters = spark.createDataFrame([("F", "w", 1.5, 2.0)], "plate string, well string, slope double, offset double")
    old = F.concat(F.lit("old_"), F.col("plate"), F.lit("/"))
    out = tables.with_extra_features(cells, extra, "path", (old, F.lit("new/")), F.concat(F.lit("again_"), F.col("plate"), F.lit("/")), parameters, "price")
    return out.groupBy("path", F.round("price", 4).alias("price")).agg(F.count("*").alias("n"))


@_query("s1_s2_s7_u1_tables", f"WITH {v.CELLS} SELECT plate, well, cell_barcode_0, count(*) AS n, sum(ord)::BIGINT AS ord, round(sum(feature), 4) AS feature, count(feature) AS n_feature FROM cells GROUP BY ALL")
def _(spark, d):
    """Cells written as CSV by plate and well in two parts, read again together; a missing feature is written as nan."""
    rows = v.cells(spark, d).select("plate", "well", "cell_barcode_0", "ord", F.coalesce("feature", F.lit(float("nan"))).alias("feature"))
    paths = [tables.work_folder(spark) for _ in range(2)]
    for part, path in enumerate(paths):
        tables.write_tables(rows.where(F.col("ord") % 2 == part), path, "csv")
    again = tables.read_tables(spark, paths, "cell_barcode_0 string, ord long, feature double, plate string, well string")
    return again.groupBy("plate", "well", "cell_barcode_0").agg(F.count("*").alias("n"), F.sum("ord").alias("ord"), F.round(F.sum("feature"), 4).alias("feature"), F.count("feature").alias("n_feature"))


@_query("s6_barcode_list", "SELECT DISTINCT p_brand || '-' || p_type AS barcode FROM part")
def _(spark, d):
    path = tables.work_folder(spark)
    v.table(spark, d, "part").select(F.concat_ws("-", "p_brand", "p_type").alias("barcode")).write.option("header", True).csv(path)
    return tables.read_barcodes(spark, path)


@_query("s3_registrations", """WITH l AS (SELECT o_custkey % 40 AS field, o_orderkey AS k FROM orders) SELECT field, '/i m/' || max(k) || '.tif' AS image_10x, 0.5 AS cc_mag, max(k)::DOUBLE AS shift_x, CASE WHEN field % 2 = 0 THEN 7.5 END AS actual_y FROM l GROUP BY field""")
def _(spark, d):
    """Logs of registration attempts, a file for each field, in the new and the old form; the last attempt counts."""
    path = tables.work_folder(spark)
    form = F.when(F.col("field") % 2 == 0, F.concat_ws(" ", F.lit("0.5"), "k", F.lit("2 3 4 5 7.5"))).otherwise(F.concat_ws(" ", F.lit("0.5"), "k", F.lit("2")))
    lines = v.table(spark, d, "orders").select((F.col("o_custkey") % 40).alias("field"), F.col("o_orderkey").alias("k"))
    lines = lines.select("field", "k", F.concat_ws(" ", F.concat(F.lit("/i m//"), "k", F.lit(".tif")), form).alias("value"))
    lines.repartition("field").sortWithinPartitions("field", "k").select("field", "value").write.partitionBy("field").text(path)
    found = tables.read_registrations(spark, path)
    return found.select(F.regexp_extract("file_40x", r"field=(\d+)", 1).cast("long").alias("field"), "image_10x", "cc_mag", "shift_x", "actual_y")


@_query("s4_s5_positions", f"WITH {v.NUCLEI} SELECT 'B' || label % 4 || '-' || label || '-ch1.tif' AS url, -round(x, 3) AS x, round(y, 3) AS y FROM nuclei WHERE label % 4 = 2 AND label % 3 > 0")
def _(spark, d):
    """Stage positions written as an XML index and read for one well and channel; x is negated."""
    path = tables.work_folder(spark)
    channel = F.when(F.col("label") % 3 > 0, "-ch1.tif").otherwise("-ch2.tif")
    rows = v.nuclei(spark, d).select(F.concat(F.lit("B"), F.col("label") % 4, F.lit("-"), "label", channel).alias("URL"), F.round("x", 3).alias("PositionX"), F.round("y", 3).alias("PositionY"))
    rows.write.format("xml").option("rowTag", "Image").save(path)
    found = tables.read_field_index(spark, path, "B2").select("url", F.col("position_x").alias("x_raw"), F.col("position_y").alias("y_raw"))
    return tables.sites_10x(found).select("url", "x", "y")


@_query("s13_images", f"WITH {v.PIXELS} SELECT plate, well, field, channel, row, col, value::DOUBLE AS value FROM pixels")
def _(spark, d):
    keys = ["plate", "well", "field"]
    return tables.pixel_rows(tables.image_rows(v.pixels(spark, d), 40, 40, keys), keys)


@_query("f1_f5_f13_f14_names", """SELECT o_orderkey AS k, chr((65 + o_orderkey % 6)::INT) || (o_custkey % 9 + 1) AS well, (o_orderkey % 333)::INT AS tile, CASE WHEN o_orderkey % 6 < 4 THEN printf('r%02dc%02d', o_orderkey % 6 + 1, o_custkey % 9 + 1) END AS code, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 100)::INT END AS field,
'x/f' || o_orderkey % 100 || 'p01-ch1.tiff' AS image, 'x/f' || o_orderkey % 100 || 'max-ch2.tif' AS partner, o_custkey % 7 || '_' || o_orderkey % 333 AS track, o_orderpriority || '_' || o_orderstatus || '_' || round_even(o_totalprice, 0)::BIGINT || '_x_f' || o_orderkey % 100 || 'max-ch1.tif' AS export FROM orders""")
def _(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    low = F.concat(F.lit("/data/p/Well"), F.chr(65 + k % 6), c % 9 + 1, F.lit("_SBS-"), k % 333, F.lit(".tif"))
    high = F.concat(F.when(k % 5 > 0, "r01c02f").otherwise("r01c02g"), k % 100, F.lit("max-ch1.tif"))
    image = F.concat(F.lit("x/f"), k % 100, F.lit("max-ch1.tif"))
    rows = v.table(spark, d, "orders").select("*", low.alias("low"), high.alias("high"), image.alias("image"))
    well = names.well_10x(F.col("low"))
    return rows.select(
        k.alias("k"), well.alias("well"), names.tile_10x(F.col("low")).alias("tile"), names.well_code(well).alias("code"), names.field_40x(F.col("high")).alias("field"), names.image_key(F.col("image")).alias("image"),
        names.partner_channel(F.col("image")).alias("partner"), names.track_id(c % 7, k % 333).alias("track"), names.export_name(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice"), F.col("image")).alias("export"),
    )


@_query("f11_f15_a14_values", "SELECT l_orderkey AS k, l_linenumber AS line, floor(l_extendedprice / 50) * 50 AS bin, round(l_tax / nullif(l_discount * l_quantity, 0), 6) AS fraction, round(1.5 + 2 * l_quantity - 0.25 * l_tax, 6) AS mapped FROM lineitem")
def _(spark, d):
    rows = v.table(spark, d, "lineitem")
    mapped = match.affine(F.col("l_quantity"), F.col("l_tax"), [F.lit(1.5), F.lit(2.0), F.lit(-0.25)])
    out = rows.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), coords.floor_bin(F.col("l_extendedprice"), 50.0).cast("double").alias("bin"), coords.condensate_fraction(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity")).alias("fraction"), mapped.alias("mapped"))
    return _rounded(out, "fraction", "mapped")


@_query("p9_fitting_gate", f"WITH {v.NUCLEI} SELECT label FROM nuclei WHERE intensity / 20 >= 0.35 AND sqrt(x * x + y * y) <= 60")
def _(spark, d):
    rows = v.nuclei(spark, d).select("label", (F.col("intensity") / 20).alias("cc_mag"), F.col("x").alias("expected_x"), F.col("y").alias("expected_y"), F.lit(0.0).alias("actual_x"), F.lit(0.0).alias("actual_y"))
    return match.registration_gate(rows, 0.35, 60).select("label")


@_query("w6_random_fields", "SELECT o_orderstatus AS well, o_orderkey AS field FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('5|' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 24")
def _(spark, d):
    fields = v.table(spark, d, "orders").select(F.col("o_orderstatus").alias("well"), F.col("o_orderkey").alias("field"))
    return stats.random_n(fields, 24, ["field"], 5, ["well"])


@_query("s10_manifest", "SELECT o_orderkey, count(l_orderkey) AS n_files, count(l_orderkey) = 1 AS ok FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    return tables.manifest(v.table(spark, d, "orders").select("o_orderkey"), v.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@_query("s11_unfinished", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def _(spark, d):
    done = v.table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.unfinished(v.table(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@_query("s2_s11_incremental_runs", f"WITH {v.CELLS} SELECT plate, well, tile_10x, count(*) AS n, round(sum(area), 4) AS area FROM cells GROUP BY ALL")
def _(spark, d):
    """Half of the tiles, then all, then all again: each tile's rows are written by the first run that has it to do."""
    keys = ["plate", "well", "tile_10x"]
    rows, folder = v.cells(spark, d).select(*keys, "area"), tables.work_folder(spark)
    for work in (rows.where("tile_10x < 5"), rows, rows):
        commits.run_pending(work, folder, keys, lambda todo: rows.join(todo, keys))
    return commits.read(spark, folder, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("area"), 4).alias("area"))


@_query("s12_usable_fields", "SELECT o_orderkey, CASE WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25) THEN 'no registration' WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05) THEN 'no partner file' END AS reason FROM orders")
def _(spark, d):
    lines = v.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    good, bad = tables.usable_fields(v.table(spark, d, "orders").select("o_orderkey"), lines.where("l_quantity > 25"), lines.where("l_discount > 0.05"), ["o_orderkey"])
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


PAIRS = f"""WITH {v.NUCLEI}, p AS (SELECT a.tile, a.label AS label_40x, b.label AS label_10x, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist, abs(a.intensity - b.intensity) AS intensity_diff FROM nuclei a JOIN nuclei b ON a.tile = b.tile WHERE a.side = 0 AND b.side = 1),
r AS (SELECT *, row_number() OVER w1 AS r1, lead(dist) OVER w1 AS second_dist, row_number() OVER (PARTITION BY tile, label_10x ORDER BY dist, label_40x) AS r2 FROM p WINDOW w1 AS (PARTITION BY tile, label_40x ORDER BY dist, label_10x)),
m AS (SELECT * FROM r WHERE r1 = 1 AND r2 = 1 AND dist < 15 AND dist / nullif(second_dist, 0) < 0.9)"""


@_query("j3_mutual_nearest", PAIRS + " SELECT tile, label_40x, label_10x, round(dist, 6) AS dist, round(second_dist, 6) AS second_dist, round(intensity_diff, 6) AS intensity_diff FROM m")
def _(spark, d):
    return _rounded(match.mutual_nearest(v.nuclei(spark, d, 0), v.nuclei(spark, d, 1), ["tile"], bucketed=False), "dist", "second_dist", "intensity_diff")


@_query("j3_mutual_nearest_grid", PAIRS + " SELECT tile, label_40x, label_10x, round(dist, 6) AS dist FROM m")
def _(spark, d):
    return _rounded(match.mutual_nearest(v.nuclei(spark, d, 0), v.nuclei(spark, d, 1), ["tile"]).select("tile", "label_40x", "label_10x", "dist"), "dist")


@_query("a3_match_statistics", PAIRS + " SELECT n.tile, count(label_10x) AS n_matched, round(count(label_10x) / count(*), 6) AS fraction, (count(label_10x) - count(DISTINCT label_10x)) AS n_duplicated FROM (SELECT * FROM nuclei WHERE side = 0) n LEFT JOIN m ON n.tile = m.tile AND n.label = label_40x GROUP BY 1")
def _(spark, d):
    a = v.nuclei(spark, d, 0)
    return _rounded(match.match_statistics(a, match.mutual_nearest(a, v.nuclei(spark, d, 1), ["tile"]), ["tile"]), "fraction")


CENTRES = f"WITH {v.NUCLEI}, t AS (SELECT tile, avg(x) AS tx, avg(y) AS ty FROM nuclei GROUP BY 1)"


def _centres(spark, d):
    return v.nuclei(spark, d).groupBy("tile").agg(F.avg("x").alias("tile_x"), F.avg("y").alias("tile_y")).withColumn("plate", F.lit("p"))


@_query("j1_candidate_tiles", CENTRES + " SELECT label, t.tile FROM nuclei JOIN t ON x > tx - 1.5 AND x < tx + 11.5 AND y > ty - 1.5 AND y < ty + 11.5")
def _(spark, d):
    fields = v.nuclei(spark, d).select(F.lit("p").alias("plate"), "label", "x", "y")
    return match.candidate_tiles(fields, _centres(spark, d), 10.0, ["plate"]).select("label", "tile")


@_query("j2_best_tile", CENTRES + ", c AS (SELECT label, t.tile, round(1 / (1 + abs(x - tx) + abs(y - ty)), 3) AS cc FROM nuclei JOIN t ON x > tx - 1.5 AND x < tx + 11.5 AND y > ty - 1.5 AND y < ty + 11.5) SELECT label, tile, cc FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cc DESC, tile) AS r FROM c) WHERE r = 1")
def _(spark, d):
    fields = v.nuclei(spark, d).select(F.lit("p").alias("plate"), "label", "x", "y")
    found = match.candidate_tiles(fields, _centres(spark, d), 10.0, ["plate"])
    cc = F.round(1 / (1 + F.abs(F.col("x") - F.col("tile_x")) + F.abs(F.col("y") - F.col("tile_y"))), 3)
    return match.best_tile(found.withColumn("cc", cc).withColumn("tile_order", F.col("tile")), ["label"])


@_query("p4_registration_gate", f"WITH {v.NUCLEI} SELECT label FROM nuclei WHERE intensity / 100 >= 0.05 AND sqrt(x * x + y * y) <= 15")
def _(spark, d):
    rows = v.nuclei(spark, d).select("label", (F.col("intensity") / 100).alias("cc_mag"), F.col("x").alias("expected_x"), F.col("y").alias("expected_y"), F.lit(0.0).alias("actual_x"), F.lit(0.0).alias("actual_y"))
    return match.registration_gate(rows, 0.05).select("label")


@_query("f6_f8_stage_positions", f"WITH {v.NUCLEI} SELECT label, round(x + y * 0.841792491782224::DOUBLE, 6) AS sx, round(y + (1000 - x) * 0.841792491782224::DOUBLE, 6) AS sy, round(1 + 2 * 0.841792491782224::DOUBLE + y * 0.14949402023919043::DOUBLE, 6) AS fx, round(2 + (1000 - 3) * 0.841792491782224::DOUBLE - 2000 * 0.14949402023919043::DOUBLE + (2000 - x) * 0.14949402023919043::DOUBLE, 6) AS fy FROM nuclei")
def _(spark, d):
    one = F.lit
    sx, sy = coords.shift_to_stage(F.col("x"), F.col("y"), F.col("x"), F.col("y"), one(1000))
    fx, fy = coords.field_centroid_to_stage(one(1.0), one(2.0), one(3.0), one(2.0), F.col("x"), F.col("y"), one(1000), one(2000))
    return _rounded(v.nuclei(spark, d).select("label", sx.alias("sx"), sy.alias("sy"), fx.alias("fx"), fy.alias("fy")), "sx", "sy", "fx", "fy")


EDGES = f"""{v.NUCLEI}, {v.FRAMES}, e AS (SELECT a.tile, a.frame, a.nucleus_num, b.nucleus_num AS prev_num, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist FROM frames a JOIN frames b ON a.tile = b.tile AND a.frame = b.frame + 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tile, frame, nucleus_num ORDER BY dist, prev_num) AS rank FROM e)"""


@_query("t1_edges", f"WITH {EDGES} SELECT tile, frame, nucleus_num, prev_num, round(dist, 6) AS dist, rank FROM ranked WHERE rank <= 3")
def _(spark, d):
    return _rounded(_long(track.edges(v.frames(spark, d)).select("tile", "frame", "nucleus_num", "prev_num", "dist", "rank"), "rank"), "dist")


T2 = f"""WITH {EDGES}, l AS (SELECT * FROM ranked WHERE rank <= 3), s1 AS (SELECT tile, nucleus_num AS at1, min(dist) AS c FROM l WHERE frame = 1 GROUP BY 1, 2 HAVING min(dist) <= 100),
s2 AS (SELECT l.tile, nucleus_num AS at2, min(c + dist) AS c FROM l JOIN s1 ON l.tile = s1.tile AND prev_num = at1 WHERE frame = 2 GROUP BY 1, 2 HAVING min(c + dist) <= 100),
s3 AS (SELECT l.tile, nucleus_num AS at3, min(c + dist) AS c FROM l JOIN s2 ON l.tile = s2.tile AND prev_num = at2 WHERE frame = 3 GROUP BY 1, 2 HAVING min(c + dist) <= 100)
SELECT tile, at3 AS at, round(c, 6) AS cost FROM s3"""


@_query("t2_cheapest_paths", T2)
def _(spark, d):
    return _rounded(track.cheapest_paths(track.edges(v.frames(spark, d)), 0, 3).select("tile", "at", "cost"), "cost")


def _step(n: int) -> str:
    """s{n}: the cheapest path to each nucleus of frame n, of equal costs the first."""
    start = "prev_num IS NOT NULL" if n == 1 else f"prev_num = s{n - 1}.fin"
    cost, path = ("dist", "[prev_num, nucleus_num]") if n == 1 else ("c + dist", "list_append(path, nucleus_num)")
    source = "l" if n == 1 else f"l JOIN s{n - 1} ON l.tile = s{n - 1}.tile AND {start}"
    return f"s{n} AS (SELECT tile, fin, c, path FROM (SELECT l.tile, nucleus_num AS fin, {cost} AS c, {path} AS path, row_number() OVER (PARTITION BY l.tile, nucleus_num ORDER BY {cost}, {path}) AS r FROM {source} WHERE frame = {n} AND {cost} <= 100) WHERE r = 1)"


PATHS = f"WITH {EDGES}, l AS (SELECT * FROM ranked WHERE rank <= 3), {_step(1)}, {_step(2)}, {_step(3)}"
STRICT = "nodes AS (SELECT tile, fin, unnest(path) AS node, generate_subscripts(path, 1) AS step FROM {0}), shared AS (SELECT DISTINCT tile, fin FROM nodes QUALIFY count(*) OVER (PARTITION BY tile, step, node) > 1) SELECT tile, fin AS at, round(c, 6) AS cost, array_to_string(path, '-') AS path FROM {0} WHERE c <= 60 AND (tile, fin) NOT IN (SELECT (tile, fin) FROM shared)"
BETTER = "ordered AS (SELECT tile, fin, c, unnest(path) AS node, generate_subscripts(path, 1) AS step FROM s3), lost AS (SELECT DISTINCT tile, fin FROM ordered QUALIFY row_number() OVER (PARTITION BY tile, step, node ORDER BY c, fin) > 1), better AS (SELECT * FROM s3 WHERE (tile, fin) NOT IN (SELECT (tile, fin) FROM lost))"


def _paths_shown(paths):
    return _rounded(paths.select("tile", "at", "cost", F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path")), "cost")


@_query("t3_strict_paths", f"{PATHS}, {STRICT.format('s3')}")
def _(spark, d):
    return _paths_shown(track.strict_paths(track.cheapest_paths(track.edges(v.frames(spark, d)), 0, 3), 60))


@_query("t4_better_paths", f"{PATHS}, {BETTER}, {STRICT.format('better')}")
def _(spark, d):
    return _paths_shown(track.better_paths(track.cheapest_paths(track.edges(v.frames(spark, d)), 0, 3), 60))


CHAIN = f"""WITH {EDGES}, n AS (SELECT *, row_number() OVER (PARTITION BY tile, frame, prev_num ORDER BY dist, nucleus_num) AS r FROM ranked WHERE rank = 1 AND dist <= 250), k AS (SELECT * FROM n WHERE r = 1),
c AS (SELECT a.tile, a.prev_num AS n0, a.nucleus_num AS n1, b.nucleus_num AS n2, c.nucleus_num AS n3 FROM k a JOIN k b ON a.tile = b.tile AND b.prev_num = a.nucleus_num JOIN k c ON c.tile = a.tile AND c.prev_num = b.nucleus_num WHERE a.frame = 1 AND b.frame = 2 AND c.frame = 3),
ids AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY n0) - 1 AS track FROM c), long AS (SELECT tile, track, unnest([0, 1, 2, 3]) AS frame, unnest([n0, n1, n2, n3]) AS nucleus_num FROM ids)"""


@_query("t5_tracks", CHAIN + " SELECT tile, track, frame, nucleus_num FROM long")
def _(spark, d):
    return _long(track.tracks(v.frames(spark, d), [0, 1, 2, 3]).select("tile", "track", "frame", "nucleus_num"), "track").withColumn("frame", F.col("frame").cast("int"))


@_query("t7_series", CHAIN + ", chosen AS (SELECT DISTINCT tile, track FROM long JOIN frames USING (tile, frame, nucleus_num) WHERE cell_barcode_0 = 'b1' AND cell_barcode_1 IS NULL) SELECT tile, track, max(CASE WHEN frame = 0 THEN nucleus_num END) AS f0, max(CASE WHEN frame = 3 THEN nucleus_num END) AS f3 FROM long JOIN chosen USING (tile, track) GROUP BY 1, 2")
def _(spark, d):
    tracked = track.tracks(v.frames(spark, d), [0, 1, 2, 3])
    return _long(track.series(tracked, "b1", [0, 3], "nucleus_num").select("tile", "track", F.col("0").alias("f0"), F.col("3").alias("f3")), "track")


P = f"WITH {v.PIXELS}"
IMG = "plate, well, field"


@_query("x4_region_statistics", f"{P} SELECT {IMG}, label, channel, count(*) AS area, round(avg(value), 4) AS mean, max(value) AS max, round(stddev_pop(value), 4) AS std, sum(value)::BIGINT AS total, round(avg(row), 6) AS centroid_row, round(avg(col), 6) AS centroid_col, min(row) AS min_row, min(col) AS min_col, max(row) + 1 AS max_row, max(col) + 1 AS max_col FROM pixels WHERE label <> 0 GROUP BY ALL")
def _(spark, d):
    return _rounded(_rounded(pixels.region_statistics(v.pixels(spark, d)), "mean", "std", digits=4), "centroid_row", "centroid_col")


@_query("x5_correlation", f"WITH {v.PIXELS} SELECT {IMG}, label, CASE WHEN count(*) > 1 THEN round(covar_pop(v0, v1) / nullif(stddev_pop(v0) * stddev_pop(v1), 0), 6) END AS corr FROM lab WHERE label <> 0 GROUP BY ALL")
def _(spark, d):
    return _rounded(pixels.channel_correlation(v.pixels(spark, d), "c0", "c1"), "corr")


@_query("x6_inside_regions", f"{P} SELECT {IMG}, label, channel, count(*) AS area FROM pixels WHERE label <> 0 GROUP BY ALL HAVING count(*) > 5 AND count(*) < 2000 AND min(row) > 0 AND min(col) > 0 AND max(row) + 1 < 40 AND max(col) + 1 < 40")
def _(spark, d):
    return pixels.inside_regions(pixels.region_statistics(v.pixels(spark, d)), 5, 2000, 40, 40).select("plate", "well", "field", "label", "channel", "area")


@_query("x3_bleedthrough", f"WITH {v.PIXELS} SELECT {IMG}, row, col, trunc(greatest(0, v0 - v1 * 2.5))::INT AS value FROM lab")
def _(spark, d):
    return pixels.bleedthrough(v.pixels(spark, d), "c0", "c1", 2.5).select("plate", "well", "field", "row", "col", "value")


@_query("x2_flatfield", f"{P}, f AS (SELECT channel, row, col, avg(value) AS f FROM pixels GROUP BY ALL) SELECT {IMG}, channel, row, col, trunc(least(value / (f / 1000), 65535))::INT AS value FROM pixels JOIN f USING (channel, row, col)")
def _(spark, d):
    rows = v.pixels(spark, d)
    field = rows.groupBy("channel", "row", "col").agg((F.avg("value") / 1000).alias("value"))
    return pixels.apply_flatfield(rows, field, []).select("plate", "well", "field", "channel", "row", "col", "value")


@_query("x7_max_projection", "SELECT plate, well, channel, row, col, max(value) AS value FROM (" + f"{P} SELECT * FROM pixels) GROUP BY ALL")
def _(spark, d):
    return pixels.max_projection(v.pixels(spark, d), ["plate", "well"])


@_query("x8_percentile_scaled", f"{P}, t AS (SELECT {IMG}, channel, quantile_cont(value, 0.995) AS t FROM pixels GROUP BY ALL) SELECT {IMG}, channel, row, col, round_even(least(1.0, value / t) * 255, 0)::INT AS value FROM pixels JOIN t USING (plate, well, field, channel)")
def _(spark, d):
    return pixels.percentile_scaled(v.pixels(spark, d)).drop("label")


@_query("x9_halved", f"{P} SELECT {IMG}, channel, (39 - row) // 2 AS row, (39 - col) // 2 AS col, round_even(sum(value) / 4, 0)::INT AS value FROM pixels GROUP BY {IMG}, channel, (39 - row) // 2, (39 - col) // 2")
def _(spark, d):
    return pixels.halved(pixels.rotated(v.pixels(spark, d), 40, 40))


@_query("x10_threshold", f"{P}, m AS (SELECT {IMG}, label, channel, avg(value) AS m FROM pixels WHERE label <> 0 GROUP BY ALL) SELECT {IMG}, label, channel, round(greatest(avg(value) + 3 * stddev_pop(value), 300), 4) AS threshold FROM pixels JOIN m USING (plate, well, field, label, channel) WHERE value < 2 * m GROUP BY ALL")
def _(spark, d):
    return _rounded(pixels.condensate_threshold(v.pixels(spark, d)), "threshold", digits=4)


@_query("x16_overlap", f"WITH {v.PIXELS} SELECT {IMG}, label, count(*) FILTER (v0 > 40000 AND v1 > 2500) AS overlap_area, round(count(*) FILTER (v0 > 40000 AND v1 > 2500) / nullif(count(*) FILTER (v0 > 40000), 0), 6) AS overlap_fraction FROM lab WHERE label <> 0 GROUP BY ALL")
def _(spark, d):
    wide = v.pixels(spark, d).groupBy("plate", "well", "field", "label", "row", "col").agg((F.max(F.when(F.col("channel") == "c0", F.col("value"))) > 40000).alias("a"), (F.max(F.when(F.col("channel") == "c1", F.col("value"))) > 2500).alias("b"))
    return _rounded(pixels.mask_overlap(wide, "a", "b"), "overlap_fraction")


@_query("x17_texture", f"""{P}, l AS (SELECT *, CASE WHEN max(value) OVER (PARTITION BY {IMG}, label, channel) < 256 THEN value ELSE value // 256 END AS lev FROM pixels WHERE label <> 0), k AS (SELECT * FROM l WHERE lev > 0),
p AS (SELECT a.plate, a.well, a.field, a.label, a.channel, a.lev AS i, b.lev AS j FROM k a JOIN k b ON a.plate = b.plate AND a.well = b.well AND a.field = b.field AND a.label = b.label AND a.channel = b.channel AND a.row = b.row AND b.col = a.col + 5), s AS (SELECT * FROM p UNION ALL SELECT plate, well, field, label, channel, j, i FROM p)
SELECT {IMG}, label, channel, round(avg(abs(i - j)), 6) AS dissimilarity, round(avg((i - j) * (i - j)), 4) AS contrast, round(avg(1.0 / (1 + (i - j) * (i - j))), 6) AS homogeneity FROM s GROUP BY ALL""")
def _(spark, d):
    out = pixels.texture(v.pixels(spark, d)).select("plate", "well", "field", "label", "channel", "dissimilarity", "contrast", "homogeneity")
    return _rounded(_rounded(out, "dissimilarity", "homogeneity"), "contrast", digits=4)


@_query("x15_grown_labels", f"""{P}, o AS (SELECT i, j FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE i * i + j * j BETWEEN 1 AND 4), n AS (SELECT {IMG}, channel, row + i AS row, col + j AS col, min((i * i + j * j) * 1000 + label) % 1000 AS near FROM pixels, o WHERE label <> 0 GROUP BY ALL)
SELECT {IMG}, channel, row, col, (CASE WHEN label <> 0 THEN label ELSE coalesce(near, 0) END)::INT AS label FROM pixels LEFT JOIN n USING (plate, well, field, channel, row, col)""")
def _(spark, d):
    return regions.grown_labels(v.pixels(spark, d), 2).select("plate", "well", "field", "channel", "row", "col", F.col("label").cast("int").alias("label"))


@_query("x19_crops", f"""{P}, b AS (SELECT {IMG}, label, channel, min(row) AS r, min(col) AS c, max(row) - min(row) + 1 AS h, max(col) - min(col) + 1 AS w, count(*) FILTER (value > 50000) AS n_clipped FROM pixels WHERE label <> 0 GROUP BY ALL)
SELECT {IMG}, label, channel, (row - r + floor((25 - h) / 2))::INT AS row, (col - c + floor((25 - w) / 2))::INT AS col, floor(least(value, 50000)::DOUBLE / 50000 * 65535)::INT AS value, n_clipped FROM pixels JOIN b USING (plate, well, field, label, channel) WHERE h <= 25 AND w <= 25""")
def _(spark, d):
    return regions.crops(v.pixels(spark, d), 25, 50000.0)


@_query("x13_objects")
def _(spark, d):
    return regions.label_objects(v.pixels(spark, d).withColumn("bright", F.col("value") > 2500), "bright", depth=1.0)


@_query("x13_connected_regions", f"""WITH RECURSIVE {v.PIXELS}, b AS (SELECT plate, well, field, row, col, row * 40 + col + 1 AS place FROM pixels WHERE channel = 'c1' AND value > 4000),
r AS (SELECT {IMG}, place AS seed, row, col FROM b UNION SELECT r.plate, r.well, r.field, seed, b.row, b.col FROM r JOIN b ON (r.plate, r.well, r.field) = (b.plate, b.well, b.field) AND abs(r.row - b.row) + abs(r.col - b.col) = 1)
SELECT {IMG}, row, col, min(seed)::BIGINT AS component FROM r GROUP BY ALL""")
def _(spark, d):
    rows = v.pixels(spark, d).where("channel = 'c1'").withColumn("bright", F.col("value") > 4000)
    return regions.labelled(rows, "bright", ["plate", "well", "field"], 40, rows=8)


@_query("x11_holes")
def _(spark, d):
    return regions.flag_holes(v.pixels(spark, d))


@_query("x12_threshold", f"""{P}, m AS (SELECT *, avg(value) OVER (PARTITION BY {IMG}, label, channel) AS m FROM pixels WHERE label <> 0)
SELECT {IMG}, label, channel, round(greatest(avg(value) + 0.9 * stddev_pop(value) FILTER (value < 2 * m), 300), 4) AS threshold FROM m GROUP BY ALL""")
def _(spark, d):
    return _rounded(pixels.nucleolus_threshold(v.pixels(spark, d)), "threshold", digits=4)


@_query("x12_nucleoli", f"""WITH RECURSIVE {v.PIXELS}, m AS (SELECT *, avg(value) OVER (PARTITION BY {IMG}, label, channel) AS m FROM pixels WHERE label <> 0),
t AS (SELECT {IMG}, label, channel, greatest(avg(value) + 0.9 * stddev_pop(value) FILTER (value < 2 * m), 300) AS threshold FROM m GROUP BY ALL),
o AS (SELECT p.*, coalesce(value > threshold, FALSE) AS own FROM pixels p JOIN t USING (plate, well, field, label, channel) WHERE label <> 0), box AS (SELECT {IMG}, label, channel, min(row) - 1 AS r0, max(row) + 1 AS r1, min(col) - 1 AS c0, max(col) + 1 AS c1 FROM o GROUP BY ALL),
grid AS (SELECT *, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM box)),
free AS (SELECT g.plate, g.well, g.field, g.label, g.channel, r, c, r = r0 AND c = c0 AS corner FROM grid g LEFT JOIN o ON own AND (g.plate, g.well, g.field, g.label, g.channel, g.r, g.c) = (o.plate, o.well, o.field, o.label, o.channel, o.row, o.col) WHERE own IS NULL),
open_ AS (SELECT {IMG}, label, channel, r, c FROM free WHERE corner UNION SELECT f.plate, f.well, f.field, f.label, f.channel, f.r, f.c FROM open_ x JOIN free f ON (f.plate, f.well, f.field, f.label, f.channel) = (x.plate, x.well, x.field, x.label, x.channel) AND abs(f.r - x.r) + abs(f.c - x.c) = 1)
SELECT o.plate, o.well, o.field, o.label, o.channel, row, col, value, x.r IS NULL AS nucleolus FROM o LEFT JOIN open_ x ON (x.plate, x.well, x.field, x.label, x.channel, x.r, x.c) = (o.plate, o.well, o.field, o.label, o.channel, o.row, o.col)""")
def _(spark, d):
    rows = v.pixels(spark, d)
    return regions.nucleolus_mask(rows, pixels.nucleolus_threshold(rows))


@_query("x14_object_properties", f"""{P}, o AS (SELECT *, CASE WHEN value > 2500 THEN 1 + col % 2 ELSE 0 END AS object FROM pixels WHERE label <> 0), part_ AS (SELECT {IMG}, label, channel, object, count(*) AS area, sum(value) AS total FROM o WHERE object <> 0 GROUP BY ALL)
SELECT {IMG}, label, channel, count(total) AS num, sum(total)::BIGINT AS total_intensity, sum(area)::BIGINT AS total_area, round(avg(area), 6) AS mean_area, round(stddev_pop(area), 6) AS std_area FROM (SELECT DISTINCT {IMG}, label, channel FROM o) LEFT JOIN part_ USING (plate, well, field, label, channel) GROUP BY ALL""")
def _(spark, d):
    rows = v.pixels(spark, d).withColumn("object", F.when(F.col("value") > 2500, 1 + F.col("col") % 2).otherwise(0))
    out = pixels.object_properties(rows, ["plate", "well", "field", "channel"]).select("plate", "well", "field", "label", "channel", "num", "total_intensity", "total_area", "mean_area", "std_area")
    return _rounded(out, "mean_area", "std_area")


def _condensates(name: str, flag: str) -> str:
    case = f"CASE WHEN {flag} THEN value END"
    return f"round(avg({case}), 4) AS mean_{name}, round(stddev_pop({case}), 4) AS std_{name}"


X14 = f"""{P}, o AS (SELECT *, value > 4500 AS own FROM pixels WHERE label <> 0), box AS (SELECT {IMG}, label, channel, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM o GROUP BY ALL),
grid AS (SELECT {IMG}, label, channel, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM box)), empty AS (SELECT g.* FROM grid g LEFT JOIN o ON (g.plate, g.well, g.field, g.label, g.channel, g.r, g.c) = (o.plate, o.well, o.field, o.label, o.channel, o.row, o.col) WHERE NOT coalesce(own, FALSE)),
f AS (SELECT o.*, NOT EXISTS (SELECT 1 FROM o b WHERE b.own AND (b.plate, b.well, b.field, b.label, b.channel) = (o.plate, o.well, o.field, o.label, o.channel) AND (b.row - o.row) * (b.row - o.row) + (b.col - o.col) * (b.col - o.col) <= 9) AS dil,
own AND NOT EXISTS (SELECT 1 FROM empty e WHERE (e.plate, e.well, e.field, e.label, e.channel) = (o.plate, o.well, o.field, o.label, o.channel) AND (e.r - o.row) * (e.r - o.row) + (e.c - o.col) * (e.c - o.col) <= 1) AS core FROM o)
SELECT {IMG}, label, channel, {_condensates("condensate", "core")}, {_condensates("condensate_no_shrink", "own")}, {_condensates("dilute", "dil")}, round(avg(CASE WHEN value % 5 <> 0 THEN value END), 4) AS mean_no_holes FROM f GROUP BY ALL""".replace("AS dil,", "AND value % 5 <> 0 AS dil,")


@_query("x14_condensate_intensities", X14)
def _(spark, d):
    rows = v.pixels(spark, d).withColumns({"object": (F.col("value") > 4500).cast("int"), "hole": F.col("value") % 5 == 0})
    out = regions.condensate_intensities(rows, hole="hole", shrink=1, grow=3)
    return _rounded(out, *[c for c in out.columns if c.startswith(("mean", "std"))], digits=4)


@_query("x18_registration")
def _(spark, d):
    """Each field's channels against those of the next field of its well; images are stored, their transforms are made in tasks."""
    keys = ["plate", "well", "field", "channel"]
    images = tables.image_rows(v.pixels(spark, d), 40, 40, keys[:-1])
    transforms = registration.image_transforms(images, keys)
    pairs = transforms.select(*keys, (F.col("field") + 1).alias("target"))
    pairs = pairs.join(transforms.select("plate", "well", F.col("field").alias("target"), "channel"), ["plate", "well", "target", "channel"], "left_semi")
    found = registration.registered(transforms, pairs, keys, keys, ["plate", "well", "target", "channel"])
    return _rounded(found.drop("target"), "cc", "shift_row", "shift_col")


@_query("j4_overlap_match", f"""{P}, b AS (SELECT {IMG}, channel, row, (col + 4) % 40 AS col, label AS label_10x FROM pixels WHERE label <> 0), a AS (SELECT {IMG}, channel, row, col, label AS label_40x FROM pixels WHERE label <> 0),
ar AS (SELECT {IMG}, channel, label_40x, count(*) AS area FROM a GROUP BY ALL), n AS (SELECT {IMG}, channel, label_40x, label_10x, count(*) AS n FROM a JOIN b USING (plate, well, field, channel, row, col) GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, lead(n) OVER w AS nxt FROM n WINDOW w AS (PARTITION BY {IMG}, channel, label_40x ORDER BY n DESC, label_10x)),
g AS (SELECT {IMG}, channel, label_40x, label_10x, n, area FROM r JOIN ar USING (plate, well, field, channel, label_40x) WHERE rn = 1 AND n / area > 0.25 AND (nxt IS NULL OR n / nxt > 1.5))
SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY {IMG}, channel, label_10x) = 1""")
def _(spark, d):
    rows = v.pixels(spark, d)
    moved = rows.withColumn("col", ((F.col("col") + 4) % 40).cast("int"))
    return match.overlap_match(rows, moved, ["plate", "well", "field", "channel"])


@_query("j5_attach_once", """WITH m AS (SELECT o_orderkey AS field, o_custkey AS nucleus, o_orderkey % 3 AS well, o_orderkey % 500 AS cell FROM orders), s AS (SELECT ps AS cell, sum(1) AS n, min(k) AS s_value FROM (SELECT l_partkey % 500 AS ps, l_orderkey AS k FROM lineitem WHERE l_quantity < 2 AND l_linenumber = 1) GROUP BY 1 HAVING count(*) = 1),
p AS (SELECT l_orderkey AS field, l_suppkey % 3 AS pwell, max(l_quantity) AS feature FROM lineitem WHERE l_linenumber > 4 GROUP BY ALL), u AS (SELECT field, min(pwell) AS pwell, min(feature) AS feature FROM p GROUP BY 1 HAVING count(*) = 1)
SELECT m.field, m.cell, m.well, CASE WHEN pwell = well THEN feature END AS feature, s_value FROM m JOIN u USING (field) JOIN s USING (cell)""")
def _(spark, d):
    matches = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("field"), (F.col("o_orderkey") % 3).alias("well"), (F.col("o_orderkey") % 500).alias("cell"))
    lines = v.table(spark, d, "lineitem")
    sbs = lines.where("l_quantity < 2 AND l_linenumber = 1").select((F.col("l_partkey") % 500).alias("cell"), F.col("l_orderkey").alias("s_value"))
    phenotype = lines.where("l_linenumber > 4").groupBy(F.col("l_orderkey").alias("field"), (F.col("l_suppkey") % 3).alias("well")).agg(F.max("l_quantity").alias("feature"))
    return match.attach_once(matches, sbs, phenotype, ["cell"], ["field"]).select("field", "cell", "well", "feature", "s_value")


X1 = f"""{P}, m AS (SELECT plate, well, channel, row, col, avg(value) AS v FROM pixels GROUP BY ALL), z AS (SELECT plate, well, channel, max(row) + 1 AS h, max(col) + 1 AS w, avg(v) AS mean, greatest((max(row) + 1) / 10, 0.5::DOUBLE) AS s FROM m GROUP BY ALL),
e AS (SELECT plate, well, channel, s, unnest(range(-floor(4 * s + 0.5)::BIGINT, floor(4 * s + 0.5)::BIGINT + 1)) AS k FROM z), t AS (SELECT plate, well, channel, k, exp(-0.5 * (k / s) * (k / s)) / sum(exp(-0.5 * (k / s) * (k / s))) OVER (PARTITION BY plate, well, channel) AS part FROM e),
g AS (SELECT plate, well, channel, h, w, mean, row, unnest(range(w)) AS col FROM (SELECT *, unnest(range(h)) AS row FROM z)), f AS (SELECT g.*, coalesce(v, mean) AS v FROM g LEFT JOIN m USING (plate, well, channel, row, col)),
a AS (SELECT f.plate, f.well, f.channel, f.h, f.row, f.col, sum(part * n.v) AS v FROM f JOIN t USING (plate, well, channel) JOIN f n ON (n.plate, n.well, n.channel, n.row) = (f.plate, f.well, f.channel, f.row) AND n.col = greatest(0, least(f.w - 1, f.col + k)) GROUP BY ALL),
b AS (SELECT a.plate, a.well, a.channel, a.row, a.col, sum(part * n.v) AS v FROM a JOIN t USING (plate, well, channel) JOIN a n ON (n.plate, n.well, n.channel, n.col) = (a.plate, a.well, a.channel, a.col) AND n.row = greatest(0, least(a.h - 1, a.row + k)) GROUP BY ALL)
SELECT plate, well, channel, row, col, value FROM (SELECT *, round(v / max(v) OVER (PARTITION BY plate, well, channel), 6) AS value FROM b) SEMI JOIN m USING (plate, well, channel, row, col)"""


@_query("x1_flat_field", X1)
def _(spark, d):
    return _rounded(regions.smoothed_field(v.pixels(spark, d), ["plate", "well"]), "value")


@_query("a13_robust_affine")
def _(spark, d):
    rows = v.nuclei(spark, d).select(F.col("tile"), "x", "y", (2 * F.col("x") + F.col("intensity") / 50 + 5).alias("to_x"), (2 * F.col("y") - 3).alias("to_y"))
    return robust.robust_affine(rows, ["tile"])


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
