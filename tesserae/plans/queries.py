"""The operators as queries over the standard tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays, kinetics
from ..operators import footprints, geometry, intervals, kernels, match_points, movies, neighbours, patches, quality, rendering, stitching, traces
from ..schemas import BOX
from ..sources import params
from . import tables as t

QC = [quality.Metric("snr", "log", -1.0, None), quality.Metric("r_value", "linear", -1.2, 1.2)]
ACCOUNT = quality.Metric("snr", "log", -1.5, 2.0)

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def _r(column, digits: int = 6):
    return F.round(column, digits) + F.lit(0.0)  # no negative zero


#: Pixels of the movie in SQL.
PX = "(select cast(vec_id as integer) as frame, cast((i - 1) // 8 as integer) as y, cast((i - 1) % 8 as integer) as x, embedding[i] as v from (select vec_id, embedding, unnest(range(1, 65)) as i from embeddings))"


def _frames(movie: DataFrame) -> DataFrame:
    """A row for each frame: the sum of its pixels, and one weighted by place, so that order counts."""
    total = F.aggregate("data", F.lit(0.0), lambda s, v: s + v.cast("double"))
    at = F.zip_with("data", F.sequence(F.lit(1), F.size("data")), lambda v, i: v.cast("double") * i)
    return movie.select("frame", _r(total, 4).alias("total"), _r(F.aggregate(at, F.lit(0.0), lambda s, v: s + v), 3).alias("weighted"))


def _sums(body: str) -> str:
    """SQL of _frames over rows (frame, y, x, v)."""
    return f"select frame, (round(sum(cast(v as double)), 4) + 0.0::double) as total, (round(sum(cast(v as double) * (y * 8 + x + 1)), 3) + 0.0::double) as weighted from ({body}) group by frame"


# ---- quality control

QC_FIT = """
with e as (select l_suppkey as patch, l_extendedprice as snr, l_quantity as r_value from lineitem),
s as (select avg(log10(snr)) filter (snr > 0) as ms, stddev_pop(log10(snr)) filter (snr > 0) as ss, avg(r_value) as mr, stddev_pop(r_value) as sr from e)"""


@query(QC_FIT + """, j as (select patch, not ((log10(snr) - ms) / ss < -1.0) and not ((r_value - mr) / sr < -1.2 or (r_value - mr) / sr > 1.2) as keep from e, s)
select patch, count(*) as n_before, count(*) filter (keep) as n_after from j group by patch""")
def qc_summary(spark, d):
    rows = t.profile(spark, d)
    return quality.summary(quality.with_keep(rows, quality.fit(rows, QC), QC), "patch")


@query(QC_FIT + " select 'snr' as metric, 'log' as scale, (round(ms, 8) + 0.0::double) as mean, (round(ss, 8) + 0.0::double) as std from s union all select 'r_value', 'linear', (round(mr, 8) + 0.0::double), (round(sr, 8) + 0.0::double) from s")
def metric_fit(spark, d):
    return quality.fit(t.profile(spark, d), QC).select("metric", "scale", _r("mean", 8).alias("mean"), _r("std", 8).alias("std"))


ACC = """
with e as (select c_nationkey as patch, c_custkey as k, c_acctbal as snr from customer),
s as (select avg(log10(snr)) as m, stddev_pop(log10(snr)) as s from e where snr > 0)"""


@query(ACC + """, z as (select patch, k, ((case when snr > 0 then log10(snr) else '-infinity'::double end) - m) / s as z from e, s)
select patch, count(*) as n_before, count(*) filter (not (z < -1.5 or z > 2.0)) as n_after from z group by patch""")
def qc_nonpositive(spark, d):
    rows = t.accounts(spark, d)
    return quality.summary(quality.with_keep(rows, quality.fit(rows, [ACCOUNT]), [ACCOUNT]), "patch")


@query(ACC + """, z as (select patch, k, ((case when snr > 0 then log10(snr) else '-infinity'::double end) - m) / s as z from e, s)
select cast(row_number() over (order by patch, k) - 1 as bigint) as id, patch, k from z where not (z < -1.5 or z > 2.0)""")
def dense_neuron_ids(spark, d):
    rows = t.accounts(spark, d)
    kept = quality.with_keep(rows, quality.fit(rows, [ACCOUNT]), [ACCOUNT]).where("keep")
    return traces.dense_ids(kept.select("patch", "k"), ["patch", "k"])


@query(ACC + """, f as (select min(snr) filter (snr > 0) as f from e)
select k, round(greatest(least(log10(greatest(snr, f)), m + 3 * s), m - 3 * s), 6) as value from e, s, f""")
def render_values(spark, d):
    return quality.render_values(t.accounts(spark, d), ACCOUNT, ["k"]).select("k", _r("value").alias("value"))


@query(QC_FIT + """, c as (select (i - 30) / 10.0::double as cut from range(61) r(i)), z as (select (log10(snr) - ms) / ss as z from e, s)
select cut, count(*) filter (z < cut) as n_rejected, count(*) filter (not z < cut) as n_kept from z, c group by cut""")
def threshold_sweep(spark, d):
    rows = t.profile(spark, d)
    return quality.sweep(rows, quality.fit(rows, QC), QC[0])


@query("select count(*) filter (l_returnflag <> 'R') as false_count, count(*) filter (l_returnflag = 'R') as true_count from lineitem")
def flag_counts(spark, d):
    return quality.bool_counts(t.profile(spark, d), "flag")


FLAG = quality.Metric("flag", "boolean")


@query("select cast(null as double) as cut, count(*) filter (l_returnflag = 'R') as n_rejected, count(*) filter (l_returnflag <> 'R') as n_kept from lineitem")
def flag_sweep(spark, d):
    return quality.sweep(t.profile(spark, d), None, FLAG)


@query("select l_orderkey as k, l_linenumber as i, case when l_returnflag = 'R' then 1.0::double else 0.0::double end as value from lineitem")
def flag_values(spark, d):
    rows = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_returnflag") == "R").alias("flag"))
    return quality.render_values(rows, FLAG, ["k", "i"])


@query("""with m as (select c_nationkey as patch, count(*) as n from customer group by 1 having c_nationkey % 3 > 0)
select c_nationkey as patch, cast(row_number() over (partition by c_nationkey order by c_custkey) - 1 as integer) as component_index, c_acctbal as snr from customer semi join m on m.patch = c_nationkey""")
def profiles_of_models(spark, d):
    rows = t.accounts(spark, d)
    within = W.partitionBy("patch").orderBy("k")  # a patch's components are numbered from 0
    profile = rows.select("patch", (F.row_number().over(within) - 1).alias("component_index"), "snr")
    models = rows.where("patch % 3 > 0").groupBy("patch").agg(F.count("*").alias("n"))
    return quality.profiles_of_models(models, profile)


@query("""with e as (select l_extendedprice as v from lineitem), a as (select min(v) as a, max(v) as b, count(*) as total from e)
select bin, count(*) as n, (round(count(*) / (any_value(total) * ((any_value(b) - any_value(a)) / 80)), 12) + 0.0::double) as density
from (select cast(least(floor((v - a) / ((b - a) / 80)), 79) as integer) as bin, total, a, b from e, a) group by bin""")
def metric_histogram(spark, d):
    return quality.metric_histogram(t.profile(spark, d), "snr").select("bin", "n", _r("density", 12).alias("density"))


@query("""select c_nationkey as patch, count(*) as rows, 60 as n, min(c_custkey) as least, max(c_custkey) as most from customer group by 1
having count(*) <> 60 or min(c_custkey) < 0 or max(c_custkey) >= 60""")
def incomplete_profiles(spark, d):
    rows = t.accounts(spark, d)
    return quality.incomplete_profiles(rows, rows.select("patch").distinct().withColumn("n", F.lit(60)), k="k")


@query("select c_custkey as k, lower(trim(c_mktsegment)) in ('1', 'true', 't', 'yes', 'y') as t, lower(trim(substr(c_name, 1, 0) || 'Yes ')) in ('1', 'true', 't', 'yes', 'y') as u from customer")
def flag_parsing(spark, d):
    rows = t.table(spark, d, "customer")
    return rows.select(F.col("c_custkey").alias("k"), quality.truth(F.col("c_mktsegment")).alias("t"), quality.truth(F.concat(F.substring("c_name", 1, 0), F.lit("Yes "))).alias("u"))


@query("""select p_partkey as k, 'reject: value < ' || (case when abs(v) >= 100 or (abs(v) < 0.01 and v <> 0) then printf('%.6e', v)
 else regexp_replace(regexp_replace(printf('%.6f', v), '0+$', ''), '\\.$', '') end) as label, 'reject: time < ' || printf('%.1f', v) as short
from (select p_partkey, p_retailprice / 13 - 80 as v from part)""")
def threshold_labels(spark, d):
    rows = t.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") / 13 - 80).alias("v"))
    return rows.select("k", quality.threshold_label(F.col("v")).alias("label"), quality.threshold_label(F.col("v"), "time", 1).alias("short"))


# ---- frames and images


@query(_sums(f"select frame, y, x, cast((v - a) / (b - a) as float) as v from {PX}, (select min(v) as a, max(v) as b from {PX})"))
def minmax_movie(spark, d):
    return _frames(movies.normalize(t.movie(spark, d)))


@query(f"select min(v) as least, max(v) as most from {PX}")
def movie_range(spark, d):
    return movies.value_range(t.movie(spark, d))


@query(_sums(f"select frame, y, x, cast(case when b > a then (v - a) / (b - a) else 0 end as float) as v from {PX} join (select frame, min(v) as a, max(v) as b from {PX} group by 1) using (frame)"))
def minmax_images(spark, d):
    return _frames(movies.scaled_image(t.movie(spark, d)))


PCT = f"(select frame, quantile_cont(cast(v as double), 0.01) as a, quantile_cont(cast(v as double), 0.99) as b, quantile_cont(cast(v as double), 0.995) as c from {PX} group by 1)"


@query(_sums(f"select frame, y, x, greatest(least(cast(v as double), b), a) as v from {PX} join {PCT} using (frame)"))
def percentile_clip(spark, d):
    return _frames(movies.clipped(t.movie(spark, d)))


@query(_sums(f"select frame, y, x, greatest(least((cast(v as double) - a) / greatest(c - a, 1e-6), 1), 0) as v from {PX} join {PCT} using (frame)"))
def percentile_view(spark, d):
    return _frames(movies.percentile_view(t.movie(spark, d)))


@query(_sums(f"select frame, y, x, cast(floor(greatest(least((cast(v as double) - a) / (b - a), 1), 0) * 255) as integer) as v from {PX} join {PCT} using (frame)"))
def gray_levels(spark, d):
    return _frames(movies.gray_levels(t.movie(spark, d)))


@query(_sums(f"select frame, y, x, cast(round_even(greatest(least((cast(v as double) - a) / (c - a), 1), 0) * 255, 0) as integer) as v from {PX} join {PCT} using (frame)"))
def gray_levels_rounded(spark, d):
    return _frames(movies.gray_levels(t.movie(spark, d), 1, 99.5, cut=False))


SAT = f"(select frame, quantile_cont(cast(v as double), 0.0035) as a, quantile_cont(cast(v as double), 0.9965) as b from {PX} group by 1)"


@query(_sums(f"select frame, y, x, cast(round_even(greatest(least((cast(v as double) - a) / (b - a), 1), 0) * 255, 0) as integer) as v from {PX} join {SAT} using (frame)"))
def saturated_levels(spark, d):
    return _frames(movies.saturated_levels(t.movie(spark, d)))


RANGES = f"""with p as (select frame, cast(v as double) as v from {PX}), e as (select frame, min(v) as a, max(v) as b, count(*) as total from p group by 1),
h as (select frame, cast(least(floor((v - a) * (256 / (b - a))), 255) as integer) as bin, count(*) as n from p join e using (frame) group by 1, 2),
g as (select frame, min(bin) as f, max(bin) as l from h join e using (frame) where n <= total // 10 and n > total // 5000 group by 1),
r as (select frame, a, b, a + coalesce(f, 255) * ((b - a) / 256) as lo, a + coalesce(l, 0) * ((b - a) / 256) as hi from e left join g using (frame)),
ranges as (select frame, case when hi > lo then lo else a end as low, case when hi > lo then hi else b end as high from r)"""


@query(f"{RANGES} select frame, (round(low, 6) + 0.0::double) as low, (round(high, 6) + 0.0::double) as high from ranges")
def display_range(spark, d):
    return movies.display_range(t.movie(spark, d)).select("frame", _r("low").alias("low"), _r("high").alias("high"))


@query(f"select frame, cast(min(v) as double) as low, case when max(v) > min(v) then cast(max(v) as double) else min(v) + 1e-6 end as high from {PX} group by 1")
def display_limits(spark, d):
    return movies.display_limits(t.movie(spark, d))


@query(f"select y, x, (round(sum(cast(v as double)), 4) + 0.0::double) as v from {PX} group by y, x")
def projection_sum(spark, d):
    return movies.projection_sum(t.movie(spark, d)).select("y", "x", _r("v", 4).alias("v"))


@query(f"select y, x, (round(m, 6) + 0.0::double) as mean, (round(sqrt(greatest(q - m * m, 0)), 6) + 0.0::double) as std from (select y, x, avg(cast(v as double)) as m, avg(cast(v * v as double)) as q from {PX} group by y, x)")
def projection_stats(spark, d):
    return movies.projection_stats(t.movie(spark, d)).select("y", "x", _r("mean").alias("mean"), _r("std").alias("std"))


@query(_sums(f"select * from {PX} where frame >= 100 and frame < 300"))
def frame_range(spark, d):
    return _frames(movies.frames_between(t.movie(spark, d), 100, 300))


@query(f"select frame, cast(y - 2 as integer) as y, cast(x - 1 as integer) as x, v from {PX} where y >= 2 and y < 6 and x >= 1 and x < 5")
def crop_box(spark, d):
    return movies.cropped(movies.pixels(t.movie(spark, d)), (2, 6, 1, 5))


@query(f"select frame, cast(y // 4 as integer) as quadrant_row, cast(x // 4 as integer) as quadrant_col, cast(3 - y % 4 as integer) as y, cast(3 - x % 4 as integer) as x, v from {PX}")
def rotated_quadrants(spark, d):
    return movies.quadrants(movies.pixels(t.movie(spark, d)), 8, 8)


@query(f"select frame, cast(ty as integer) as y, cast(tx as integer) as x, v from {PX} join (select i as ty, least(i * 8 // 5, 7) as y from range(5) r(i)) using (y) join (select i as tx, least(i * 8 // 11, 7) as x from range(11) r(i)) using (x)")
def nearest_resize(spark, d):
    return movies.resized(movies.pixels(t.movie(spark, d)), (8, 8), (5, 11))


@query("select i, cast(case when m < 8 then m else 15 - m end as integer) as source from (select cast(i as integer) as i, ((i - 5) % 16 + 16) % 16 as m from range(24) r(i))")
def mirrored_index(spark, d):
    return spark.range(24).select(F.col("id").cast("int").alias("i"), movies.mirrored_index(F.col("id").cast("int"), 5, 8).alias("source"))


@query("select count(*) as frames, 8 as h, 8 as w from embeddings")
def movie_shape(spark, d):
    return movies.shape(t.movie(spark, d))


# ---- intervals, patches


HOURS = "(select distinct user_id as id, epoch_us(ts) // 3600000000 as t from events)"
RUNS = f"(select id, min(t) as start, max(t) + 1 as \"end\" from (select id, t, t - row_number() over (partition by id order by t) as g from {HOURS}) group by id, g)"


@query(f"select id, start, \"end\" from {RUNS}")
def active_runs(spark, d):
    return intervals.true_runs(t.samples(spark, d).withColumn("active", F.lit(True)), ["id"], "t", "active")


LIFE = "(select user_id as id, epoch_us(ts) // 3600000000 as start, epoch_us(ts) // 3600000000 + 1 + event_id % 30 as \"end\" from events)"
MERGED = f"""(select id, min(start) as start, max("end") as "end" from (select *, sum(n) over (partition by id order by start, "end" rows unbounded preceding) as g
 from (select *, case when start <= max("end") over (partition by id order by start, "end" rows between unbounded preceding and 1 preceding) then 0 else 1 end as n from {LIFE})) group by id, g)"""


def _lives(spark, d):
    return t.samples(spark, d).select("id", F.col("t").alias("start"), (F.col("t") + 1 + F.col("event_id") % 30).alias("end"))


@query(f"select id, start, \"end\" from {MERGED}")
def merged_intervals(spark, d):
    return intervals.merged_runs(_lives(spark, d), ["id"])


@query(f"""select distinct id, length, cut from (select *, 474060 as length, cast(greatest(1, least(floor((start + "end") / 2.0 + 0.5), 474059)) as integer) as cut from {MERGED})
where start > 0 and "end" < 474060 and cut > 200 and cut < 473860""")
def run_cuts(spark, d):
    runs = intervals.merged_runs(_lives(spark, d), ["id"]).withColumn("length", F.lit(474060))
    return intervals.cuts_of_runs(runs, ["id"], "length", 200)


@query(f"""select id, cast(floor((start + "end") / 2.0 + 0.5) as integer) as cut from (select *, row_number() over (partition by id order by "end" - start desc, start) as r from {MERGED}) where r = 1""")
def longest_run_centre(spark, d):
    return intervals.longest_run_cut(intervals.merged_runs(_lives(spark, d), ["id"]), ["id"], 10_000_000)


@query("""select '0-0-' || r || '-' || c as name, 0 as quadrant_row, 0 as quadrant_col, cast(r as integer) as patch_row, cast(c as integer) as patch_col,
cast(r * 30 as integer) as y0, cast(least(r * 30 + 30, 100) as integer) as y1, cast(c * 30 as integer) as x0, cast(least(c * 30 + 30, 75) as integer) as x1 from range(4) a(r), range(3) b(c)""")
def regular_grid(spark, d):
    return patches.regular_grid(spark, 100, 75, 30)


GRID = "(select '0-0-' || r || '-' || c as name, cast(r * 3 as integer) as y0, cast(least(r * 3 + 3, 8) as integer) as y1, cast(c * 3 as integer) as x0, cast(least(c * 3 + 3, 8) as integer) as x1 from range(3) a(r), range(3) b(c))"


@query(f"select name, frame, cast(y - y0 + 1 as integer) as y, cast(x - x0 + 1 as integer) as x, v from {PX} join {GRID} on y >= y0 - 1 and y < y1 + 1 and x >= x0 - 1 and x < x1 + 1")
def pixels_in_patches(spark, d):
    return patches.in_patches(movies.pixels(t.movie(spark, d)), patches.regular_grid(spark, 8, 8, 3), 1, bin_size=4)


@query(f"""with g as (select name, frame, i as y, j as x, y0, x0 from {GRID}, range(5) a(i), range(5) b(j), (select vec_id as frame from embeddings) where i < y1 - y0 + 2 and j < x1 - x0 + 2)
select g.name, cast(g.frame as integer) as frame, cast(g.y as integer) as y, cast(g.x as integer) as x, coalesce(cast(p.v as double), 0) as v from g left join {PX} p on p.frame = g.frame and p.y = g.y + y0 - 1 and p.x = g.x + x0 - 1""")
def padded_patches(spark, d):
    cut = patches.padded_patches(t.movie(spark, d), (8, 8), patches.regular_grid(spark, 8, 8, 3), 1)
    return cut.select("name", "frame", "w", F.posexplode("data").alias("i", "v")).select("name", "frame", F.expr("i div w").cast("int").alias("y"), F.expr("i % w").alias("x"), "v")


@query(f"select cast(i as integer) as y, cast(j as integer) as x, count(*) as n from {GRID}, range(8) a(i), range(8) b(j) where i >= y0 and i < y1 and j >= x0 and j < x1 group by 1, 2")
def patch_coverage(spark, d):
    return patches.coverage(patches.regular_grid(spark, 8, 8, 3))


@query(f"select distinct cast(i as integer) as y, cast(j as integer) as x from {GRID}, range(8) a(i), range(8) b(j) where i >= y0 and i < y1 and j >= x0 and j < x1 and (i < y0 + 1 or i >= y1 - 1 or j < x0 + 1 or j >= x1 - 1)")
def patch_borders(spark, d):
    return patches.border_mask(patches.regular_grid(spark, 8, 8, 3), 2)


@query(r"""select o_orderkey as k, n, regexp_matches(n, '^\d+-\d+-\d+-\d+$') as valid, try_cast(split_part(n, '-', 3) as integer) as patch_row from
(select o_orderkey, (o_orderkey % 2) || '-' || (o_custkey % 2) || '-' || (o_orderkey % 7) || (case when o_orderkey % 5 = 0 then '' else '-' || (o_custkey % 5) end) as n from orders)""")
def patch_names(spark, d):
    o = t.table(spark, d, "orders")
    tail = F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("-"), (F.col("o_custkey") % 5).cast("string")))
    name = F.concat((F.col("o_orderkey") % 2).cast("string"), F.lit("-"), (F.col("o_custkey") % 2).cast("string"), F.lit("-"), (F.col("o_orderkey") % 7).cast("string"), tail)
    rows = o.select(F.col("o_orderkey").alias("k"), name.alias("n"))
    parsed = patches.parse_name(F.concat(F.col("n"), F.lit(".tif.hdf5")))
    row = F.split("n", "-")[2].cast("int")
    return rows.select("k", "n", parsed.isNotNull().alias("valid"), F.coalesce(parsed["patch_row"], row).alias("patch_row"))


# ---- stitching

LO, HI = f"(select * from {PX} where frame % 2 = 0)", f"(select frame - 1 as frame, y, x, v from {PX} where frame % 2 = 1)"


def _pairs(spark, d):
    """Frames with even numbers, and the next one beside each."""
    movie = t.movie(spark, d)
    odd = movie.where("frame % 2 = 1").select((F.col("frame") - 1).alias("frame"), F.col("data").alias("moving"))
    return movie.where("frame % 2 = 0").join(odd, "frame")


PLACED = f"""(select coalesce(r.frame, m.frame) as frame, coalesce(r.y, m.y) as y, coalesce(r.x, m.x) as x, coalesce(r.v, 0) as rv, coalesce(r.s, 0) as rs, coalesce(m.v, 0) as mv, coalesce(m.s, 0) as ms
from (select frame, y, cast(x + 2 as integer) as x, cast(v as double) as v, 1.0 as s from {LO}) r full join (select frame, cast(y + 5 as integer) as y, x, cast(v as double) as v, 1.0 as s from {HI}) m on r.frame = m.frame and r.y = m.y and r.x = m.x)"""


@query(f"select frame, y, x, (round((rv + mv) / greatest(rs + ms, 1e-6), 6) + 0.0::double) as v from {PLACED}")
def stitch_average(spark, d):
    both = stitching.averaged(_pairs(spark, d), ((8, 8), (8, 8)), (5.0, -2.0))
    return stitching.supported(both).select("frame", "y", "x", _r("v").alias("v"))


@query(f"""select frame, y, x, (round(case when rs > 0 and ms > 0 then rv * (1 - (y - 5) / 2.0) + mv * ((y - 5) / 2.0) else rv + mv end, 6) + 0.0::double) as v from {PLACED}""")
def stitch_ramp(spark, d):
    both = stitching.blended(_pairs(spark, d), ((8, 8), (8, 8)), (5.0, -2.0), "vertical")
    return stitching.supported(both).select("frame", "y", "x", _r("v").alias("v"))


@query(f"""with a as (select frame, y, x, case when y = 0 then 0 else 0.75 * cast(v as double) + 0.25 * lag(cast(v as double)) over (partition by frame, x order by y) end as v, case when y = 0 then 0 else 1 end as s from {PX}),
b as (select frame, y, x, case when x = 0 then 0 else 0.5 * v + 0.5 * lag(v) over (partition by frame, y order by x) end as v, case when x = 0 then 0 else 0.5 * s + 0.5 * lag(s) over (partition by frame, y order by x) end as s from a)
select frame, y, x, (round(v, 6) + 0.0::double) as v, cast(s as double) as s from b""")
def subpixel_shift(spark, d):
    both = stitching.shifted(t.movie(spark, d), (8, 8), 0.25, 0.5)
    pixel = movies.pixels(both.withColumn("data", F.arrays_zip("data", "support")))
    return pixel.select("frame", "y", "x", _r(F.col("v.data")).alias("v"), F.col("v.support").alias("s"))


@query(f"select a.frame, (round(case when b = 0 then 1 else a / b end, 4) + 0.0::double) as ratio from (select frame, avg(cast(v as double)) as a from {PX} where y < 4 group by 1) a join (select frame, avg(cast(v as double)) as b from {PX} where y >= 4 group by 1) b using (frame)".replace("select a.frame", "select frame"))
def brightness_ratio(spark, d):
    px = movies.pixels(t.movie(spark, d))
    return stitching.brightness_ratio(px.where("y < 4"), px.where("y >= 4")).select("frame", _r("ratio", 4).alias("ratio"))


# ---- footprints and products

FP = "(select cast(label as varchar) as patch, cast(vec_id as integer) as k, i - 1 as p, embedding[i] as w from (select label, vec_id, embedding, unnest(range(1, 65)) as i from embeddings) where embedding[i] > 0.1)"
SPEC = "(select cast(i as varchar) as patch, i // 5 * 6 as y0, i % 5 * 6 as x0 from range(10) r(i))"


@query(f"select patch, k, cast(p % 8 - 1 + y0 as integer) as y, cast(p // 8 - 1 + x0 as integer) as x, cast(w as double) as w from {FP} join {SPEC} using (patch) where p % 8 between 1 and 6 and p // 8 between 1 and 6")
def core_pixels(spark, d):
    return footprints.core_pixels(t.footprints(spark, d), t.specs(spark, d))


CSUM = "(select cast(label as varchar) as patch, cast(vec_id as integer) as k, list_sum([cast(x as double) for x in embedding[1:16]]) as c, case when vec_id % 2 = 1 then list_sum([cast(x as double) for x in embedding[17:32]]) else 0 end as r from embeddings)"


@query(f"select patch, p, (round(sum(cast(w as double) * (c + r)), 4) + 0.0::double) as v from {FP} join {CSUM} using (patch, k) where k in (select c_custkey from (select c_custkey, ((case when c_acctbal > 0 then log10(c_acctbal) else '-infinity'::double end) - m) / s as z from customer, (select avg(log10(c_acctbal)) as m, stddev_pop(log10(c_acctbal)) as s from customer where c_acctbal > 0)) where not (z < -1.5 or z > 2.0)) group by patch, p")
def product_image_qc(spark, d):
    rows = t.footprints(spark, d)
    accounts = t.accounts(spark, d)
    kept = quality.with_keep(accounts, quality.fit(accounts, [ACCOUNT]), [ACCOUNT]).where("keep").select("k")
    keep = rows.select("patch", "k").distinct().join(kept, "k", "left_semi")
    return footprints.product_image(rows, t.traces(spark, d), keep, residual=True).select("patch", "p", _r("v", 4).alias("v"))


CT = "(select cast(label as varchar) as patch, cast(vec_id as integer) as k, i - 1 as t, cast(embedding[i] as double) as c from (select label, vec_id, embedding, unnest(range(1, 17)) as i from embeddings))"


@query(f"select patch, p, cast(t as integer) as t, (round(sum(cast(w as double) * c), 4) + 0.0::double) as v from {FP} join {CT} using (patch, k) group by patch, p, t")
def product_movie(spark, d):
    return footprints.product_movie(t.footprints(spark, d), t.traces(spark, d)).select("patch", "p", "t", _r("v", 4).alias("v"))


@query(f"""with m as (select patch, p, t, sum(cast(w as double) * c) as v from {FP} join {CT} using (patch, k) group by 1, 2, 3)
select cast(t as integer) as t, cast(p % 8 - 1 + y0 as integer) as y, cast(p // 8 - 1 + x0 as integer) as x, (round(v, 4) + 0.0::double) as v from m join {SPEC} using (patch) where p % 8 between 1 and 6 and p // 8 between 1 and 6""")
def products_on_canvas(spark, d):
    movie = footprints.product_movie(t.footprints(spark, d), t.traces(spark, d))
    return footprints.on_canvas(movie, t.specs(spark, d)).select("t", "y", "x", _r("v", 4).alias("v"))


BASE, RING = "(select distinct patch, p, 0.01 * p as b from FP)", "(select distinct patch, p, (p + 9 * j) % 64 as q, 1.0 / (2 + j) as w from FP, range(1, 4) r(j))"


@query(f"""with m as (select patch, p, t, sum(cast(w as double) * c) as v from {FP} join {CT} using (patch, k) group by 1, 2, 3),
b as {BASE}, r as {RING}, y as (select patch, p, t, 0.5 * v + 0.1 * p as v from m),
rest as (select y.patch, y.p as q, y.t, y.v - coalesce(m.v, 0) - b as r from y left join m using (patch, p, t) join b using (patch, p))
select patch, p, cast(t as integer) as t, (round(sum(w * r) + any_value(b), 4) + 0.0::double) as v from r join rest using (patch, q) join b using (patch, p) group by patch, p, t""".replace("from FP", f"from {FP}"))
def ring_background(spark, d):
    rows = t.footprints(spark, d)
    model = footprints.product_movie(rows, t.traces(spark, d))
    cells = rows.select("patch", "p").distinct()
    b0 = cells.withColumn("v", F.col("p") * 0.01)
    ring = cells.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(3)))).select("patch", "p", ((F.col("p") + 9 * F.col("j")) % 64).alias("q"), (1.0 / (2 + F.col("j"))).alias("w"))
    movie = model.withColumn("v", 0.5 * F.col("v") + 0.1 * F.col("p"))
    return footprints.ring_background(movie, model, b0, ring).select("patch", "p", "t", _r("v", 4).alias("v"))


@query(f"select patch, k, cast(p as bigint) as p, w from (select *, row_number() over (partition by patch, k order by w desc, p) as r from {FP}) where r = 1")
def footprint_peaks(spark, d):
    return footprints.peaks(t.footprints(spark, d))


@query(f"""with n as (select patch, k, sqrt(sum(cast(w as double) * cast(w as double))) as n from {FP} group by 1, 2), f as (select patch, p, k, cast(w as double) / n as w from {FP} join n using (patch, k))
select patch, i, j, (round(v, 6) + 0.0::double) as v from (select a.patch, a.k as i, b.k as j, sum(a.w * b.w) as v from f a join f b on a.patch = b.patch and a.p = b.p and a.k <> b.k group by 1, 2, 3)""")
def footprint_overlaps(spark, d):
    return footprints.overlaps(t.footprints(spark, d)).select("patch", "i", "j", _r("v").alias("v"))


@query(f"""with n as (select patch, k, sqrt(sum(cast(w as double) * cast(w as double))) as n from {FP} group by 1, 2), f as (select patch, p, k, cast(w as double) / n as w from {FP} join n using (patch, k)),
o as (select a.patch, a.k, b.k as j from f a join f b on a.patch = b.patch and a.p = b.p and a.k <> b.k group by 1, 2, 3 having sum(a.w * b.w) > 0.35),
act as (select patch, k, t from {CT} where c > 0.17), taken as (select distinct o.patch, o.k, t from o join act on act.patch = o.patch and act.k = o.j),
own as (select distinct patch, k from act anti join taken using (patch, k, t))
select patch, k, own.k is null as joint_only from (select distinct patch, k from {FP}) a left join own using (patch, k)""".replace("own.k is null", "h is null").replace("select distinct patch, k from act anti", "select distinct patch, k, true as h from act anti"))
def joint_only_flags(spark, d):
    rows = t.footprints(spark, d)
    active = t.traces(spark, d).select("patch", "k", F.posexplode("c").alias("t", "c")).where("c > cast(0.17 as decimal(3, 2))").select("patch", "k", "t")
    return footprints.joint_only(rows, active, 0.35)


@query("""with n as (select vec_id, label, embedding as e, sqrt(list_sum([cast(x as double) * cast(x as double) for x in embedding])) as n from embeddings)
select a.label, a.vec_id as a, b.vec_id as b, (round(c, 6) + 0.0::double) as cosine from (select a.label, a.vec_id as a, b.vec_id as b, list_sum([cast(x as double) * cast(b.e[i] as double) for x, i in a.e]) / (a.n * b.n) as c from n a join n b on a.label = b.label and a.vec_id < b.vec_id) where c > 0.3""".replace("select a.label, a.vec_id as a, b.vec_id as b, (round", "select label, a, b, (round"))
def component_similarity(spark, d):
    return footprints.dot_products(t.table(spark, d, "embeddings"), "vec_id", "embedding", ["label"], 0.3).select("label", "a", "b", _r("cosine").alias("cosine"))


POINTS = "(select c_custkey as k, cast(c_custkey * 37 % 211 as double) as y, cast(c_custkey * 53 % 197 as double) as x from customer)"


def _points(spark, d):
    k = F.col("c_custkey")
    return t.table(spark, d, "customer").select(k.alias("k"), (k * 37 % 211).cast("double").alias("y"), (k * 53 % 197).cast("double").alias("x"))


@query(f"select a.k, (round(min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)), 6) + 0.0::double) as distance from {POINTS} a join {POINTS} b on a.k <> b.k group by a.k".replace("select a.k, round", "select a.k as k, round"))
def nearest_neighbours(spark, d):
    return neighbours.nearest(_points(spark, d), "k").select("k", _r("distance").alias("distance"))


@query(f"select round(greatest(24, 2 * m), 6) + 0.0::double as sigma, round(m, 6) + 0.0::double as median from (select coalesce(quantile_cont(d, 0.5), 0) as m from (select min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) as d from {POINTS} a join {POINTS} b on a.k <> b.k group by a.k))")
def typical_spacing(spark, d):
    return footprints.spacing(neighbours.nearest(_points(spark, d), "k")).select(_r("sigma").alias("sigma"), _r("median").alias("median"))


@query("select cast(c_custkey % 20 as integer) as y, cast(c_nationkey as integer) as x, (round(sum(c_acctbal), 4) + 0.0::double) as total, count(*) as n from customer group by 1, 2")
def scattered_values(spark, d):
    rows = t.table(spark, d, "customer").select((F.col("c_custkey") % 20).cast("int").alias("y"), F.col("c_nationkey").alias("x"), "c_acctbal")
    return footprints.scattered(rows, "c_acctbal").select("y", "x", _r("total", 4).alias("total"), "n")


@query(f"select b.y, b.x, coalesce(f.v, b.v) as v from (select * from {PX} where frame = 0) b left join (select * from {PX} where frame = 1 and v > 0.05) f using (y, x)".replace("select b.y, b.x", "select y, x").replace("frame = 0", "frame = (select min(vec_id) from embeddings)").replace("frame = 1 ", "frame = (select max(vec_id) from embeddings) "))
def overlay(spark, d):
    movie = t.movie(spark, d)
    ends = movie.agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    px = movies.pixels(movie).crossJoin(F.broadcast(ends))
    return footprints.overlaid(px.where("frame = b and v > cast(0.05 as decimal(3, 2))"), px.where("frame = a"))


@query("select cast(c_nationkey as integer) as y, cast(c_custkey % 3 as integer) as x, arg_max(c_mktsegment, c_custkey) as colour from customer group by 1, 2")
def painted_outlines(spark, d):
    rows = t.table(spark, d, "customer").select(F.col("c_nationkey").alias("y"), (F.col("c_custkey") % 3).cast("int").alias("x"), F.col("c_mktsegment").alias("colour"), "c_custkey")
    return footprints.painted(rows, "c_custkey", "colour")


@query("select s_suppkey, s_nationkey from supplier anti join (select n_nationkey as s_nationkey from nation where n_regionkey < 3) using (s_nationkey)")
def unmatched_patches(spark, d):
    nations = t.table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"))
    return footprints.unmatched(t.table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), nations, ["s_nationkey"])


@query("select o_orderkey, o_custkey from orders semi join (select c_custkey as o_custkey from customer where c_acctbal > 0) using (o_custkey)")
def models_with_profiles(spark, d):
    good = t.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return footprints.models_with_profiles(t.table(spark, d, "orders").select("o_orderkey", "o_custkey"), good, ["o_custkey"])


# ---- traces and regions


@query("select user_id as id, (round(avg(value), 6) + 0.0::double) as mean, (round(stddev_pop(value), 6) + 0.0::double) as std, (round(quantile_cont(value, 0.05), 6) + 0.0::double) as p05, (round(quantile_cont(value, 0.95), 6) + 0.0::double) as p95 from events group by 1")
def trace_stats(spark, d):
    stats = traces.sample_stats(t.samples(spark, d), ["id"], "v")
    return stats.select("id", *(_r(c).alias(c) for c in ("mean", "std", "p05", "p95")))


@query(f"select frame, (round(avg(cast(v as double)), 6) + 0.0::double) as mean, (round(stddev_pop(cast(v as double)), 6) + 0.0::double) as std, (round(quantile_cont(cast(v as double), 0.05), 6) + 0.0::double) as p05, (round(quantile_cont(cast(v as double), 0.95), 6) + 0.0::double) as p95 from {PX} group by 1")
def array_trace_stats(spark, d):
    stats = traces.trace_stats(t.movie(spark, d), ["frame"], "data")
    return stats.select("frame", *(_r(c).alias(c) for c in ("mean", "std", "p05", "p95")))


@query("select event_id, (round(greatest(least((value - m) / greatest(s, 1e-6), 4.5), -2.5), 6) + 0.0::double) as z from events join (select user_id, avg(value) as m, stddev_pop(value) as s from events group by 1) using (user_id)")
def heat_levels(spark, d):
    rows = t.samples(spark, d)
    return traces.heat_levels(rows, traces.sample_stats(rows, ["id"], "v"), ["id"], "v").select("event_id", _r("z").alias("z"))


NEURONS = "(select c_custkey as id, c_nationkey as roi, c_acctbal as x, c_custkey % 7 as y from customer)"


def _neurons(spark, d):
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("roi"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 7).alias("y"))


@query(f"""with r as (select *, row_number() over (partition by roi order by x, y, id) - 1 as r from {NEURONS}),
s as (select roi, coalesce(sum(count(*) * 1.08::double + 0.9::double) over (order by roi rows between unbounded preceding and 1 preceding), 0) as s from {NEURONS} group by roi)
select id, roi, (round(s + r * 1.08, 6) + 0.0::double) as "offset" from r join s using (roi)""")
def trace_layout(spark, d):
    return traces.layout(_neurons(spark, d)).select("id", "roi", _r("offset").alias("offset"))


@query("select c_custkey as id, coalesce('R' || n_regionkey, 'unassigned') as roi from customer left join (select * from nation where n_regionkey < 3) on c_nationkey = n_nationkey")
def region_membership(spark, d):
    c, n = t.table(spark, d, "customer"), t.table(spark, d, "nation").where("n_regionkey < 3")
    members = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("neuron_id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("roi_id"))
    return traces.with_regions(c.select(F.col("c_custkey").alias("id")), members).select("id", "roi")


@query("""select neuron_id, roi_id from (select o_custkey as neuron_id, o_orderpriority as roi_id, row_number() over (partition by o_custkey order by o_orderkey, o_orderpriority) as r
from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)) where r = 1""")
def valid_members(spark, d):
    stored = t.table(spark, d, "orders").select(F.col("o_custkey").alias("neuron_id"), F.col("o_orderpriority").alias("roi_id"), "o_orderkey")
    alive = t.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return traces.valid_members(stored, alive, "o_orderkey").select("neuron_id", "roi_id")


@query("select n_nationkey, cast(row_number() over (order by n_nationkey) as integer) as ordinal, 'ROI ' || row_number() over (order by n_nationkey) as name, cast((row_number() over (order by n_nationkey) - 1) % 6 as integer) as colour from nation")
def region_styles(spark, d):
    return traces.region_styles(t.table(spark, d, "nation").select("n_nationkey"), "n_nationkey")


@query("select user_id as id, event_id, cast(r as integer) as rank from (select *, row_number() over (partition by user_id order by value desc, event_id) as r from events where value > 0.3) where r <= 10")
def top_peaks(spark, d):
    return traces.top_peaks(t.samples(spark, d), ["id"], "event_id", "v").select("id", "event_id", "rank")


@query("select distinct user_id as id, epoch_us(ts) // 3600000000 as t from events where event_type = 'view' except select user_id, epoch_us(ts) // 3600000000 from events where event_type = 'purchase'")
def pending_work(spark, d):
    hour = F.expr("unix_micros(cast(ts as timestamp)) div 3600000000")
    e = t.table(spark, d, "events").select(F.col("user_id").alias("id"), hour.alias("t"), "event_type")
    of = lambda kind: e.where(F.col("event_type") == kind).select("id", "t").distinct()
    return traces.pending(of("view"), of("purchase"), ["id", "t"])


@query("select event_id, (round((value - p05) / greatest(p95 - p05, 1e-6) - 1.08 * user_id, 6) + 0.0::double) as level from events join (select user_id, quantile_cont(value, 0.05) as p05, quantile_cont(value, 0.95) as p95 from events group by 1) using (user_id)")
def trace_levels(spark, d):
    rows = t.samples(spark, d)
    offsets = rows.select("id").distinct().withColumn("offset", 1.08 * F.col("id"))
    return traces.laid_out(rows, traces.sample_stats(rows, ["id"], "v"), offsets, "v").select("event_id", _r("level").alias("level"))


@query("""select p_partkey as k, case when p_size % 3 = 0 then 'c' when p_size % 3 = 1 then case when p_size % 2 = 0 then 'c' else 'c_plus_yra' end else 'c_plus_yra' end as source from part""")
def trace_sources(spark, d):
    size = F.col("p_size")
    there = F.when(size % 3 == 0, F.array(F.lit("c"))).when(size % 3 == 1, F.array(F.lit("c_plus_yra"), F.lit("c"))).otherwise(F.array(F.lit("c_plus_yra")))
    wanted = F.when(size % 2 == 0, F.lit("c")).otherwise(F.lit("c_plus_yra"))
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("k"), traces.active_source(there, wanted).alias("source"))


@query("select count(*) as n, cast(64 as bigint) as length, true as complete from embeddings")
def trace_buffer_size(spark, d):
    return traces.buffer_size(traces.packed(t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))))


# ---- timing


#: Roots of the kernels of all parts in SQL, and their time constants.
KERNELS = """g as (select p_partkey as k, 0.9::double + p_size / 80.0::double as g0, -0.05::double - p_size / 150.0::double as g1 from part),
r as (select k, g0, g1, g0 * g0 + 4 * g1 as disc, sqrt(greatest(g0 * g0 + 4 * g1, 0)) as h from g),
v as (select k, case when disc > 0 and 0.5 * (g0 + h) < 1 and 0.5 * (g0 - h) > 0 then -0.1::double / ln(0.5 * (g0 + h)) end as slow, case when disc > 0 and 0.5 * (g0 + h) < 1 and 0.5 * (g0 - h) > 0 then -0.1::double / ln(0.5 * (g0 - h)) end as fast from r)"""


@query(f"""with {KERNELS}
select k, case when slow is null then 'nan'::double else (round(1000 * fast * slow / (slow - fast) * ln(slow / fast), 4) + 0.0::double) end as t_peak from v""")
def kernel_peaks(spark, d):
    rows = t.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (0.9 + F.col("p_size") / 80.0).alias("g_0"), (-0.05 - F.col("p_size") / 150.0).alias("g_1"))
    return kinetics.with_timing(rows).select("k", _r("t_peak", 4).alias("t_peak"))


@query(f"""with recursive {KERNELS},
p as (select distinct slow, fast, fast * slow / (slow - fast) * ln(slow / fast) as peak from v where slow is not null),
t as (select *, 0.5 * (exp(-peak / slow) - exp(-peak / fast)) as target from p),
b as (select *, (select min(peak + (20 + 10 * i) * slow) from range(19) w(i) where exp(-(peak + (20 + 10 * i) * slow) / slow) - exp(-(peak + (20 + 10 * i) * slow) / fast) <= target) as high from t),
s(slow, fast, peak, target, low, high, n) as (
  select slow, fast, peak, target, peak, high, 0 from b where high is not null
  union all
  select slow, fast, peak, target, case when above then (low + high) / 2 else low end, case when above then high else (low + high) / 2 end, n + 1
  from (select *, exp(-((low + high) / 2) / slow) - exp(-((low + high) / 2) / fast) > target as above from s where n < 120))
select v.k, case when s.peak is null then 'nan'::double else round(1000 * s.peak, 4) + 0.0::double end as t_peak,
  case when s.peak is null then 'nan'::double else round(1000 * ((s.low + s.high) / 2 - s.peak), 4) + 0.0::double end as t_half
from v left join s on v.slow = s.slow and v.fast = s.fast and s.n = 120""")
def kernel_half_decay(spark, d):
    rows = t.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (0.9 + F.col("p_size") / 80.0).alias("g_0"), (-0.05 - F.col("p_size") / 150.0).alias("g_1"))
    return kinetics.with_timing(rows).select("k", _r("t_peak", 4).alias("t_peak"), _r("t_half", 4).alias("t_half"))


@query("""select n_regionkey, n_nationkey, cast(coalesce(sum(n_nationkey % 5 + 1) over (partition by n_regionkey order by n_nationkey rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from nation""")
def cumulative_offsets(spark, d):
    sizes = t.table(spark, d, "nation").select("n_regionkey", "n_nationkey", (F.col("n_nationkey") % 5 + 1).alias("size"))
    return intervals.cumulative_offsets(sizes, ["n_regionkey"], "n_nationkey", "size").select("n_regionkey", "n_nationkey", F.col("offset").cast("long").alias("offset"))


@query(QC_FIT + """ select 'snr' as key, 'log' as scale, round(ms, 8) + 0.0::double as mean, round(ss, 8) + 0.0::double as std, -1.0::double as lower_z, null::double as upper_z from s
union all select 'r_value', 'linear', round(mr, 8) + 0.0::double, round(sr, 8) + 0.0::double, -1.2::double, 1.2::double from s""")
def qc_specs(spark, d):
    rows = t.profile(spark, d)
    out = quality.specs(quality.fit(rows, [*QC, quality.Metric("t_peak")]), [*QC, quality.Metric("t_peak")])
    return out.select("key", "scale", _r("mean", 8).alias("mean"), _r("std", 8).alias("std"), "lower_z", "upper_z")


@query("""select round(avg(0.9::double + p_size / 80.0::double), 8) + 0.0::double as g_0, round(avg(-0.05::double - p_size / 150.0::double), 8) + 0.0::double as g_1,
round(avg(p_retailprice), 6) + 0.0::double as t_peak, round(avg(p_retailprice) filter (p_size > 10), 6) + 0.0::double as t_half from part""")
def kernel_means(spark, d):
    half = F.when(F.col("p_size") > 10, F.col("p_retailprice")).otherwise(F.lit(float("nan")))
    rows = t.table(spark, d, "part").select((0.9 + F.col("p_size") / 80.0).alias("g_0"), (-0.05 - F.col("p_size") / 150.0).alias("g_1"), F.col("p_retailprice").alias("t_peak"), half.alias("t_half"))
    means = quality.kernel_means(rows)
    return means.select(*(_r(c, 8 if c[0] == "g" else 6).alias(c) for c in means.columns))


@query(f"""with recursive c as (
  select distinct id, cut from (select *, cast(greatest(1, least(floor((start + "end") / 2.0 + 0.5), 474059)) as bigint) as cut from {MERGED})
  where start > 0 and "end" < 474060 and cut > 200 and cut < 473860),
e as (select id, list(cut order by cut) as cs from c group by id),
w as (select id, list_transform(range(1, len(cs) + 2), lambda i: coalesce(cs[i], 474060) - coalesce(cs[i - 1], 0)) as ws from e),
s(id, ws, i, width, passed) as (
  select id, ws, 2, ws[1], cast([] as bigint[]) from w
  union all
  select id, ws, i + 1,
    case when width < 24 and i <= len(ws) and (len(passed) = 0 or passed[-1] > ws[i]) then width + ws[i] else ws[i] end,
    case when width < 24 and len(passed) > 0 and (i > len(ws) or passed[-1] <= ws[i]) then list_append(passed[:-2], passed[-1] + width)
         when width < 24 and i <= len(ws) then passed else list_append(passed, width) end
  from s where width is not null),
d as (select id, passed, unnest(range(1, len(passed) + 1)) as k from s where width is null)
select id, cast(k - 1 as integer) as row, cast(coalesce(list_sum(passed[:k - 1]), 0) as integer) as start, cast(list_sum(passed[:k]) as integer) as "end" from d""")
def axis_spans(spark, d):
    runs = intervals.merged_runs(_lives(spark, d), ["id"]).withColumn("length", F.lit(474060))
    return intervals.spans_by_axis(intervals.cuts_of_runs(runs, ["id"], "length", 200), "id", "length", 24)


@query(f"select y, x from {PX} where frame % 3 = 0 and v > 0.35 intersect select y, x from {PX} where frame % 3 = 1 and v > 0.35")
def mask_intersection(spark, d):
    on = movies.pixels(t.movie(spark, d)).where("v > cast(0.35 as decimal(3, 2))")
    return patches.in_both(on.where("frame % 3 = 0"), on.where("frame % 3 = 1"))


@query(f"select cast(i as integer) as y, cast(j as integer) as x from range(8) a(i), range(8) b(j) where not exists (select 1 from {GRID} where name not in ('0-0-1-1', '0-0-2-0') and i >= y0 and i < y1 and j >= x0 and j < x1)")
def grid_holes(spark, d):
    return patches.holes(patches.regular_grid(spark, 8, 8, 3).where("name not in ('0-0-1-1', '0-0-2-0')"), 8, 8)


@query(QC_FIT + """ select to_json({'r_value': {'scale': 'linear', 'mean': round(mr, 4), 'std': round(sr, 4)}, 'snr': {'scale': 'log', 'mean': round(ms, 4), 'std': round(ss, 4)}}) as value from s""")
def stats_json(spark, d):
    fitted = quality.fit(t.profile(spark, d), QC)
    return params.stats_json(fitted.select("metric", "scale", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std")))


@query("""select k, cast(len(ramp) as integer) as n, coalesce(ramp[1], -1.0::double) as first, round(coalesce(list_sum(list_transform(ramp, lambda v, i: v * i)), 0), 6) + 0.0::double as weighted, array_to_string(lines, ',') as lines from (
select p_partkey as k, case p_size % 7 when 0 then cast([] as double[]) when 1 then [0.5::double]
 else list_transform(range(p_size % 7), lambda i: 2.0::double + i * (-1.5::double / (p_size % 7 - 1))) end as ramp,
 case when p_size % 5 <= p_size % 7 then range(p_size % 5, p_size % 7 + 1) else cast([] as bigint[]) end as lines from part)""")
def ramps_and_ranges(spark, d):
    n = (F.col("p_size") % 7).cast("int")
    rows = t.table(spark, d, "part").select(F.col("p_partkey").alias("k"), arrays.linspace(2.0, 0.5, n).alias("ramp"), arrays.one_based((F.col("p_size") % 5).cast("int"), n).alias("lines"))
    weighted = F.aggregate(F.transform("ramp", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v)
    return rows.select("k", F.size("ramp").alias("n"), F.coalesce(F.get("ramp", F.lit(0)), F.lit(-1.0)).alias("first"), _r(weighted).alias("weighted"), F.array_join("lines", ",").alias("lines"))


@query("select to_json({'id': c_custkey, 'x': c_nationkey, 'y': c_custkey % 7, 'v': case when c_acctbal > 0 then c_custkey + 0.5::double end}) as value from customer")
def points_json(spark, d):
    c = t.table(spark, d, "customer")
    v = F.when(F.col("c_acctbal") > 0, F.col("c_custkey") + F.lit(0.5)).otherwise(F.lit(float("nan")))
    return params.points_json(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("x"), (F.col("c_custkey") % 7).alias("y"), v.cast("double").alias("v")), ["v"])


# ---- geometry, match points, pictures

BOXES = "(select c_custkey as k, c_custkey % 90 - 5.5 as y0, c_custkey % 70 - 3.0 as x0, c_custkey % 13 + 0.5 as h, c_custkey % 31 as w from customer)"


@query(f"""with s as (select k, y0, x0, least(greatest(round_even(cast(h as double), 0), 8), 80) as h, least(greatest(round_even(cast(w as double), 0), 8), 60) as w from {BOXES}),
p as (select k, least(greatest(round_even(cast(y0 as double), 0), 0), 80 - h) as y, least(greatest(round_even(cast(x0 as double), 0), 0), 60 - w) as x, h, w from s)
select k, cast(y as integer) as y0, cast(y + h as integer) as y1, cast(x as integer) as x0, cast(x + w as integer) as x1, (30 >= x and 30 <= x + w and 20 >= y and 20 <= y + h) as has_point from p""")
def clamped_boxes(spark, d):
    k = F.col("c_custkey")
    b = geometry.clamped(k % 90 - 5.5, k % 70 - 3.0, k % 13 + 0.5, k % 31, (80, 60))
    rows = t.table(spark, d, "customer").select(k.alias("k"), b.alias("b"))
    return rows.select("k", "b.*", geometry.in_roi(F.lit(20), F.lit(30), F.col("b")).alias("has_point"))


@query("""with s as (select c_custkey as k, c_custkey % 17 + 5 as rh, c_custkey % 11 + 4 as rw, c_custkey % 13 + 6 as mh, c_custkey % 7 + 3 as mw from customer)
select k, cast(least(rh, mh) as integer) as h, cast(least(rw, mw) as integer) as w, cast((rh - least(rh, mh)) // 2 as integer) as ry, cast((rw - least(rw, mw)) // 2 as integer) as rx,
cast((mh - least(rh, mh)) // 2 as integer) as my, cast((mw - least(rw, mw)) // 2 as integer) as mx from s""")
def common_crops(spark, d):
    k = F.col("c_custkey").cast("int")
    size = lambda h, w: F.struct(h.alias("h"), w.alias("w"))
    crop = geometry.common_crop(size(k % 17 + 5, k % 11 + 4), size(k % 13 + 6, k % 7 + 3))
    return t.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), crop.alias("c")).select("k", "c.*")


@query("""select c_custkey as k, round(c_custkey % 9 + (c_acctbal / 1000 - 10), 6) + 0.0::double as offset_y, round(c_custkey % 5 + (c_custkey % 30 - 15), 6) + 0.0::double as offset_x,
round(c_custkey % 9 + (c_acctbal / 1000 - 10) - 40, 6) + 0.0::double as shift_y, round(c_custkey % 5 + (c_custkey % 30 - 15), 6) + 0.0::double as shift_x from customer""")
def final_offsets(spark, d):
    k = F.col("c_custkey")
    base = F.struct((k % 9).cast("double").alias("y"), (k % 5).cast("double").alias("x"))
    out = geometry.final_offset(base, F.col("c_acctbal") / 1000, (k % 30).cast("double"), (20, 30), (40, 50), "vertical")
    return t.table(spark, d, "customer").select(k.alias("k"), out.alias("o")).select("k", *(_r(F.col(f"o.{c}")).alias(c) for c in ("offset_y", "offset_x", "shift_y", "shift_x")))


@query("""with p as (select c_custkey as k, c_custkey % 5 + 8 as h, c_custkey % 3 + 9 as w, c_custkey % 4 as y0, c_custkey % 4 + 8 as y1, 0 as x0, 9 as x1 from customer)
select k from p where h - (y1 - y0) < 0 or (h - (y1 - y0)) % 2 <> 0 or w - (x1 - x0) < 0 or (w - (x1 - x0)) % 2 <> 0""")
def bad_paddings(spark, d):
    k = F.col("c_custkey")
    rows = t.table(spark, d, "customer").select(k.alias("k"), (k % 5 + 8).alias("h"), (k % 3 + 9).alias("w"), (k % 4).alias("y0"), (k % 4 + 8).alias("y1"), F.lit(0).alias("x0"), F.lit(9).alias("x1"))
    return footprints.bad_padding(rows).select("k")


@query(f"select cast(max(y0) + 6 as integer) as h, cast(max(x0) + 6 as integer) as w from {SPEC}")
def canvas_size(spark, d):
    return footprints.canvas_size(t.specs(spark, d))


@query(f"""with e as (select frame, min(v) as a, max(v) as b from {PX} group by 1) select frame, cast(least(a, c) as double) as low, cast(greatest(b, f) as double) as high
from e join (select frame - 1 as frame, a as c, b as f from e) using (frame) where frame % 2 = 0""")
def joint_limits(spark, d):
    return movies.joint_limits(_pairs(spark, d))


@query("select cast(c_custkey as integer) as frame, 0 as y, 0 as x, cast(round_even(c_custkey * 7919 % 65536 / 257.0, 0) as integer) as r, cast(round_even(c_custkey * 104729 % 65536 / 257.0, 0) as integer) as g, 0 as b from customer")
def narrowed_colours(spark, d):
    k = F.col("c_custkey")
    rows = t.table(spark, d, "customer").select(k.cast("int").alias("frame"), F.lit(0).alias("y"), F.lit(0).alias("x"), (k * 7919 % 65536).alias("r"), (k * 104729 % 65536).alias("g"), F.lit(0).alias("b"))
    return rendering.narrowed(rows)


@query("""select p_partkey as k, case when abs(v) >= 100 or (abs(v) > 0 and abs(v) < 0.01) then printf('%.2e', v) else printf('%.2f', v) end as label, printf('%.1f', v) as time, case when p_size > 20 then '1' else '0' end as flag
from (select p_partkey, p_size, p_retailprice / 13 - 80 as v from part)""")
def map_labels(spark, d):
    v = F.col("p_retailprice") / 13 - 80
    label = lambda *how: quality.map_label(v, *how)
    return t.table(spark, d, "part").select(F.col("p_partkey").alias("k"), label("snr").alias("label"), label("t_peak").alias("time"), quality.map_label(F.col("p_size") > 20, "flag", "boolean").alias("flag"))


@query("""with b as (select c_custkey as k, cast(c_custkey % 40 as integer) as y0, cast(c_custkey % 40 + 12 as integer) as y1, cast(c_custkey % 30 as integer) as x0, cast(c_custkey % 30 + 9 as integer) as x1 from customer)
select k, y0, y1, x0, x1, cast(60 - y1 as integer) as my0, cast(60 - y0 as integer) as my1, x0 as mx0, x1 as mx1 from b""")
def mirrored_boxes(spark, d):
    k = (F.col("c_custkey")).cast("int")
    roi = geometry.box(k % 40, k % 40 + 12, k % 30, k % 30 + 9)
    pair = geometry.mirror_pair(roi, F.lit(None).cast(BOX), ((60, 50), (60, 50)), "vertical")
    rows = t.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), pair.alias("p"))
    return rows.select("k", "p.reference.*", *(F.col(f"p.moving.{c}").alias(f"m{c}") for c in ("y0", "y1", "x0", "x1")))


@query(f"""with q as (select frame, y // 4 as r, x // 4 as c, 3 - y % 4 as y, 3 - x % 4 as x, cast(v as double) as v from {PX}),
h as (select frame, r, y, x, sum(v) as v from (select frame, r, y, x, v * case when x < 2 then 1 else 1 - (x - 2) end as v from q where c = 0
 union all select frame, r, y, x + 2, v * case when x < 2 then x else 1 end from q where c = 1) group by all),
a as (select frame, y, x, v * case when y < 2 then 1 else 1 - (y - 2) end as v from h where r = 0 union all select frame, y + 2, x, v * case when y < 2 then y else 1 end from h where r = 1)
select frame, cast(y as integer) as y, cast(x as integer) as x, round(sum(v), 6) + 0.0::double as v from a group by frame, y, x""")
def match_point_mosaic(spark, d):
    points = (((3, 1), (1, 1)), ((3, 1), (1, 1)), ((1, 3), (1, 1)))
    return movies.pixels(match_points.mosaic(t.movie(spark, d), (8, 8), points)).select("frame", "y", "x", _r("v").alias("v"))


@query(f"""{RANGES} select frame, y, x, g as r, g, g as b from (select frame, y, x,
cast(round_even(greatest(least((cast(v as double) - low) / (high - low), 1), 0) * 255, 0) as integer) as g from {PX} join ranges using (frame))""")
def display_bytes(spark, d):
    gray = movies.pixels(movies.display_bytes(t.movie(spark, d))).withColumnRenamed("v", "g")
    return rendering.rgb(gray)


@query(f"""select frame, y, x, case when v > 0 then cast(frame % 200 + 1 as integer) else cast(y * 8 + x + 1 as integer) end as r,
case when v > 0 then 0 else cast(y * 8 + x + 1 as integer) end as g, case when v > 0 then 0 else cast(y * 8 + x + 1 as integer) end as b from {PX}""")
def overlay_stack(spark, d):
    px = movies.pixels(t.movie(spark, d))
    gray = (F.col("y") * 8 + F.col("x") + 1).cast("int")
    back = px.select("y", "x").distinct().select("y", "x", *(gray.alias(c) for c in "rgb"))
    red = F.when(F.col("v") > 0, (F.col("frame") % 200 + 1).cast("int")).otherwise(F.lit(0))
    return rendering.overlaid(back, px.select("frame", "y", "x", red.alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b")))


@query(f"select frame, y, x, case when y = x then 255 else 0 end as r, case when y = x then 255 else 0 end as g, case when y = x then 255 else 0 end as b from {PX}")
def mask_pictures(spark, d):
    px = movies.pixels(t.movie(spark, d))
    return rendering.mask_picture(px, px.where("y = x").select("y", "x"))


@query("select n_regionkey as kind, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1")
def anchor_kinds(spark, d):
    c, n = t.table(spark, d, "customer"), t.table(spark, d, "nation")
    return quality.counts_by(c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]), "n_regionkey")


@query(f"select frame, cast(y as integer) as y, cast(x as integer) as x, v from (select *, row_number() over (partition by frame order by v desc, y, x) as r from {PX}) where r = 1")
def image_peaks(spark, d):
    return movies.peaks(t.movie(spark, d))


@query("""with c as (select c_mktsegment as metric, c_custkey % 40 as y, c_custkey * 7 % 50 as x, sum(c_acctbal) as total, count(*) as n from customer group by all),
s as (select * from (values (6.0::double), (12.0::double), (24.0::double)) v(s)),
g as (select s, k, exp(-0.5 * (k / s) * (k / s)) as w from s, range(-96, 97) r(k) where abs(k) <= floor(4 * s + 0.5)),
u as (select s, k, w / sum(w) over (partition by s) as w from g),
ay as (select s, y, greatest(least(y + k, 39), 0) as py, sum(w) as w from u, range(40) r(y) group by all),
ax as (select s, x, greatest(least(x + k, 49), 0) as px, sum(w) as w from u, range(50) r(x) group by all),
b as (select metric, s, ay.y as y, c.x as x, sum(w * total) as total, sum(w * n) as n from c join ay on ay.py = c.y group by all),
h as (select metric, b.s as s, b.y as y, ax.x as x, sum(w * total) / greatest(sum(w * n), 1e-8) as v from b join ax on ax.s = b.s and ax.px = b.x group by all),
d as (select metric, r.y as y, q.x as x, sqrt(min((r.y - c.y) * (r.y - c.y) + (q.x - c.x) * (q.x - c.x))) as away from c, range(40) r(y), range(50) q(x) group by all),
e as (select metric, y, x, greatest(least(1 - away / 12, 1), 0) as near, greatest(least((away - 12) / 12, 1), 0) as far from d),
o as (select metric, y, x, cast(sum(v * case when s = 6 then near when s = 12 then greatest(least(1 - near - far, 1), 0) else far end) as float) as v from h join e using (metric, y, x) group by all)
select metric, round(sum(cast(v as double)), 1) + 0.0::double as total, round(sum(cast(v as double) * (y * 50 + x + 1)) / 1000, 1) + 0.0::double as weighted from o group by metric""")
def spatial_fields(spark, d):
    rows = t.table(spark, d, "customer").select((F.col("c_custkey") % 40).cast("int").alias("y"), (F.col("c_custkey") * 7 % 50).cast("int").alias("x"), F.col("c_mktsegment").alias("metric"), "c_acctbal")
    field = rendering.spatial_field(rows, "c_acctbal", (40, 50), 6.0)
    pixel = field.select("metric", F.posexplode("data").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return pixel.groupBy("metric").agg(_r(F.sum("v"), 1).alias("total"), _r(F.sum(F.col("v") * (F.col("i") + 1)) / 1000, 1).alias("weighted"))


@query()
def adaptive_fields(spark, d):
    """The widths follow the spacing of the points, one row that is read first."""
    spacing = footprints.spacing(neighbours.nearest(_points(spark, d), "k")).first()["median"]
    k = F.col("c_custkey")
    rows = t.table(spark, d, "customer").select((k * 37 % 211).cast("int").alias("y"), (k * 53 % 197).cast("int").alias("x"), F.col("c_mktsegment").alias("metric"), "c_acctbal")
    return rendering.spatial_field(rows, "c_acctbal", (211, 197), spacing)


# ---- array kernels and iterative operators, checked against numpy in the tests


@query(f"""with e as (select frame, y, x, cast(v as double) as v from {PX}),
q as (select frame, quantile_cont(v, 0.01) as a, quantile_cont(v, 0.99) as b from e group by 1),
c as (select frame, y, x, greatest(least(v, b), a) as v from e join q using (frame)),
z as (select frame, y, x, (v - avg(v) over w) / stddev_pop(v) over w * (0.5 - 0.5 * cos(2 * pi() * y / 7)) * (0.5 - 0.5 * cos(2 * pi() * x / 7)) as v from c window w as (partition by frame)),
f as (select frame, fy, fx, sum(v * cos(2 * pi() * (fy * y + fx * x) / 8)) as re, -sum(v * sin(2 * pi() * (fy * y + fx * x) / 8)) as im from z, range(8) r(fy), range(8) q(fx) group by all),
p as (select a.frame, a.fy, a.fx, a.re * b.re + a.im * b.im as re, a.im * b.re - a.re * b.im as im from f a join f b on b.frame = a.frame + 1 and b.fy = a.fy and b.fx = a.fx),
n as (select frame, fy, fx, re / greatest(sqrt(re * re + im * im), 1e-8) as re, im / greatest(sqrt(re * re + im * im), 1e-8) as im from p),
o as (select frame, (sy + 4) % 8 as y, (sx + 4) % 8 as x, cast(sqrt(power(sum(re * cos(2 * pi() * (fy * sy + fx * sx) / 8) - im * sin(2 * pi() * (fy * sy + fx * sx) / 8)) / 64, 2)
  + power(sum(re * sin(2 * pi() * (fy * sy + fx * sx) / 8) + im * cos(2 * pi() * (fy * sy + fx * sx) / 8)) / 64, 2)) as float) as v from n, range(8) r(sy), range(8) q(sx) group by frame, sy, sx)
{_sums("select * from o")}""")
def phase_correlation(spark, d):
    rows = t.movie(spark, d)
    other = rows.withColumn("frame", F.col("frame") - 1).select("frame", F.col("data").alias("moving"))
    return _frames(kernels.phase_correlation(rows.join(other, "frame")).withColumnRenamed("corr", "data"))


@query()
def ridge_correlation(spark, d):
    return kernels.phase_correlation(_pairs(spark, d), "ridges", 40.0, (1.0, 2.0))


@query(_sums(f"""with f as (select a as fy, b as fx, case when a = 0 and b = 0 then 1.0::double else (1 - exp(-(a * a + b * b) * 0.390625::double)) * exp(-(a * a + b * b) * 0.015625::double) end as gain from range(-8, 8) r(a), range(-8, 8) q(b)),
g as (select dy, dx, sum(gain * cos(2 * pi() * (fy * dy + fx * dx) / 16)) / 256 as g from f, range(16) r(dy), range(16) q(dx) group by dy, dx),
m as (select i, case when i < 4 then 3 - i when i < 12 then i - 4 else 19 - i end as s from range(16) r(i)),
k as (select y, x, a.s as py, b.s as px, sum(g) as w from range(8) r(y), range(8) q(x), m a, m b, g where dy = (y + 4 - a.i + 16) % 16 and dx = (x + 4 - b.i + 16) % 16 group by all)
select frame, k.y as y, k.x as x, cast(sum(w * cast(v as double)) as float) as v from k join {PX} p on p.y = py and p.x = px group by frame, k.y, k.x"""))
def band_pass(spark, d):
    return _frames(kernels.band_pass(t.movie(spark, d)))


#: Weights of a Gaussian of 1.5 pixels out to four deviations.
GAUSS = "(select k, g / sum(g) over () as w from (select k, exp(-0.5 * (k / 1.5::double) * (k / 1.5::double)) as g from range(-6, 7) r(k)))"


@query(_sums(f"""select a.frame as frame, a.y as y, a.x as x, cast(sum(v.w * h.w * cast(p.v as double)) as float) as v from {PX} a, {GAUSS} v, {GAUSS} h, {PX} p
where p.frame = a.frame and p.y = greatest(least(a.y + v.k, 7), 0) and p.x = greatest(least(a.x + h.k, 7), 0) group by a.frame, a.y, a.x"""))
def blurred_frames(spark, d):
    return _frames(kernels.blurred(t.movie(spark, d), 1.5))


@query()
def peak_fits(spark, d):
    rows = t.movie(spark, d)
    other = rows.withColumn("frame", F.col("frame") - 1).select("frame", F.col("data").alias("moving"))
    return kernels.peak_fits(kernels.phase_correlation(rows.join(other, "frame")).withColumnRenamed("corr", "data"), radius=3)


@query()
def vesselness(spark, d):
    return kernels.vesselness(t.movie(spark, d), (1.0, 2.0))


#: Left: canvas 7 x 4, overlap of row 3 and columns 1 to 3. Right: canvas 7 x 4 (offset 3.25: the first moving row has no support), no overlap.
MOSAIC = f"""with q as (select frame, y // 4 as r, x // 4 as c, 3 - y % 4 as y, 3 - x % 4 as x, cast(v as double) as v from {PX}),
cell as (select y, x from range(7) a(y), range(4) b(x)), f as (select distinct frame from q),
lm as (select a.frame, a.y + 3 as y, a.x, 0.5 * (a.v + b.v) as v from q a join q b on a.frame = b.frame and a.y = b.y and a.x = b.x + 1 where a.r = 1 and a.c = 0 and b.r = 1 and b.c = 0),
l as (select f.frame, cell.y, cell.x, case when a.v is not null and m.v is not null then (a.v * 0.5 + m.v * 0.5) / 1.0 else coalesce(a.v, 0) + coalesce(m.v, 0) end as v from f cross join cell
 left join (select * from q where r = 0 and c = 0) a on a.frame = f.frame and a.y = cell.y and a.x = cell.x left join lm m on m.frame = f.frame and m.y = cell.y and m.x = cell.x),
rm as (select a.frame, a.y + 3 as y, a.x, 0.75 * a.v + 0.25 * b.v as v from q a join q b on a.frame = b.frame and a.y = b.y + 1 and a.x = b.x where a.r = 1 and a.c = 1 and b.r = 1 and b.c = 1),
r as (select f.frame, cell.y, cell.x, coalesce(a.v, 0) + coalesce(m.v, 0) as v from f cross join cell
 left join (select * from q where r = 0 and c = 1) a on a.frame = f.frame and a.y = cell.y and a.x = cell.x left join rm m on m.frame = f.frame and m.y = cell.y and m.x = cell.x)
select frame, cast(y as integer) as y, cast(x as integer) as x, round(v, 6) + 0.0::double as v from (
 select frame, y, x, v from l where x < 3 union all select frame, y, x + 3, v from r where x > 0
 union all select l.frame as frame, l.y as y, 3 as x, (l.v * 0.5 + r.v * 0.5) / 1.0 as v from l join r on l.frame = r.frame and l.y = r.y where l.x = 3 and r.x = 0)"""


@query(MOSAIC)
def quadrant_mosaic(spark, d):
    offsets = {"left": (3.0, 0.5), "right": (3.25, 0.0), "final": (0.0, 3.0)}
    return movies.pixels(stitching.stitched(t.movie(spark, d), (8, 8), offsets)).select("frame", "y", "x", _r("v").alias("v"))


@query(f"""with b as (select cast(y0 as integer) as y0, cast(y1 as integer) as y1, cast(x0 as integer) as x0, cast(x1 as integer) as x1 from range(8) a(y0), range(1, 9) b(y1), range(8) c(x0), range(1, 9) d(x1) where y1 > y0 and x1 > x0),
m as (select frame, y, x from {PX} where v > -0.1), f as (select frame, y0, y1, x0, x1 from m join b on y >= y0 and y < y1 and x >= x0 and x < x1 group by all having count(*) = (y1 - y0) * (x1 - x0))
select frame, y0, y1, x0, x1 from (select *, row_number() over (partition by frame order by (y1 - y0) * (x1 - x0) desc, y0, x0, y1) as r from f) where r = 1""")
def largest_rectangles(spark, d):
    return stitching.largest_rectangle(t.movie(spark, d).withColumn("data", F.transform("data", lambda v: (v > F.lit(-0.1).cast("decimal(2, 1)")).cast("float"))))


@query("""with p as (select y, x, y // 30 as r, x // 30 as c, y % 30 as qy, x % 30 as qx from range(60) a(y), range(60) b(x)),
seam as (select r, c, qy, qx from p where qy in (0, 29) or qx in (0, 29) or qy in (11, 12, 23, 24) or qx in (11, 12, 23, 24)),
line as (select r, c, 'y' as along, qy as k from seam group by all having count(*) >= 24 union all select r, c, 'x', qx from seam group by all having count(*) >= 24),
run as (select r, c, along, min(k) as s, max(k) + 1 as e from (select *, k - row_number() over (partition by r, c, along order by k) as g from line) group by r, c, along, g),
cut as (select r, c, along, (s + e + 1) // 2 as k from run where s > 0 and e < 30 and (s + e + 1) // 2 > 2 and (s + e + 1) // 2 < 28),
edge as (select * from cut union select distinct r, c, along, unnest([0, 30]) from line),
span as (select *, lead(k) over w as n, row_number() over w - 1 as i from edge window w as (partition by r, c, along order by k))
select a.r || '-' || a.c || '-' || a.i || '-' || b.i as name, cast(a.r as integer) as quadrant_row, cast(a.c as integer) as quadrant_col, cast(a.i as integer) as patch_row, cast(b.i as integer) as patch_col,
cast(a.r * 30 + a.k as integer) as y0, cast(a.r * 30 + a.n as integer) as y1, cast(a.c * 30 + b.k as integer) as x0, cast(a.c * 30 + b.n as integer) as x1
from span a join span b on a.r = b.r and a.c = b.c and a.along = 'y' and b.along = 'x' and a.n - a.k >= 5 and b.n - b.k >= 5""")
def seam_patches(spark, d):
    h = w = 60
    seams = patches.seam_masks(spark, h, w, 12, 2)
    supports = spark.range(h * w).select(F.expr(f"cast(id div {w} as int)").alias("y"), F.expr(f"cast(id % {w} as int)").alias("x"))
    supports = supports.select(F.expr(f"cast(y div {h // 2} as int)").alias("quadrant_row"), F.expr(f"cast(x div {w // 2} as int)").alias("quadrant_col"), "y", "x")
    return patches.seam_specs(spark, supports, seams, h, w, 2, 0.8, 5)


@query(f"""with recursive c as (select patch, k, cast(p % 8 - 1 + y0 as integer) as y, cast(p // 8 - 1 + x0 as integer) as x, cast(w as double) as w from {FP} join {SPEC} using (patch) where p % 8 between 1 and 6 and p // 8 between 1 and 6),
top as (select c.*, row_number() over (partition by patch, k order by w desc, x, y) as r from c join (select patch, k, max(w) as m from c group by 1, 2) using (patch, k) where w >= 0.2 * m and w > 0),
part(patch, k, y, x) as (select patch, k, y, x from top where r = 1 union
 select t.patch, t.k, t.y, t.x from part p join top t on t.patch = p.patch and t.k = p.k and abs(t.y - p.y) + abs(t.x - p.x) = 1)
select a.patch, a.k, a.y, a.x from part a join part b on a.patch = b.patch and a.k = b.k and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all having count(*) < 9""".replace("select a.patch, a.k, a.y, a.x from part a", "select a.patch as patch, a.k as k, a.y as y, a.x as x from part a"))
def component_outlines(spark, d):
    return footprints.outlines(footprints.core_pixels(t.footprints(spark, d), t.specs(spark, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
