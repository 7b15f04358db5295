"""Queries of the engine's operators over the test tables, each with SQL for the same result where SQL can express it.

`events` stand for frames and readings: type `error` is the screen, the others are four fans; `value` is an intensity and
`props.k` a count. `lineitem` stands for sparse cells: an order is a frame, a line number a beam, a quantity a sample, a
price an amplitude. Doubles are rounded on both sides, since engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, scalars
from ..operators import asof, colors, conversion, detect, fold, frames, masks, metrics, palette, raster, regions, sweep
from ..sources import ranges, records
from ..sources.shared import kept, shared_folder
from ..streaming import folds, nearest
from .registry import query, r6, table

SCREEN, FANS = "error", ["click", "purchase", "signup", "view"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t, stream, value, n, props, ts."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), scalars.micros(F.col("ts")).alias("t"), F.col("event_type").alias("stream"), "value", F.get_json_object("props", "$.k").cast("long").alias("n"), "props", "ts")


def screen(e: DataFrame) -> DataFrame:
    return e.where(F.col("stream") == SCREEN)


_EVENTS = "e as (select event_id as id, epoch_us(ts) as t, event_type as stream, value, cast(json_extract_string(props, '$.k') as bigint) as n, ts from events)"
_FANS = ", ".join(f"('{s}')" for s in FANS)


def _nearest_sql(tie: str) -> str:
    """d (screens by fan) with the nearest candidate's id, n and gap, as CTE `met`."""
    last, closer = ("max", "<") if tie == "later" else ("min", "<=")
    return f"""
with {_EVENTS}, d as (
  select e.id, e.t, e.n, s.stream from e, (values {_FANS}) s(stream) where e.stream = '{SCREEN}'
), c as (
  select stream, t, min(id) as lo, {last}(id) as hi from e where stream <> '{SCREEN}' group by all
), b as (
  select d.*, c.t as bt, c.hi as bid from d asof left join c on d.stream = c.stream and d.t > c.t
), a as (
  select b.*, c.t as nt, c.lo as nid from b asof left join c on b.stream = c.stream and b.t <= c.t
), m as (
  select *, case when nt is null or bt is not null and t - bt {closer} nt - t then bid else nid end as found_id from a
), met as (
  select m.id as screen_id, m.t as screen_t, m.n as screen_count, m.stream, found_id, f.n as found_count, abs(m.t - f.t) as gap from m left join e f on f.id = found_id
)"""


@query(
    _nearest_sql("later")
    + """
select screen_id, screen_count, dense_rank() over (order by screen_t, screen_id) - 1 as group_index, stream, found_id, found_count,
       round(gap / 1000.0) / 1000.0 as delta_s from met"""
)
def nearest_groups(spark, sf_dir):
    e = events(spark, sf_dir)
    return frames.groups(screen(e), e.where(F.col("stream") != SCREEN), FANS).drop("screen_t")


@query(_nearest_sql("earlier") + "\nselect screen_id, stream, case when gap <= 600000000 then found_id end as found_id, case when gap <= 600000000 then round(gap / 1000.0) / 1000.0 end as delta_s from met")
def nearest_tolerance_earlier(spark, sf_dir):
    e = events(spark, sf_dir)
    return frames.groups(screen(e), e.where(F.col("stream") != SCREEN), FANS, "earlier", 600_000_000).select("screen_id", "stream", "found_id", "delta_s")


@query(
    _nearest_sql("later")
    + ", g as (select *, dense_rank() over (order by screen_t, screen_id) - 1 as group_index from met)\nselect group_index, screen_id, screen_count"
    + "".join(f", max(found_count) filter (stream = '{s}') as {s}_count, max(round(gap / 1000.0) / 1000.0) filter (stream = '{s}') as {s}_delta_s" for s in FANS)
    + ", cast(coalesce(sum(found_count), 0) as bigint) as fan_sum from g group by group_index, screen_id, screen_count"
)
def frame_group_counts(spark, sf_dir):
    e = events(spark, sf_dir)
    return frames.reported(screen(e), e.where(F.col("stream") != SCREEN), FANS).drop("screen_t")


@query(_nearest_sql("later") + f"""
select count(distinct screen_id) as groups, cast(sum(screen_count) / {len(FANS)} as bigint) as screen_total, cast(sum(found_count) as bigint) as fan_total from met""")
def run_totals(spark, sf_dir):
    return frames.totals(frame_group_counts(spark, sf_dir))


@query("select s.stream, count(event_id) as frames from (values ('click'), ('purchase'), ('signup'), ('view'), ('absent')) s(stream) left join events on event_type = s.stream group by all")
def frames_per_stream(spark, sf_dir):
    return frames.per_stream(events(spark, sf_dir), [*FANS, "absent"])


_INTERVALS = "gaps as (select stream, t - lag(t) over (partition by stream order by t, id) as since from e), intervals as (select stream, list_sort(list(since) filter (since is not null))[(count(since) // 2) + 1] as interval from gaps group by all)"


@query(f"with {_EVENTS}, {_INTERVALS} select stream, coalesce(interval, 1000000) as interval from intervals")
def upper_median_interval(spark, sf_dir):
    return frames.intervals(events(spark, sf_dir))


@query(_nearest_sql("later") + f", {_INTERVALS}\nselect screen_id, met.stream, round(gap / 1000.0) / 1000.0 as delta_s, coalesce(round(gap / 1000.0) / 1000.0 > interval / 1000000.0 * 1.5, false) as skewed from met, intervals i where i.stream = '{SCREEN}'")
def skew_flags(spark, sf_dir):
    e = events(spark, sf_dir)
    found = frames.groups(screen(e), e.where(F.col("stream") != SCREEN), FANS)
    return frames.skewed(found, frames.intervals(screen(e))).select("screen_id", "stream", "delta_s", "skewed")


_START, _END = "2024-01-10 06:30:00", "2024-01-12 18:45:10"


@query(f"select event_id, ts, event_type, value from events where event_type in ('click', 'view') and ts >= timestamp '{_START}' and ts <= timestamp '{_END}'")
def time_window_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return records.in_range(e, "ts", _START, _END).select("event_id", "ts", "event_type", "value")


@query("""
with r as (select event_type, date_trunc('second', min(ts)) as s, date_trunc('second', max(ts)) as e from events group by all),
d as (select *, unnest(generate_series(s::date::timestamp, e::date::timestamp, interval 1 day)) as day from r),
b as (select *, greatest(s, day) as lo, least(e, day + interval 1 day) as hi from d),
w as (select *, unnest(generate_series(lo, hi, interval 5 minutes)) as window_start from b)
select event_type, strftime(day, '%Y-%m-%d') as day, window_start, least(window_start + interval 5 minutes, hi) as window_end, least(window_start + interval 5 minutes, hi) = e as last
from w where window_start < hi or (window_start = e and lo = hi)""")
def window_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    second = lambda c: F.date_trunc("second", c).cast("timestamp_ntz")
    spans = e.groupBy("event_type").agg(second(F.min("ts")).alias("start"), second(F.max("ts")).alias("end"))
    return ranges.windows(spans).select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), "window_start", "window_end", "last")


@query("""
with m as (select 0 as arrival, event_id, 'f' || (event_id % 700) as path, ts from events union all select 1, event_id, 'f' || (event_id % 900), ts from events)
select path, event_id, arrival, ts from m qualify row_number() over (partition by path order by arrival, event_id) = 1""")
def manifest_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    part = lambda k, n: e.select(F.lit(k).alias("arrival"), "event_id", F.concat(F.lit("f"), (F.col("event_id") % n).cast("string")).alias("path"), "ts")
    both = part(0, 700).unionByName(part(1, 900))
    # the first by arrival, as an aggregate: a much-repeated path isn't gathered in one task
    return both.groupBy("path").agg(F.min_by(F.struct("event_id", "arrival", "ts"), F.struct("arrival", "event_id")).alias("f")).select("path", "f.*")


_DETECTIONS = "select o_orderkey as frame, l_returnflag as class_name, l_discount * 10 as confidence from orders join lineitem on l_orderkey = o_orderkey"


def _detections(spark, sf_dir) -> DataFrame:
    """frame, detections: an order's lines as detections, of class returnflag and confidence ten times the discount."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("class_name"), (F.col("l_discount") * 10).alias("confidence"))).alias("detections"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame")).join(line, F.col("frame") == F.col("l_orderkey"), "left").select("frame", "detections")


@query(f"with d as ({_DETECTIONS}) select o_orderkey as frame, count(d.frame) filter (class_name = 'A') as n from orders left join d on d.frame = o_orderkey group by all")
def class_counts(spark, sf_dir):
    return _detections(spark, sf_dir).select("frame", detect.counted(F.col("detections"), "A").cast("long").alias("n"))


@query(f"with d as ({_DETECTIONS}) select frame, class_name, count(*) as n, round(min(confidence), 4) as least from d where confidence >= 0.6 and class_name in ('A', 'R') group by all")
def confidence_filter(spark, sf_dir):
    d = _detections(spark, sf_dir).select("frame", F.explode(detect.confident(F.col("detections"), 0.6, ["A", "R"])).alias("d"))
    return d.groupBy("frame", F.col("d.class_name").alias("class_name")).agg(F.count("*").alias("n"), r6(F.min("d.confidence"), "least", 4))


@query("""
select greatest(min(ts) - interval 5 minutes, timestamp '2024-01-01 00:00:00') as low, least(max(ts) + interval 5 minutes, timestamp '2024-01-31 00:00:00') as high
from events where event_type = 'signup'""")
def marker_envelope(spark, sf_dir):
    return ranges.envelope(table(spark, sf_dir, "events").where("event_type = 'signup'"), "ts", "2024-01-01 00:00:00", "2024-01-31 00:00:00")


@query("""
with x as (select event_id as ordinal, ts, cast(json_extract_string(props, '$.k') as bigint) as k, value from events)
select case when k % 3 = 0 then 'reading-' || ordinal else 'm' || k end as marker_id, round(value / 10, 6) as latitude, cast(k as double) as longitude,
       cast(null as double) as depth, false as is_synthetic, case when k % 2 = 0 then cast(1700000000000 + k as bigint) else epoch_us(ts) // 1000 end as ts from x where k % 5 <> 0""")
def json_extract_fallback(spark, sf_dir):
    e = events(spark, sf_dir)
    text = lambda x: x.cast("string")
    k = F.col("n")
    # some documents wrap their readings, some lack a numeric latitude, an id or a time
    latitude = F.when(k % 5 == 0, F.lit('"x"')).otherwise(text(F.round(F.col("value") / 10, 6)))
    body = F.concat(F.lit('{"latitude":'), latitude, F.lit(',"longitude":'), text(k), F.lit(',"marker_id":"'), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("m"), text(k))), F.lit('"'), F.when(k % 2 == 0, F.concat(F.lit(',"ts":'), text(k + 1700000000000))).otherwise(""), F.lit("}"))
    data = F.when(k % 7 < 3, F.concat(F.lit('{"readings":'), body, F.lit("}"))).otherwise(body)
    return records.markers(e.select(F.col("id").alias("ordinal"), data.alias("data"), F.col("ts").alias("received")))


@query("select o_orderkey, substr(sha256(concat_ws('|', cast(o_orderkey as varchar), o_orderpriority, o_orderstatus)), 1, 12) as hash_key from orders")
def hash_key(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.cache_key(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderstatus")).alias("hash_key"))


@query("select event_id, translate(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z', ':. /', '--_-') as safe_ts from events")
def sanitize_ts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.safe_time(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).alias("safe_ts"))


@query("""
select page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '[.][^.]*$', '') as stem, regexp_replace(url, '^.*/', '') as base, substr(regexp_replace(url, '^.*/', ''), 1, 12) as suffix,
       translate(url, '/\\: ', '____') as name,
       case when regexp_extract(lower(url), '[.]([^./]+)$', 1) in ('jpg', 'jpeg') then 'image/jpeg' when regexp_extract(lower(url), '[.]([^./]+)$', 1) = 'png' then 'image/png' else 'application/octet-stream' end as mime,
       regexp_replace(url, '[.][^./]*$', '') || '.png' as picture from pages""")
def path_scalars(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", scalars.stem_of(u).alias("stem"), scalars.base_of(u).alias("base"), scalars.id_suffix(u).alias("suffix"), scalars.safe_name(u).alias("name"), scalars.mime_of(u).alias("mime"), scalars.with_extension(u, ".png").alias("picture"))


_LOW, _HIGH = 0.0, 360.0


@query(f"select event_type as stream, cast(least(floor((value - {_LOW}) * 72 / ({_HIGH} - {_LOW})), 71) as int) as bin, count(*) as n from events where value between {_LOW} and {_HIGH} group by all")
def hist_fixed_bins(spark, sf_dir):
    return metrics.histogram(events(spark, sf_dir), ["stream"], F.col("value"), _LOW, _HIGH)


@query("""
with h as (select l_returnflag as flag, cast(floor(l_extendedprice / 512) as int) as bin, count(*) as n from lineitem where l_extendedprice < 131072 group by all)
select flag, b.bin, coalesce(n, 0) as n from (select distinct l_returnflag as flag from lineitem) f cross join (select cast(unnest(range(256)) as int) as bin) b left join h using (flag, bin)""")
def level_hist(spark, sf_dir):
    return metrics.level_histogram(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice"), ["flag"], F.floor(F.col("l_extendedprice") / 512))


_DENSE = f"""h as (select event_type as stream, cast(least(floor((value - {_LOW}) * 72 / ({_HIGH} - {_LOW})), 71) as int) as bin, count(*) as n from events where value between {_LOW} and {_HIGH} group by all),
dense as (select s.stream, b.bin, coalesce(n, 0) as n from (select distinct stream from h) s cross join (select cast(unnest(range(72)) as int) as bin) b left join h using (stream, bin))"""


def _hists(spark, sf_dir) -> DataFrame:
    return metrics.dense(hist_fixed_bins(spark, sf_dir), ["stream"])


@query(f"""with {_DENSE}, p as (
  select f.stream, f.bin, f.n as na, s.n as nb from dense f join dense s on s.stream = '{SCREEN}' and s.bin = f.bin where f.stream <> '{SCREEN}'
), g as (
  select stream, abs(sum(na) over w / sum(na) over (partition by stream) - sum(nb) over w / sum(nb) over (partition by stream)) as gap from p window w as (partition by stream order by bin)
) select stream, round(sum(gap) * 5.0, 6) as emd from g group by all""")
def emd_between_streams(spark, sf_dir):
    h = _hists(spark, sf_dir)
    target = h.where(F.col("stream") == SCREEN).select("bin", "n").crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in FANS], "stream string")))
    return metrics.emd(h.where(F.col("stream") != SCREEN), target, ["stream"], (_HIGH - _LOW) / metrics.BINS).select("stream", r6("emd", "emd"))


@query(f"with {_DENSE} select stream, round(sum((bin + 0.5) * 5.0 * n) / sum(n), 6) as mean from dense group by all")
def hist_mean(spark, sf_dir):
    return metrics.weighted_mean(_hists(spark, sf_dir), ["stream"], _LOW, 5.0).select("stream", r6("mean", "mean"))


def _levels(e: DataFrame, stream: str) -> DataFrame:
    level = e.where(F.col("stream") == stream).select(F.lit(1).alias("one"), F.least(F.floor("value"), F.lit(255)).alias("level"))
    return metrics.level_histogram(level, ["one"], F.col("level")).select("bin", "n")


@query("""
with l as (select event_type as stream, cast(least(floor(value), 255) as int) as bin, count(*) as n from events where event_type in ('error', 'view') group by all),
b as (select cast(unnest(range(256)) as int) as bin), s as (select cast(unnest(range(-12, 13)) as int) as shift),
p as (select shift, b.bin, coalesce(x.n, 0) as na, coalesce(y.n, 0) as nb from s cross join b left join l x on x.stream = 'error' and x.bin = b.bin left join l y on y.stream = 'view' and y.bin + shift = b.bin),
g as (select shift, abs(sum(na) over w / sum(na) over (partition by shift) - sum(nb) over w / sum(nb) over (partition by shift)) as gap from p window w as (partition by shift order by bin)),
m as (select shift, abs(ln(sum(nb) / sum(na))) as log_ratio from p where bin > 0 group by all)
select shift, round(sum(gap), 6) as emd, round(any_value(log_ratio), 6) as log_ratio from g join m using (shift) group by shift""")
def shift_sweep(spark, sf_dir):
    e = events(spark, sf_dir)
    out = metrics.shift_sweep(_levels(e, SCREEN), _levels(e, "view"), list(range(-12, 13)))
    return out.select("shift", r6("emd", "emd"), r6("log_ratio", "log_ratio"))


_PIXELS = "px as (select l_returnflag as frame, l_partkey % 64 as x, l_suppkey % 64 as y, l_discount * 10 as u from lineitem)"


def _pixels(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("frame"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y"), (F.col("l_discount") * 10).alias("u"))


@query(f"""with {_PIXELS}, q as (select *, (y - 31.5) * (y - 31.5) + (x - 31.5) * (x - 31.5) as d2 from px)
select frame, count(*) filter (d2 <= {(32 * 0.97) ** 2!r}) as disk_px, count(*) filter (d2 <= {(32 * 0.97) ** 2!r} and u between 0.15 and 0.75) as gate_px,
       round(count(*) filter (d2 <= {(32 * 0.97) ** 2!r} and u between 0.15 and 0.75) / count(*) filter (d2 <= {(32 * 0.97) ** 2!r}), 6) as coverage, round(max(case when u > 0 then sqrt(d2) / 32 end), 6) as fill
from q group by all""")
def coverage_fill(spark, sf_dir):
    out = metrics.coverage(_pixels(spark, sf_dir), ["frame"], 64, 0.15, 0.75)
    return out.select("frame", "disk_px", "gate_px", r6("coverage", "coverage"), r6("fill", "fill"))


@query("""
select l_returnflag as side, (case when l_discount >= 0.025 then 1 else 0 end) + (case when l_discount >= 0.055 then 1 else 0 end) + (case when l_discount >= 0.085 then 1 else 0 end) as band, count(l_extendedprice) as n,
       round(quantile_cont(l_extendedprice, 0.25), 4) as p25, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.75), 4) as p75, round(quantile_cont(l_extendedprice, 0.9), 4) as p90
from lineitem group by all""")
def median_p90_by_band(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("side"), metrics.band_of(F.col("l_discount"), [0.025, 0.055, 0.085]).alias("band"), "l_extendedprice")
    return metrics.band_quantiles(line, ["side", "band"], "l_extendedprice").select("side", "band", "n", *(r6(k, k, 4) for k in ("p25", "p50", "p75", "p90")))


@query(f"""
with x as (select l_orderkey, l_linenumber, (-l_extendedprice / 12) * {scalars.DB_PER_COUNT!r} + 2.5 as db from lineitem)
select l_orderkey, l_linenumber, round(db, 6) as db, round(least((db + 100) / 36, 1), 6) as u, round(least((db + 100) / 36, 1) * 36 - 100, 6) as shown_db from x where (db + 100) / 36 > 0""")
def amp_to_norm(spark, sf_dir):
    db = scalars.db_of_count(-F.col("l_extendedprice") / 12, 2.5)
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", db.alias("db")).withColumn("u", scalars.unit_of_db(F.col("db"))).where("u > 0")
    return out.select("l_orderkey", "l_linenumber", r6("db", "db"), r6("u", "u"), r6(scalars.db_of_unit(F.col("u")), "shown_db"))


@query("""
select l_partkey, l_linenumber, cast(l_quantity as int) as s, l_extendedprice as v from lineitem
qualify l_extendedprice >= max(l_extendedprice) over (partition by l_partkey, l_linenumber order by cast(l_quantity as int) range between 2 preceding and 2 following)""")
def radial_peak(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", F.col("l_quantity").cast("int").alias("s"), F.col("l_extendedprice").alias("v"))
    return metrics.radial_peaks(cells, ["l_partkey", "l_linenumber"], 2)


@query("""
with x as (select l_orderkey, l_linenumber, (l_quantity + 1) * 0.25 * 0.9 as r, radians(l_linenumber * 20 - 80) as a from lineitem)
select l_orderkey, l_linenumber, round(r * sin(a), 5) as lateral, round(r * cos(a), 5) as forward, round((r * sin(a) + 12) / 24 * 512, 5) as px, round((12 - r * cos(a)) / 24 * 512, 5) as py from x""")
def polar_to_cartesian(spark, sf_dir):
    r = geometry.ground_range(F.col("l_quantity"), F.lit(0.25), F.lit(0.9))
    y, x = geometry.lateral_forward(r, F.col("l_linenumber") * 20 - 80)
    window = F.struct(F.lit(-12.0).alias("min_h"), F.lit(24.0).alias("span_h"), F.lit(12.0).alias("max_v"), F.lit(24.0).alias("span_v"))
    px, py = geometry.to_pixel(y, x, window, F.lit(512))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(y, "lateral", 5), r6(x, "forward", 5), r6(px, "px", 5), r6(py, "py", 5))


@query("""
with b as (select p_partkey, list_transform(range(p_size % 9 + 1), lambda i: -30.0 + i * (2 + p_size % 5)) as az, p_retailprice / 100 as reach from part),
e as (select *, case when len(az) = 1 then [az[1] - 1, az[1] + 1] else list_concat(list_concat([az[1] - (az[2] - az[1]) / 2], list_transform(range(1, len(az)), lambda i: az[i] + (az[i + 1] - az[i]) / 2)), [az[len(az)] + (az[len(az)] - az[len(az) - 1]) / 2]) end as edges from b),
p as (select p_partkey, len(edges) as n, list_transform(edges, lambda a: reach * sin(radians(a))) as ys, list_transform(edges, lambda a: reach * cos(radians(a))) as xs from e)
select p_partkey, n, round(least(0, list_min(ys)), 5) as min_h, round(greatest(0, list_max(ys)) - least(0, list_min(ys)), 5) as span_h, round(greatest(0, list_max(xs)), 5) as max_v, round(greatest(0, list_max(xs)) - least(0, list_min(xs)), 5) as span_v from p""")
def fan_extent(spark, sf_dir):
    az = F.transform(F.sequence(F.lit(0), F.col("p_size") % 9), lambda i: F.lit(-30.0) + i * (2 + F.col("p_size") % 5))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", geometry.az_edges(az).alias("edges"))
    w = part.select("p_partkey", F.size("edges").cast("long").alias("n"), geometry.extent(F.col("edges"), F.col("p_retailprice") / 100).alias("w"))
    return w.select("p_partkey", "n", *(r6(F.col(f"w.{k}"), k, 5) for k in ("min_h", "span_h", "max_v", "span_v")))


@query(f"""
with x as (select *, s_acctbal / 100000 as dlon, (s_suppkey % 360) as heading from supplier),
o as (select s_suppkey, heading, dlon * 111320.0 * cos(radians((44.0 + 44.001) / 2)) as east, (44.001 - 44.0)::double * 111320.0 as north from x)
select s_suppkey, round(east, 4) as east, round(north, 4) as north, round(east * cos(radians(heading)) - north * sin(radians(heading)), 4) as lateral, round(east * sin(radians(heading)) + north * cos(radians(heading)), 4) as forward from o""")
def pose_offsets(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("heading", F.col("s_suppkey") % 360)
    east, north = geometry.offset_meters(F.lit(44.0), F.lit(0.0), F.lit(44.001), F.col("s_acctbal") / 100000)
    y, x = geometry.from_world(east, north, F.col("heading"))
    return s.select("s_suppkey", r6(east, "east", 4), r6(north, "north", 4), r6(y, "lateral", 4), r6(x, "forward", 4))


@query("""
with c as (select cast(unnest(range(256)) as int) as idx), k as (select idx, cast(idx as double) / 255 - 0.5 as r, 0.5 - cast(idx as double) / 255 as g, cast(idx % 16 as double) / 16 - 0.5 as b from c),
p as (select vec_id, cast(embedding[1] as double) as r, cast(embedding[2] as double) as g, cast(embedding[3] as double) as b from embeddings)
select vec_id, idx, round(d2, 6) as d2 from (
  select vec_id, k.idx, (p.r - k.r) * (p.r - k.r) + (p.g - k.g) * (p.g - k.g) + (p.b - k.b) * (p.b - k.b) as d2 from p cross join k
) qualify row_number() over (partition by vec_id order by d2, idx) = 1""")
def nearest_color(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(k) for i, k in enumerate("rgb")))
    i = F.col("idx").cast("double")
    curve = spark.range(256).select(F.col("id").cast("int").alias("idx")).select("idx", (i / 255 - 0.5).alias("r"), (F.lit(0.5) - i / 255).alias("g"), ((F.col("idx") % 16).cast("double") / 16 - 0.5).alias("b"))
    return palette.nearest_color(p, curve, ["r", "g", "b"]).select("vec_id", "idx", r6("d2", "d2"))


@query(f"""with {_PIXELS}, t as (select frame, cast(floor((atan2(x - 31.5, -(y - 31.5)) + pi()) / (2 * pi()) * 256) % 256 as int) as bin, u from px)
select frame, bin, round(sum(u), 4) as mass from t group by all""")
def angular_profile(spark, sf_dir):
    return metrics.angular_profile(_pixels(spark, sf_dir), ["frame"], 31.5, 31.5).select("frame", "bin", r6("mass", "mass", 4))


@query("""
with x as (select l_suppkey, avg(l_extendedprice) as heading, avg(l_quantity) as offset_deg, max(l_discount) + avg(l_tax) as peak from lineitem group by all),
m as (select quantile_cont(round(peak, 9), 0.5) as m, quantile_cont(offset_deg, 0.5) as med, stddev_pop(offset_deg) as sd from x),
g as (select count(*) as n, corr(heading, offset_deg) as c from x, m where round(peak, 9) >= m.m)
select n, round(med, 6) as median_offset, round(sd, 6) as offset_std, round(case when n > 2 then c end, 6) as corr from g, m""")
def offset_correlation(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("heading"), F.avg("l_quantity").alias("offset_deg"), F.round(F.max("l_discount") + F.avg("l_tax"), 9).alias("peak"))
    return metrics.correlated(x, "heading", "offset_deg", "peak").select("n", *(r6(k, k) for k in ("median_offset", "offset_std", "corr")))


@query("""
with g as (select event_type, cast(json_extract_string(props, '$.k') as bigint) % 8 as k, avg(value) / 50 as cov, stddev_pop(value) as emd from events group by all),
r as (select 'stream' || event_type || '_k' || k as name, round_even(cov, 2) as coverage, round(emd, 4) as emd from g)
select name, coverage, emd, row_number() over (order by abs(ln(coverage)), emd, name) as place from r""")
def sweep_rank(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("k", F.col("n") % 8)
    grid = sweep.grid(spark, {"stream": [SCREEN, *FANS], "k": list(range(8))})
    found = e.groupBy("stream", "k").agg((F.avg("value") / 50).alias("coverage"), F.round(F.stddev_pop("value"), 4).alias("emd"))
    runs = grid.join(found, ["stream", "k"]).select("name", "coverage", "emd")
    # some tens of settings, whatever the input: their order is a small global one
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.abs(F.log("coverage")), "emd", "name"))
    return sweep.ranked(runs).withColumn("place", place.cast("long"))


_EMA = """
with recursive o as (select event_type as stream, event_id as id, value as x, row_number() over (partition by event_type order by ts, event_id) as k from events),
f as (select stream, id, k, x as y from o where k = 1 union all select o.stream, o.id, o.k, 0.25 * o.x + 0.75 * f.y from f join o on o.stream = f.stream and o.k = f.k + 1)
select stream, id, round(y, 6) as y from f"""


@query(_EMA)
def ema_fold(spark, sf_dir):
    e = events(spark, sf_dir).select("stream", "t", "id", F.col("value").alias("x"))
    return folds.smoothed(e, scalars.BLEND["medium"]).select("stream", "id", r6("y", "y"))


def _signals(spark, sf_dir) -> DataFrame:
    """Pictures of pings made of events: an hour of a stream is a ping of up to 16 beams and 32 samples."""
    e = events(spark, sf_dir).withColumn("t", F.floor(F.col("t") / F.lit(asof.HOUR)) * F.lit(asof.HOUR))
    key = F.concat((F.col("id") % 16).cast("string"), F.lit("_"), (F.col("n") % 32).cast("string"))
    cell = e.groupBy("stream", "t", key.alias("key")).agg(F.max((F.col("value") * 10 - 8500)).cast("float").alias("amp"))
    pings = cell.groupBy("stream", "t").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "amp")))).alias("cells"))
    hour = F.floor(F.col("t") / F.lit(asof.HOUR))
    pings = pings.select(
        "stream", "t", hour.alias("ping"), (F.lit(44.0) + hour % 7 * 1e-5).alias("latitude"), F.lit(-63.0).alias("longitude"), (hour % 36 * 10).cast("double").alias("heading"),
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.lit(-45.0) + i * 6.0).alias("beams"), F.lit(32).alias("samples"), F.lit(0.5).alias("per_sample"), F.lit(0.9).alias("cos_tilt"), "cells",
    )
    return raster.rendered(pings, 48, raster.Style(kernel="bilinear", threshold=0.02), ["stream", "t", "ping", "latitude", "longitude", "heading"])


@query()
def raster_signal(spark, sf_dir):
    return _signals(spark, sf_dir).select("stream", "t", F.sha2("signal", 256).alias("digest"))


@query()
def ping_filter(spark, sf_dir):
    return fold.filtered(_signals(spark, sf_dir), "medium", -96.0).select("stream", "t", F.sha2("signal", 256).alias("digest"))


@query()
def component_matching(spark, sf_dir):
    """Each hour's picture of the screen against the nearest one of each fan, within a day: how their masks match."""
    s = kept(_signals(spark, sf_dir).select("stream", "t", "signal"), "signals")
    ids = s.select("stream", "t", F.col("t").alias("id"))
    # times are aligned first; pictures are fetched by (stream, t) afterwards
    met = asof.nearest(ids.where(F.col("stream") == SCREEN), ids.where(F.col("stream") != SCREEN), FANS, "earlier", asof.HOUR, 24 * asof.HOUR).where("found is not null")
    met = met.select(F.concat_ws("-", F.col("driver.t").cast("string"), "stream").alias("pair"), F.array(F.struct(F.lit("target").alias("side"), F.lit(SCREEN).alias("stream"), F.col("driver.t").alias("t")), F.struct(F.lit("render").alias("side"), F.col("stream").alias("stream"), F.col("found.t").alias("t"))).alias("of"))
    wanted = met.select("pair", F.explode("of").alias("of")).select("pair", "of.*").join(s, ["stream", "t"])
    pixels = kept(regions.pixel_rows(wanted, ["pair", "side"], "signal", F.lit(48)).select("pair", "side", "y", "x", (F.col("c0") / 255).alias("u")), "pixels")
    mask = kept(masks.matched(regions.labelled(masks.masked(pixels, 0.1, 0.9, 48, 48), masks.BY), 2), "mask")
    parts = kept(masks.components(mask, [0.3, 0.5, 0.7]), "components")
    big, kept_parts = masks.large(mask, parts, 4)
    feet = kept(masks.footprints(big, 2), "footprints")
    shares = mask.groupBy("pair").agg(*(F.count_if((F.col("side") == k) & m).alias(f"{k}_{n}") for k in ("target", "render") for n, m in (("px", F.lit(True)), ("matched", F.col("matched")))))
    joined = masks.clusters(feet).groupBy("pair").agg(F.count("*").alias("clusters"), F.sum("renders").alias("renders"), F.sum("targets").alias("targets"))
    seen = masks.deltas(kept_parts, feet, [0.3, 0.5, 0.7]).groupBy("pair").agg(F.count("*").alias("components"), F.round(F.avg("delta_db"), 6).alias("delta_db"))
    return shares.join(joined, "pair", "left").join(seen, "pair", "left")


@query("""
with c as (select distinct l_orderkey as frame, l_linenumber as y, cast(l_quantity as int) as x from lineitem),
n as (select *, case when x - lag(x) over (partition by frame, y order by x) = 1 then 0 else 1 end as new from c)
select frame, y, x, max(case when new = 1 then x end) over (partition by frame, y order by x) as run from n""")
def pixel_runs(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("y"), F.col("l_quantity").cast("int").alias("x")).distinct()
    return regions.runs(c, ["frame"])


@query("""
select event_type as stream, time_bucket(interval 1 hour, ts) as start, count(*) as n, round(avg(value), 6) as mean from events group by all""")
def tumbling_means(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stream"), "ts", F.col("value").alias("x"))
    return folds.tumbling(e, "ts", "1 hour", "1 hour", ["stream"]).select("stream", "start", "n", r6("mean", "mean"))


_CLOSED = 1 << 52  # a time in the next century: a row of it moves the watermark past all others


def _run_fold(spark, rows: DataFrame, late: str) -> DataFrame:
    """The fold over a stream until all that is there has been read; its result is a table."""
    import uuid

    spark.conf.set(*folds.STATE_STORE)
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    job = folds.smoothed_stream(rows, scalars.BLEND["medium"], late).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("stream", "id", r6("y", "y"))


def _closing(spark) -> DataFrame:
    """A stream of one row without x, at the time that closes a stream."""
    import uuid

    schema = "stream string, t long, id long, x double"
    path = f"{shared_folder(spark)}/closing-{uuid.uuid4().hex}"
    spark.createDataFrame([(None, _CLOSED, None, None)], schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


@query(_EMA)
def stream_fold(spark, sf_dir):
    """The fold as a stream over the table's files; rows are held until the closing row's watermark."""
    rows = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream's path isn't a file
    rows = rows.select(F.col("event_type").alias("stream"), scalars.micros(F.col("ts")).alias("t"), F.col("event_id").alias("id"), F.col("value").alias("x"))
    return _run_fold(spark, rows.unionByName(_closing(spark)), "10 minutes")


_WEEK = "cast(floor((epoch_us(ts) / 3600000000.0 + event_id % 7) / 168) as bigint)"


@query(f"""
with recursive a as (select event_type as stream, event_id as id, value as x, ts, epoch_us(ts) as t, {_WEEK} as week from events),
seen as (select week, max(t) as top, row_number() over (order by week) as batch from a group by week),
passed as (select week, (select max(top) // 1000 * 1000 - 10800000000 from seen s where s.batch < w.batch - 1) as mark from seen w),
o as (select stream, id, x, row_number() over (partition by stream order by t, id) as k from a join passed using (week) where mark is null or t > mark),
f as (select stream, id, k, x as y from o where k = 1 union all select o.stream, o.id, o.k, 0.25 * o.x + 0.75 * f.y from f join o on o.stream = f.stream and o.k = f.k + 1)
select stream, id, round(y, 6) as y from f""")
def late_fold(spark, sf_dir):
    """Rows come up to six hours late, a week's in one micro-batch. They are folded in their order, but for those that are over
    three hours behind the latest row of the batches but the last: their slots may have been given out."""
    import uuid

    e = events(spark, sf_dir).select("stream", "t", "id", F.col("value").alias("x"))
    e = kept(e.withColumn("week", F.floor((F.col("t") / 3_600_000_000 + F.col("id") % 7) / 168).cast("long")), "arrivals")
    path = f"{shared_folder(spark)}/weeks-{uuid.uuid4().hex}"
    for r in sorted(r["week"] for r in e.select("week").distinct().collect()):  # the order of files is the order of their writing
        e.where(F.col("week") == r).drop("week").coalesce(1).write.mode("append").parquet(path)
    e.limit(1).select(F.lit(None).cast("string").alias("stream"), F.lit(_CLOSED).alias("t"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("x")).coalesce(1).write.mode("append").parquet(path)
    rows = spark.readStream.schema(e.drop("week").schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _run_fold(spark, rows, "3 hours")


@query(_nearest_sql("earlier") + "\nselect screen_id, stream, case when gap <= 600000000 then found_id end as found_id, case when gap <= 600000000 then round(gap / 1000.0) / 1000.0 end as delta_s from met")
def nearest_stream(spark, sf_dir):
    """Screens against fans as two streams over the table's files, until closing rows of both have moved the watermark past all."""
    import uuid

    spark.conf.set(*folds.STATE_STORE)
    rows = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")
    rows = rows.select(F.col("event_type").alias("stream"), scalars.micros(F.col("ts")).alias("t"), F.col("event_id").alias("id"))
    last = _closing(spark).select(F.lit(FANS[0]).alias("stream"), "t", "id")
    met = nearest.nearest_stream(rows.where(F.col("stream") == SCREEN).unionByName(last), rows.where(F.col("stream") != SCREEN).unionByName(last), FANS, 600_000_000, "earlier")
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    job = met.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    found = spark.read.parquet(f"{out}/rows")
    return found.select(F.col("id").alias("screen_id"), "stream", "found_id", scalars.seconds3(F.abs(F.col("t") - F.col("found_t"))).alias("delta_s"))


def _colored(spark, sf_dir) -> DataFrame:
    """Pixels made of lineitem: a supplier is a picture."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_suppkey").alias("picture"), F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x"), (F.col("l_quantity") * 5).cast("int").alias("r"), F.floor(F.round(F.col("l_discount") * 100) * 25).cast("int").alias("g"), (F.col("l_linenumber") * 36).alias("b"))


@query("""
with p as (select l_suppkey as picture, l_orderkey as y, l_linenumber as x, cast(l_quantity * 5 as int) as r, cast(floor(round(l_discount * 100) * 25) as int) as g, l_linenumber * 36 as b from lineitem),
c as (select picture, avg(r) as cr, avg(g) as cg, avg(b) as cb from p where picture % 7 <> 0 group by all),
d as (select p.*, coalesce((r - cr) * (r - cr) + (g - cg) * (g - cg) + (b - cb) * (b - cb) <= 6400, false) as near from p left join c using (picture))
select picture, y, x, case when near then 0 else r end as r, case when near then 0 else g end as g, case when near then 0 else b end as b from d""")
def background_strip(spark, sf_dir):
    """Pictures without the colours around given ones: the mean of all pixels, for six pictures of seven."""
    pixels = _colored(spark, sf_dir)
    given = pixels.where("picture % 7 <> 0").groupBy("picture").agg(*(F.avg(c).alias(c) for c in colors.RGB))
    return colors.stripped(pixels, given, "picture", 80.0)


@query()
def background_colors(spark, sf_dir):
    """The background colour of each picture by k-means over its colours."""
    found = colors.backgrounds(colors.color_counts(_colored(spark, sf_dir), "picture"), "picture")
    return found.select("picture", *(r6(c, c, 4) for c in colors.RGB))


_FAN, _RING = "[-31.0, -20.5, -9.75, 0.25, 10.5, 21.0, 30.5]", "[-154.0, -102.5, -51.25, 0.5, 51.75, 103.0, 154.5]"
_CELLS = "select l_suppkey as frame, l_suppkey % 2 as g, l_linenumber - 1 as beam, cast(l_quantity as int) - 1 as sample, max(l_extendedprice / 110000) as v from lineitem group by all"


@query(f"""
with c as ({_CELLS}),
geo as (select * from (values (0, {_FAN}, -13.37, 26.71, 12.93, 13.01), (1, {_RING}, -12.93, 25.77, 12.81, 25.79)) t(g, az, min_h, span_h, max_v, span_v)),
p as (select g, az, py, px, min_h + px / 24.0 * span_h as y, max_v - py / 24.0 * span_v as x from geo, range(24) a(py), range(24) b(px)),
q as (select *, sqrt(x * x + y * y) / 0.25 - 1 as place, degrees(atan2(y, x)) as a0 from p),
w as (select *, az[1] + (a0 - az[1]) - 360 * floor((a0 - az[1]) / 360) as a from q),
s as (select *, a > az[7] as seam, len(list_filter(az, lambda v: v < a)) as j, cast(floor(place) as int) as s0 from w where place >= 0 and place <= 49 and (a <= az[7] or az[7] - az[1] > 300)),
b as (select *, case when seam then 6 else greatest(j - 1, 0) end as b0, case when seam then 0 else least(j, 6) end as b1, place - s0 as fs, least(s0 + 1, 49) as s1 from s),
f as (select *, case when b0 = b1 then 0 else (a - az[b0 + 1]) / (case when seam then az[1] + 360 - az[7] else az[b1 + 1] - az[b0 + 1] end) end as fb from b),
t as (select g, py, px, b0 as beam, s0 as sample, (1 - fb) * (1 - fs) as weight from f union all select g, py, px, b0, s1, (1 - fb) * fs from f
      union all select g, py, px, b1, s0, fb * (1 - fs) from f union all select g, py, px, b1, s1, fb * fs from f)
select frame, cast(py as int) as py, cast(px as int) as px, round(sum(v * weight), 6) as value from c join t using (g, beam, sample) where weight > 0 group by frame, py, px""")
def scan_converted(spark, sf_dir):
    """Cells made of lineitem, a supplier's as a picture of 24 by 24 pixels: even ones by a fan, odd ones by a ring."""
    line = table(spark, sf_dir, "lineitem")
    cells = line.groupBy(F.col("l_suppkey").alias("frame"), (F.col("l_suppkey") % 2).cast("int").alias("g"), (F.col("l_linenumber") - 1).alias("beam"), (F.col("l_quantity").cast("int") - 1).alias("sample")).agg((F.max("l_extendedprice") / 110000).alias("v"))
    fans = [(0, [float(x) for x in _FAN[1:-1].split(",")], 50, 0.25, -13.37, 26.71, 12.93, 13.01), (1, [float(x) for x in _RING[1:-1].split(",")], 50, 0.25, -12.93, 25.77, 12.81, 25.79)]
    geo = spark.createDataFrame(fans, "g int, beams array<double>, samples int, step double, min_h double, span_h double, max_v double, span_v double")
    return conversion.converted(cells, conversion.taps(geo, "g", 24), ["frame"], "g").select("frame", "py", "px", r6("value", "value"))
