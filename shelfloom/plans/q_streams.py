"""Streams drained over the events, sinks read back, and image measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfloom.functions import table_functions
from shelfloom.plans.registry import query
from shelfloom.sources import event_log, sinks, tables
from shelfloom.sources import image_files as image_files_source
from shelfloom.sources.tables import table
from shelfloom.streaming import jobs, keyed, outbox


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("tumbling_window", "SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    """The batch twin of the stream."""
    return jobs.tumbling(_events(spark, d)).withColumn("start", F.unix_seconds("start"))


@query("tumbling_stream", "SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling_stream(spark, d):
    """The stream, drained in complete mode."""
    return jobs.drain(jobs.tumbling(jobs.event_stream(spark, d)), "tumbling", "complete").withColumn("start", F.unix_seconds("start"))


@query("sliding_window", "WITH s AS (SELECT time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY * k AS start FROM events, range(0, 2) r(k)) SELECT epoch(start)::BIGINT AS start, count(*) AS n FROM s GROUP BY ALL")
def sliding_window(spark, d):
    # windows of two days start on even days of the epoch and, slid by a day, on all
    return jobs.sliding(_events(spark, d)).withColumn("start", F.unix_seconds("start"))


@query(
    "session_windows",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM g GROUP BY user_id, s""",
)
def session_windows(spark, d):
    return jobs.sessions(_events(spark, d)).withColumn("start", F.unix_micros("start"))


_LOGGED = "event_id bigint, ts bigint, user_id bigint, event_type string"


def _logged(spark, d):
    return _events(spark, d).select("event_id", "ts", "user_id", "event_type")


@query("replay_then_tail", "SELECT event_id, event_type FROM events WHERE event_id > 500")
def replay_then_tail(spark, d):
    """A log that a reader follows from an id on: it stops after the history, a tail that overlaps it is appended, and it goes on where it was; each event once."""
    log, to = sinks.folder(spark, "events-log"), (sinks.folder(spark, "replay"), sinks.folder(spark, "replay-checkpoint"))
    e, out = _logged(spark, d), None
    for part in (e.filter("event_id < 6000"), e.filter("event_id > 500")):
        event_log.append(part, log)
        stream = jobs.log_stream(spark, log, _LOGGED)
        out = jobs.drain(jobs.replay_then_tail(stream, None, 500), "replay", to=to)
    return out.select("event_id", "event_type")


@query("replay_union", "SELECT event_id, event_type FROM events WHERE event_id > 500")
def replay_union(spark, d):
    """The batch twin: history after an id and a tail that overlaps it."""
    e = _events(spark, d)
    return jobs.replay_then_tail(e.filter("event_id < 6000"), e.filter("event_id > 500"), 500).select("event_id", "event_type")


@query("delta_sync_stream", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def delta_sync_stream(spark, d):
    """The last state of each user, written once by hash from a stream."""
    path = sinks.folder(spark, "delta")
    stream = jobs.event_stream(spark, d)
    q = stream.writeStream.option("checkpointLocation", sinks.folder(spark, "delta-checkpoint")).trigger(availableNow=True).foreachBatch(jobs.delta_sync(path)).start()
    q.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/rows").select("user_id", "event_id", "event_type")


@query(
    "breaker_stream",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type NOT IN ('error', 'signup') AS ok, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    b AS (SELECT user_id, n, 'CLOSED' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS failures, 0::DOUBLE AS opened FROM e WHERE n = 1
      UNION ALL SELECT user_id, n, CASE WHEN mode = 'OPEN' THEN mode WHEN ok THEN 'CLOSED' WHEN mode = 'HALF_OPEN' OR failures + 1 >= 2 THEN 'OPEN' ELSE mode END,
        CASE WHEN mode = 'OPEN' THEN failures WHEN ok THEN 0 ELSE failures + 1 END, CASE WHEN mode <> 'OPEN' AND NOT ok AND (mode = 'HALF_OPEN' OR failures + 1 >= 2) THEN tm ELSE opened END
      FROM (SELECT e.*, b.failures, b.opened, CASE WHEN b.state = 'OPEN' AND e.tm - b.opened >= 86400 THEN 'HALF_OPEN' ELSE b.state END AS mode FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)),
    l AS (SELECT * FROM b QUALIFY n = max(n) OVER (PARTITION BY user_id))
    SELECT user_id, CASE WHEN state = 'OPEN' AND (SELECT max(tm) - 3600 FROM e) >= opened + 86400 THEN 'HALF_OPEN' ELSE state END AS state, failures FROM l""",
)
def breaker_stream(spark, d):
    """Each user's breaker when the stream is drained: kept as stream state, half-opened by timers behind the watermark of an hour."""
    own = keyed.with_timers(spark)
    seen = jobs.drain(keyed.breakers(jobs.event_stream(own, d), "user_id", ~F.col("event_type").isin("error", "signup"), jobs.LATE, 2, 86400.0), "breaker", "update")
    last = F.max_by(F.struct("state", "failures"), "at").alias("x")
    return spark.read.schema(seen.schema).parquet(*seen.inputFiles()).groupBy(F.col("key").alias("user_id")).agg(last).select("user_id", "x.*")


@query(
    "blacklist_stream",
    """WITH e AS (SELECT user_id, event_id, ts, (props->>'$.k')::BIGINT % 5 AS item, event_type = 'error' AS rejects FROM events),
    r AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM e WHERE rejects WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM r),
    l AS (SELECT e.user_id, e.event_id, e.item, e.ts, arg_max(i.island, (i.ts, i.event_id)) AS island, max(i.ts) AS last FROM e LEFT JOIN i ON i.user_id = e.user_id AND (i.ts, i.event_id) < (e.ts, e.event_id) WHERE NOT e.rejects GROUP BY ALL)
    SELECT l.user_id, l.event_id, l.item, coalesce(l.ts - l.last < INTERVAL 12 HOUR AND EXISTS (SELECT 1 FROM i WHERE i.user_id = l.user_id AND i.island = l.island AND i.item = l.item AND (i.ts, i.event_id) < (l.ts, l.event_id)), false) AS blocked FROM l""",
)
def blacklist_stream(spark, d):
    """Whether the item of an event has been rejected in its session, as stream state that ends twelve hours after the last rejection."""
    own = keyed.with_timers(spark)
    item = F.get_json_object("props", "$.k").cast("bigint") % 5
    seen = jobs.drain(keyed.blacklist(jobs.event_stream(own, d), "user_id", item, F.col("event_type") == "error", jobs.LATE, 43200.0), "blacklist")
    return spark.read.schema(seen.schema).parquet(*seen.inputFiles()).select(F.col("key").alias("user_id"), "event_id", "item", "blocked")


_CELL = "event_id bigint, user_id bigint, event_type string, value double"


@query(
    "outbox_stream",
    """SELECT event_id, CASE WHEN user_id > 120 OR user_id < 1 THEN 'SKIPPED_OUT_OF_BOUNDS' WHEN event_id % 13 = 0 THEN 'DEAD' ELSE 'SYNCED' END AS sync_status, CASE WHEN user_id > 120 OR user_id < 1 THEN 0 WHEN event_id % 13 = 0 THEN 3 WHEN event_id % 11 = 0 THEN 2 ELSE 1 END AS attempts
    FROM events WHERE event_type IN ('signup', 'error')""",
)
def outbox_stream(spark, d):
    """Cells sent from a stream in bounded batches to a sink that fails once for some keys and always for others: what becomes of each, and after how many attempts."""
    path, checkpoint = sinks.folder(spark, "outbox"), sinks.folder(spark, "outbox-checkpoint")
    fails = (F.col("event_id") % 13 == 0) | ((F.col("event_id") % 11 == 0) & (F.col("attempts") == 1))
    box = outbox.Outbox(path, "event_id", lambda rows: rows.select("event_id", (~fails).alias("ok")), most=20_000)
    cells = jobs.event_stream(spark, d).filter("event_type in ('signup', 'error')").select("event_id", "user_id", "event_type", "value")
    outbox.run(cells.filter("user_id between 1 and 120"), box, checkpoint)
    told = lambda df, status: df.select("event_id", F.lit(status).alias("sync_status"), "attempts")
    out = _events(spark, d).filter("event_type in ('signup', 'error') and not user_id between 1 and 120").select("event_id", F.lit("SKIPPED_OUT_OF_BOUNDS").alias("sync_status"), F.lit(0).alias("attempts"))
    return told(box.done(spark, _CELL), "SYNCED").union(told(box.dead(spark, _CELL), "DEAD")).union(out)


@query("write_behind_stream", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def write_behind_stream(spark, d):
    """The last value of each cell, sent from a stream that keeps only the newest write to a cell; a cell that fails is sent again alone."""
    path, checkpoint = sinks.folder(spark, "behind"), sinks.folder(spark, "behind-checkpoint")
    fails = (F.col("event_id") % 7 == 0) & (F.col("attempts") == 1)
    box = outbox.Outbox(path, "event_id", lambda rows: rows.select("event_id", (~fails).alias("ok")), most=20_000, newest=("user_id", "event_type"))
    outbox.run(jobs.event_stream(spark, d).select("event_id", "user_id", "event_type", "value"), box, checkpoint)
    return box.done(spark, _CELL).groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("session_blacklist", "SELECT user_id, event_id FROM events e WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE * 48 AND event_type = 'error'")
def session_blacklist(spark, d):
    """Rejections that haven't outlived their time."""
    e = _events(spark, d)
    now = e.agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(now)).filter((F.col("ts") > F.col("now") - F.expr("interval 24 hours")) & (F.col("event_type") == "error")).select("user_id", "event_id")


@query("task_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY user_id")
def task_status(spark, d):
    """The state of a task from its events."""
    return _events(spark, d).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("event_type") == "error").alias("attempts"))


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


_ORDERS = "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


@query("sink_parquet", _ORDERS)
def sink_parquet(spark, d):
    """Written by partition and read back."""
    return sinks.write(_orders(spark, d), sinks.folder(spark, "parquet"), "parquet", ["o_orderstatus"]).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("sink_json", _ORDERS)
def sink_json(spark, d):
    return sinks.write(_orders(spark, d), sinks.folder(spark, "json"), "json")


@query("sink_orc", _ORDERS)
def sink_orc(spark, d):
    return sinks.write(_orders(spark, d), sinks.folder(spark, "orc"), "orc")


@query("sink_csv", """SELECT o_orderkey::VARCHAR AS o_orderkey, 'say "' || o_orderpriority || '"' AS note, printf('%.4f', o_totalprice) AS score FROM orders""")
def sink_csv(spark, d):
    """A report with doubled quotes and four digits."""
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('"')).alias("note"), F.format_string("%.4f", F.col("o_totalprice")).alias("score"))
    return sinks.export_csv(rows, sinks.folder(spark, "csv"))


@query(
    "catalog_export",
    """SELECT p_partkey::VARCHAR AS id, p_name AS name, coalesce(nullif(p_brand, ''), 'none') AS brand, (p_size * 2)::VARCHAR || '%' AS score FROM part""",
)
def catalog_export(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.coalesce(F.nullif("p_brand", F.lit("")), F.lit("none")).alias("brand"), F.concat((F.col("p_size") * 2).cast("string"), F.lit("%")).alias("score"))
    return sinks.export_csv(rows, sinks.folder(spark, "catalog"))


@query("failure_log", "SELECT event_id, event_type FROM events WHERE event_type = 'error' AND (props->>'$.k')::INT > 90")
def failure_log(spark, d):
    """Failures with a message that calls for an alert, appended."""
    rows = table(spark, d, "events").filter((F.col("event_type") == "error") & (F.get_json_object("props", "$.k").cast("int") > 90)).select("event_id", "event_type")
    return sinks.write(rows, sinks.folder(spark, "failures"))


@query("content_addressed_upload", "SELECT md5(p_name) AS object_id, min(p_partkey) AS first_key, count(*) AS n FROM part WHERE md5(p_name) NOT IN (SELECT md5(p_name) FROM part WHERE p_partkey < 20) GROUP BY 1")
def content_addressed_upload(spark, d):
    """What isn't in the store yet, by the digest of its content."""
    p = table(spark, d, "part").withColumn("object_id", F.md5("p_name"))
    there = p.filter("p_partkey < 20").select("object_id").distinct()
    return p.join(there, "object_id", "left_anti").groupBy("object_id").agg(F.min("p_partkey").alias("first_key"), F.count("*").alias("n"))


@query("telemetry_fan_out", "SELECT 'all' AS sink, event_type, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'alerts', event_type, count(*) FROM events WHERE event_type = 'error' GROUP BY event_type")
def telemetry_fan_out(spark, d):
    """One stream to two sinks, a log of all and one of alerts; every batch is read once and written under its number."""
    every, alerts = sinks.folder(spark, "telemetry"), sinks.folder(spark, "alerts")
    batch = jobs.fan_out({"all": jobs.numbered_folder(every), "alerts": jobs.numbered_folder(alerts, lambda df: df.filter("event_type = 'error'"))})
    stream = jobs.event_stream(spark, d)
    q = stream.writeStream.option("checkpointLocation", sinks.folder(spark, "telemetry-checkpoint")).trigger(availableNow=True).foreachBatch(batch).start()
    q.awaitTermination()
    read = lambda path, name: spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path).select(F.lit(name).alias("sink"), "event_type")
    return read(every, "all").union(read(alerts, "alerts")).groupBy("sink", "event_type").agg(F.count("*").alias("n"))


@query("task_routing", "SELECT CASE WHEN event_type = 'error' THEN 'heal' WHEN event_type IN ('purchase', 'signup') THEN 'priority' WHEN event_type = 'click' THEN 'bulk' ELSE 'default' END AS queue, count(*) AS n, count(DISTINCT event_id) AS tasks FROM events GROUP BY 1")
def task_routing(spark, d):
    """Tasks to their queues; the first batch is delivered twice, as after a lost worker, and is there once."""
    path, twice = sinks.folder(spark, "queues"), []
    write = jobs.numbered_folder(path, jobs.route("event_type", {"heal": ["error"], "priority": ["purchase", "signup"], "bulk": ["click"]}, "default"))

    def at_least_once(batch, number):
        write(batch, number)
        if not twice:
            twice.append(number)
            write(batch, number)

    stream = jobs.event_stream(spark, d)
    q = stream.writeStream.option("checkpointLocation", sinks.folder(spark, "queues-checkpoint")).trigger(availableNow=True).foreachBatch(at_least_once).start()
    q.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    return rows.groupBy("queue").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("tasks"))


@query("log_tail", "WITH l AS (SELECT event_id, event_type || ' ' || user_id AS line, row_number() OVER (ORDER BY event_id) AS line_number FROM events) SELECT line_number, line FROM l ORDER BY line_number DESC LIMIT 100")
def log_tail(spark, d):
    """The last hundred lines of a log of several files that were written in order, with their numbers in all of it."""
    path = sinks.folder(spark, "log")
    lines = table(spark, d, "events").select("event_id", F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("value"))
    lines.repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)  # a file for each range, named in their order
    return tables.log_tail(spark, path, 100, across=True).select("line_number", "line")


#: Ending, head, and what becomes of such a file if its size is right: width, height, type by its head, status.
_FILES = (
    ("png", "89504E470D0A1A0A0000000D494844520000025800000190", 600, 400, "image/png", "VERIFICATION_SUCCESS"),
    ("JPG", "FFD8FFE000104A46494600010100000100010000FFC0001108019002580301220002", 600, 400, "image/jpeg", "VERIFICATION_SUCCESS"),
    ("webp", "52494646000000005745425056503858" + "0A000000" + "10000000" + "570200" + "8F0100", 600, 400, "image/webp", "VERIFICATION_SUCCESS"),
    ("webp", "52494646000000005745425056503820" + "0A000000" + "100200" + "9D012A" + "5802" + "9001", 600, 400, "image/webp", "VERIFICATION_SUCCESS"),
    ("webp", "5249464600000000574542505650384C" + "0A000000" + "2F" + "57C26300", 600, 400, "image/webp", "VERIFICATION_SUCCESS"),
    ("gif", "4749463839615E015E01", None, None, None, "UNSUPPORTED_MIME_TYPE_image/gif"),
    ("jpg", "3C21444F43545950452068746D6C3E", None, None, None, "NOT_AN_IMAGE"),
    ("png", "89504E470D0A1A0A0000000D494844520000000000000190", 0, 400, "image/png", "CORRUPT_HEADER"),
    ("jpeg", "FFD8FFE000104A46494600010100000100010000FFD9", None, None, "image/jpeg", "CORRUPT_HEADER"),
)
_VALUES = ", ".join(f"({i}, {w or 'NULL' if w != 0 else 0}, {h or 'NULL'}, {repr(m) if m else 'NULL'}, '{st}')" for i, (_, _, w, h, m, st) in enumerate(_FILES))


@query(
    "sessions_by_table_function",
    """WITH e AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 43200000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT user_id, min(us) AS session_start, max(us) AS session_end, count(*) AS n FROM g GROUP BY user_id, s""",
)
def sessions_by_table_function(spark, d):
    """Sessions of twelve hours by a table function that names its own partitioning and order."""
    table_functions.register(spark)
    events = _events(spark, d).select("user_id", F.unix_micros("ts").alias("at"))
    return spark.sql("SELECT * FROM sessionize(TABLE({events}), 'user_id', 'at', 43200000000)", events=events)


@query(
    "image_files",
    f"""WITH k(i, width, height, mime, status) AS (VALUES {_VALUES}), f AS (SELECT vec_id, 50 + vec_id * 37 % 1000 AS length, k.* FROM embeddings JOIN k ON k.i = vec_id % {len(_FILES)}),
    g AS (SELECT *, status NOT LIKE 'UNSUPPORTED%' AND (length > 900 OR length < 100) AS shut FROM f)
    SELECT vec_id, length::BIGINT AS length, CASE WHEN NOT shut THEN mime END AS mime, CASE WHEN NOT shut THEN width END::INT AS width, CASE WHEN NOT shut THEN height END::INT AS height,
      CASE WHEN shut AND length > 900 THEN 'FILE_SIZE_EXCEEDS_LIMIT_' || length WHEN shut THEN 'FILE_SIZE_BELOW_MINIMUM_' || length ELSE status END AS status FROM g""",
)
def image_files(spark, d):
    """Files of many kinds and sizes, broken ones among them, written and checked by name, size and head."""
    path, n = sinks.folder(spark, "images"), F.col("vec_id")
    kind = F.get(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(h).alias("h")) for e, h, *_ in _FILES]), (n % len(_FILES)).cast("int"))
    length = (50 + n * 37 % 1000).cast("int")
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("img-"), n, F.lit("."), kind["e"]).alias("name"), F.unhex(F.rpad(kind["h"], length * 2, "00")).alias("content"))
    image_files_source.write(rows, path, "name", "content").agg(F.count("*")).first()
    out = image_files_source.scan(spark, path, 100, 900)
    return out.select(F.regexp_extract("path", r"img-(\d+)\.", 1).cast("bigint").alias("vec_id"), "length", "mime", "width", "height", "status")


@query(
    "settings_load",
    """WITH e AS (SELECT r_name AS name, r_regionkey::VARCHAR AS value FROM region), t AS (SELECT r_name AS name, count(*)::VARCHAR AS value FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_regionkey % 2 = 0 GROUP BY r_name),
    l AS (SELECT r_name || ' nations' AS name, string_agg(n_name, '|' ORDER BY n_name) AS value FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name)
    SELECT name, coalesce(t.value, e.value) AS value FROM e LEFT JOIN t USING (name) UNION ALL SELECT * FROM l UNION ALL SELECT r_name || ' even', (r_regionkey % 2 = 0)::VARCHAR FROM region""",
)
def settings_load(spark, d):
    """Settings by layer, with their types: an environment file of the regions, over which goes a table of keys and values of nations; what is unknown or can't be read is left out."""
    env, path = sinks.folder(spark, "env"), sinks.folder(spark, "settings")
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    lines = F.explode(F.array(F.lit("# comment"), F.concat(F.lit(" "), F.col("r_name"), F.lit(" = '"), F.col("r_regionkey"), F.lit("'")), F.concat(F.col("r_name"), F.lit(" broken=x")), F.concat(F.col("r_name"), F.lit(" even="), F.when(F.col("r_regionkey") % 2 == 0, "Yes").otherwise("off"))))
    region.select(lines.alias("value")).write.text(env)
    of = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name", "r_regionkey").agg(F.count("*").cast("string").alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), " , ").alias("names"))
    pairs = F.array(F.struct(F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).otherwise("unknown").alias("key"), F.col("n").alias("value")), F.struct(F.concat("r_name", F.lit(" nations")).alias("key"), F.concat("names", F.lit(",,")).alias("value")))
    of.select(F.explode(pairs).alias("x")).select("x.key", "x.value").write.parquet(path)
    names = [r[0] for r in region.select("r_name").limit(1000).collect()]
    kinds = {n + end: kind for n in names for end, kind in (("", "int"), (" broken", "int"), (" even", "bool"), (" nations", "list"))}
    found = tables.typed_settings(tables.key_values([r.value for r in spark.read.text(env).limit(4000).collect()]) | tables.settings(spark.read.parquet(path)), kinds)
    shown = [(k, "|".join(v) if isinstance(v, list) else str(v).lower()) for k, v in found.items()]
    return spark.createDataFrame(shown, "name string, value string")


@query("queue_scan", "SELECT user_id, count(*) AS n, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY user_id")
def queue_scan(spark, d):
    """A queue of events in a log, read as a stream to its end, without repeats, by owner."""
    log = sinks.folder(spark, "queue-log")
    event_log.append(_logged(spark, d), log)
    stream = jobs.log_stream(spark, log, _LOGGED, splitBytes=1 << 20).filter("event_type = 'error'").select("user_id", "event_id", "ts")
    seen = jobs.drain(stream.withWatermark("ts", jobs.LATE).dropDuplicates(["event_id"]), "queue")
    return seen.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
