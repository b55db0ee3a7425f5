"""Change events, changelog, current state, replay, target table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.functions.connect import connect_key, connect_payload, decimal_to_base64
from tidemark.functions.scalars import changelog_name, day_label, recovery_topic, scn_long, topic_name
from tidemark.operators import replay, state
from tidemark.operators.reconcile import target_counts
from tidemark.operators.routing import include_tables, route
from tidemark.plans import jobs
from tidemark.session import shared_dir
from tidemark.sinks import changelog as log
from tidemark.sinks.positions import save_position
from tidemark.sinks.target import TargetTable
from tidemark.sources.envelopes import (
    changes_after, include_list, read_envelopes, rejected, snapshot_load,
)
from tidemark.streaming import queries as streams
from tidemark.workload import query
from tidemark.workload.inputs import OPS, as_changes, changes, full_changes, ops, table

KEYS = ["ID"]

# What a fold of the change events leaves; the middle placeholder limits the input.
STATE_SQL = """
  WITH ops AS ({ops}), last AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id DESC) AS rn
                   FROM ops {where}) WHERE rn = 1)
  SELECT id, CAST(amt AS DOUBLE) AS amt, st FROM last WHERE op <> 'd'
"""
STATE = STATE_SQL.format(ops=OPS, where="")


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("ID").alias("id"), F.col("AMT").cast("double").alias("amt"), F.col("ST").alias("st")
    )


def _half(spark, sf_dir):
    """The change number in the middle of the stream."""
    return ops(spark, sf_dir).agg(F.expr("max(event_id) div 2")).scalar()


# --- events and messages ---------------------------------------------------------


def _event_columns(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("source.scn").alias("scn"),
        "op",
        F.col("source.txId").alias("tx_id"),
        F.col("source.table").alias("table_name"),
        "ts_ms",
        F.coalesce("after.ID", "before.ID").alias("id"),
        F.col("before.AMT").cast("double").alias("before_amt"),
        F.col("before.ST").alias("before_st"),
        F.col("after.AMT").cast("double").alias("after_amt"),
        F.col("after.ST").alias("after_st"),
    )


EVENTS_SQL = f"""
  WITH ops AS ({OPS}), prev AS (
    SELECT *, lag(amt) OVER w AS p_amt, lag(st) OVER w AS p_st FROM ops
    WINDOW w AS (PARTITION BY id ORDER BY event_id))
  SELECT scn, op, tx_id, upper(st) AS table_name, ts_ms,
         CASE WHEN op <> 'd' OR p_st IS NOT NULL THEN id END AS id,
         CASE WHEN op IN ('u','d') THEN CAST(p_amt AS DOUBLE) END AS before_amt,
         CASE WHEN op IN ('u','d') THEN p_st END AS before_st,
         CASE WHEN op <> 'd' THEN CAST(amt AS DOUBLE) END AS after_amt,
         CASE WHEN op <> 'd' THEN st END AS after_st
  FROM prev
"""


@query(EVENTS_SQL)
def change_events(spark, sf_dir):
    return _event_columns(full_changes(spark, sf_dir))


@query(EVENTS_SQL)
def envelope_round_trip(spark, sf_dir):
    """Events to wire messages and back."""
    events = full_changes(spark, sf_dir).drop("event_id")
    from tidemark.functions.connect import connect_value

    wire = events.select(connect_value(events.schema).alias("value"))
    row, source = events.schema["after"].dataType, events.schema["source"].dataType
    return _event_columns(read_envelopes(wire, row, source=source))


_B64 = """to_base64(unhex(CASE WHEN {u} >= 0 THEN
    CASE WHEN length({h}) % 2 = 1 THEN '0' || {h}
         WHEN substr({h}, 1, 1) IN ('8','9','A','B','C','D','E','F') THEN '00' || {h} ELSE {h} END
  ELSE regexp_replace({h}, '^(?:FF)+([89A-F].*)$', '\\1') END))"""


def _b64(unscaled: str) -> str:
    return _B64.format(u=unscaled, h=f"upper(to_hex({unscaled}))")


@query(
    f"""SELECT c_custkey, {_b64("u")} AS b64 FROM (
      SELECT c_custkey, CAST(round((c_acctbal - 5000) * 100) AS BIGINT) AS u FROM customer)"""
)
def decimal_bytes(spark, sf_dir):
    amount = F.round((F.col("c_acctbal") - 5000) * 100).cast("decimal(14,0)") / 100
    dtype = T.DecimalType(14, 2)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", decimal_to_base64(amount.cast(dtype), dtype).alias("b64")
    )


def _order_image(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_totalprice").cast("decimal(14,2)").alias("price"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").alias("ordered"),
        F.col("o_orderdate").cast("date").alias("day"),
    )


@query(
    f"""SELECT o_orderkey, '{{"o_orderkey":' || o_orderkey || ',"price":"' || {_b64("u")} ||
      '","status":' || CASE WHEN o_orderstatus <> 'P' THEN '"' || o_orderstatus || '"' ELSE 'null' END ||
      ',"ordered":' || epoch_us(o_orderdate) // 1000 || ',"day":' ||
      epoch_us(o_orderdate) // 86400000000 || '}}' AS payload
    FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS u FROM orders)"""
)
def connect_payloads(spark, sf_dir):
    rows = _order_image(spark, sf_dir)
    return rows.select("o_orderkey", connect_payload(rows.schema).alias("payload"))


@query(
    f"""WITH ops AS ({OPS})
    SELECT scn, '{{"schema":{{"type":"struct","name":"recovery.Key","optional":false,"fields":[' ||
      '{{"type":"int64","optional":false,"field":"ID"}},' ||
      '{{"type":"string","optional":false,"field":"ST"}}]}},"payload":{{"ID":' || id ||
      ',"ST":"' || st || '"}}}}' AS key FROM ops"""
)
def connect_keys(spark, sf_dir):
    events = changes(spark, sf_dir)
    return events.select(
        F.col("source.scn").alias("scn"), connect_key(events.schema, ["ID", "ST"]).alias("key")
    )


@query(
    """SELECT 'r' AS op, o_orderkey AS id, o_orderstatus AS st, '4711' AS scn,
              CAST(1700000000000 AS BIGINT) AS ts_ms FROM orders"""
)
def snapshot_read(spark, sf_dir):
    events = snapshot_load(
        table(spark, sf_dir, "orders"), "CDC", "ORDERS", 4711, 1_700_000_000_000
    )
    return events.select(
        "op",
        F.col("after.o_orderkey").alias("id"),
        F.col("after.o_orderstatus").alias("st"),
        F.col("source.scn").alias("scn"),
        "ts_ms",
    )


@query(
    f"""WITH ops AS ({OPS}) SELECT scn, op FROM ops
        WHERE op <> 'r' AND event_id > (SELECT max(event_id) // 2 FROM ops)"""
)
def no_data_start(spark, sf_dir):
    events = changes_after(changes(spark, sf_dir), _half(spark, sf_dir))
    return events.select(F.col("source.scn").alias("scn"), "op")


# --- routing ----------------------------------------------------------------------


def _event_registry(spark, sf_dir):
    """Tables with at least one valuable event are registered, except views."""
    return (
        table(spark, sf_dir, "events")
        .where("event_type <> 'view'")
        .select(F.lit("CDC").alias("schema_name"), F.upper("event_type").alias("table_name"))
        .distinct()
    )


@query(
    """SELECT 'changelog.cdc_' || event_type AS changelog_table, count(*) AS n,
              count_if(event_type = 'error') AS deletes
       FROM events WHERE event_type <> 'view' GROUP BY 1"""
)
def route_counts(spark, sf_dir):
    return (
        route(changes(spark, sf_dir), _event_registry(spark, sf_dir))
        .groupBy("changelog_table")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("op") == "d").alias("deletes"))
    )


@query("SELECT CAST(event_id AS VARCHAR) AS scn FROM events WHERE event_type <> 'view'")
def registered_events(spark, sf_dir):
    events = include_tables(changes(spark, sf_dir), _event_registry(spark, sf_dir))
    return events.select(F.col("source.scn").alias("scn"))


@query(
    """SELECT string_agg('CDC.' || t, ',' ORDER BY 'CDC.' || t) AS include_list
       FROM (SELECT DISTINCT upper(event_type) AS t FROM events WHERE event_type <> 'view')"""
)
def include_list_text(spark, sf_dir):
    return include_list(_event_registry(spark, sf_dir))


@query(
    """SELECT c_custkey, 'changelog.' || lower(c_mktsegment || '_' || c_name) AS changelog_table,
              'dz.' || c_mktsegment || '.' || c_name AS topic,
              'dz-recovery.' || lower(c_mktsegment || '_' || c_name) AS recovery_topic FROM customer"""
)
def table_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        changelog_name("c_mktsegment", "c_name").alias("changelog_table"),
        topic_name("dz", "c_mktsegment", "c_name").alias("topic"),
        recovery_topic("c_mktsegment", "c_name").alias("recovery_topic"),
    )


# --- changelog ----------------------------------------------------------------------


def _stored(spark, sf_dir) -> str:
    """The change events in a changelog, in two commits of one half each."""
    root = shared_dir(spark, "changelog")
    path = log.table_path(root, "CDC", "USERS")
    log.ensure_changelog(spark, root, "CDC", "USERS")
    events, half = changes(spark, sf_dir).drop("event_id"), _half(spark, sf_dir)
    log.append_changelog(events.where(scn_long() < half), path, "first")
    log.append_changelog(events.where(scn_long() >= half), path, "second")
    return path


DAYS = f"""
  WITH ops AS ({OPS})
  SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, count(*) AS records
  FROM ops GROUP BY 1
"""


@query(DAYS)
def changelog_days(spark, sf_dir):
    days = log.changelog_partitions(log.scan_changelog(spark, _stored(spark, sf_dir)))
    return days.select("day", "records")


@query("SELECT count(*) AS records, CAST(2 AS BIGINT) AS commits, true AS same_files, true AS same_bytes, true AS dated FROM events")
def changelog_report(spark, sf_dir):
    """Totals from what was noted while writing, against those of a scan."""
    path = _stored(spark, sf_dir)
    noted = log.changelog_report(spark, path)
    seen = log.changelog_summary(log.scan_changelog(spark, path)).first()
    return noted.select(
        "records", "commits", (F.col("files") == seen["files"]).alias("same_files"),
        (F.col("bytes") == seen["bytes"]).alias("same_bytes"), F.col("last_commit_at").isNotNull().alias("dated"),
    )


@query(
    f"""WITH ops AS ({OPS})
    SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, count(*) AS records,
           CAST(1 AS BIGINT) AS files, CAST(sum(event_id) AS BIGINT) AS scns FROM ops GROUP BY 1"""
)
def packed_changelog(spark, sf_dir):
    """Five commits a day packed into one file each; no event is lost or doubled."""
    path = log.table_path(shared_dir(spark, "packed"), "CDC", "USERS")
    events = changes(spark, sf_dir)
    for n in range(5):
        log.append_changelog(events.where(F.col("event_id") % 5 == n).drop("event_id"), path, f"c{n}")
    log.compact_changelog(spark, path)
    stored = log.scan_changelog(spark, path)
    scns = stored.groupBy(day_label("p_ts_ms").alias("day")).agg(F.sum("scn_num").alias("scns"))
    return log.changelog_partitions(stored).select("day", "records", "files").join(scns, "day")


@query("SELECT count(*) AS records, CAST(2 AS BIGINT) AS commits FROM events")
def changelog_totals(spark, sf_dir):
    totals = log.changelog_summary(log.scan_changelog(spark, _stored(spark, sf_dir)))
    return totals.select("records", "commits")


@query(
    """SELECT 'cdc_' || event_type AS changelog_table, count(*) AS records, CAST(1 AS BIGINT) AS commits
       FROM events WHERE event_type <> 'view' GROUP BY 1"""
)
def routed_changelogs(spark, sf_dir):
    """A mixed stream appended to the changelog of each registered table."""
    root = shared_dir(spark, "routed")
    events = changes(spark, sf_dir).drop("event_id")
    log.append_routed(events, _event_registry(spark, sf_dir), root, "only")
    totals = log.changelog_summary(log.scan_contents(spark, root))
    return totals.select("changelog_table", "records", "commits")


@query(
    """SELECT 'cdc_' || event_type AS changelog_table, count(*) AS records,
              count_if(event_type = 'purchase' AND event_id % 3 = 1) AS extras
       FROM events WHERE event_type <> 'view' AND event_id % 3 > 0 GROUP BY 1"""
)
def routed_row_types(spark, sf_dir):
    """A mixed stream with tables of the same name in an unregistered schema, and a column of one table."""
    root = shared_dir(spark, "routed")
    number = F.col("event_id")
    events = changes(spark, sf_dir)
    plain = events.schema["after"].dataType
    extra = F.when((F.col("source.table") == "PURCHASE") & (number % 3 == 1), number)
    grown = F.when(F.col("after").isNotNull(), F.col("after").withField("EXTRA", extra))
    none = F.when(F.col("before").isNotNull(), F.col("before").withField("EXTRA", F.lit(None).cast("bigint")))
    schema = F.when(number % 3 == 0, "OTHER").otherwise(F.col("source.schema"))
    events = events.withColumns({
        "after": grown, "before": none, "source": F.col("source").withField("schema", schema),
    }).drop("event_id")
    registry = _event_registry(spark, sf_dir)
    names = [r[0] for r in registry.select("table_name").collect()]
    types = {("CDC", n): plain for n in names if n != "PURCHASE"}
    log.append_routed(events, registry, root, "only", types)
    parts = []
    for name in names:
        stored = log.scan_changelog(spark, log.table_path(root, "CDC", name))
        known = "EXTRA" in stored.schema["after"].dataType.fieldNames()
        value = F.count("after.EXTRA") if known else F.lit(0).cast("bigint")
        parts.append(stored.agg(F.count(F.lit(1)).alias("records"), value.alias("extras")).select(
            F.lit(f"cdc_{name.lower()}").alias("changelog_table"), "records", "extras"))
    return reduce(DataFrame.unionByName, parts)


@query(
    f"""WITH ops AS ({OPS})
    SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day,
           count(*) AS records, count_if(op = 'd') AS deletes FROM ops GROUP BY 1"""
)
def changes_per_day(spark, sf_dir):
    return (
        changes(spark, sf_dir)
        .groupBy(day_label("source.ts_ms").alias("day"))
        .agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("op") == "d").alias("deletes"))
    )


@query(
    f"""WITH ops AS ({OPS})
    SELECT scn, CASE WHEN op <> 'd' THEN st END AS st, CASE WHEN op <> 'd' AND
      event_id >= (SELECT max(event_id) // 2 FROM ops) THEN id % 7 END AS extra FROM ops"""
)
def evolving_changelog(spark, sf_dir):
    """The second commit brings an image column the first does not have."""
    path = log.table_path(shared_dir(spark, "changelog"), "CDC", "USERS")
    events, half = changes(spark, sf_dir).drop("event_id"), _half(spark, sf_dir)
    log.append_changelog(events.where(scn_long() < half), path, "first")
    grown = F.when(
        F.col("after").isNotNull(), F.col("after").withField("EXTRA", F.col("after.ID") % 7)
    )
    later = events.where(scn_long() >= half).withColumn("after", grown)
    log.append_changelog(later, path, "second")
    return log.scan_changelog(spark, path).select(
        F.col("source.scn").alias("scn"),
        F.col("after.ST").alias("st"),
        F.col("after.EXTRA").alias("extra"),
    )


# --- state, replay, target ------------------------------------------------------------


@query(STATE)
def current_state(spark, sf_dir):
    return _flat(state.current_state(changes(spark, sf_dir), KEYS, seq="event_id"))


@query(STATE_SQL.format(ops=OPS, where="WHERE event_id >= (SELECT max(event_id) // 2 FROM ops)"))
def replay_from_scn(spark, sf_dir):
    events = replay.from_scn(changes(spark, sf_dir), _half(spark, sf_dir))
    return _flat(state.current_state(events, KEYS, seq="event_id"))


@query(
    f"""WITH ops AS ({OPS})
    SELECT row_number() OVER (ORDER BY event_id) AS place, scn, op FROM ops
    WHERE event_id >= (SELECT max(event_id) // 2 FROM ops)"""
)
def replay_sequence(spark, sf_dir):
    """Messages in published order: by number of the part file, then by row in it."""
    folder = shared_dir(spark, "published")
    events = replay.from_scn(changes(spark, sf_dir).drop("event_id"), _half(spark, sf_dir))
    replay.publish(events.hint("rebalance"), KEYS, folder, "parquet")
    rows = spark.read.parquet(folder).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "value"
    )
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(sizes.select("file", F.coalesce(before, F.lit(0)).alias("first")), "file").select(
        (F.col("first") + F.col("row") + 1).alias("place"),
        F.get_json_object("value", "$.payload.source.scn").alias("scn"),
        F.get_json_object("value", "$.payload.op").alias("op"),
    )


@query(
    f"""WITH ops AS ({OPS}), prev AS (
      SELECT *, lag(st) OVER (PARTITION BY id ORDER BY event_id) AS p_st FROM ops)
    SELECT count_if(op <> 'd' OR p_st IS NOT NULL) AS published,
           count_if(op = 'd' AND p_st IS NULL) AS skipped FROM prev"""
)
def replay_counters(spark, sf_dir):
    return replay.replay_counts(full_changes(spark, sf_dir))


@query(STATE)
def merge_batch(spark, sf_dir):
    """State of the first half, merged with an overlapping rest."""
    events, half = changes(spark, sf_dir), _half(spark, sf_dir)
    rows = state.change_rows(events, seq="event_id")
    old = state.fold(rows.where(F.col("_scn") < half), KEYS)
    rest = rows.where(F.col("_scn") >= F.expr("0.8") * half)
    return _flat(state.live(state.merge_batch(old, rest, KEYS)))


@query(STATE)
def merge_large_batch(spark, sf_dir):
    """The same with the plan for a batch of the state's own size."""
    events, half = changes(spark, sf_dir), _half(spark, sf_dir)
    rows = state.change_rows(events, seq="event_id")
    old = state.fold(rows.where(F.col("_scn") < half), KEYS)
    rest = rows.where(F.col("_scn") >= F.expr("0.8") * half)
    return _flat(state.live(state.merge_batch(old, rest, KEYS, small_batch=False)))


# Seven keys, forty changes to a transaction, one time for all of them.
TIED = f"""
  SELECT * EXCLUDE (id), id % 7 AS id FROM ({OPS})
"""


@query(
    f"""WITH last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id DESC) AS rn
                      FROM ({TIED}))
    SELECT p.path, id, CAST(amt AS DOUBLE) AS amt, st FROM last
    CROSS JOIN (VALUES ('changelog'), ('stream')) AS p(path) WHERE rn = 1 AND op <> 'd'"""
)
def transaction_ties(spark, sf_dir):
    """Rows changed many times in one transaction, by way of changelog and recovery, and of a stream."""
    rows = ops(spark, sf_dir).withColumns({
        "id": F.col("id") % 7,
        "scn": F.expr("event_id div 40").cast("string"),
        "tx_id": F.lit("t"),
        "ts_ms": F.expr("event_id div 40"),
    })
    events = as_changes(rows).repartition("op")
    root = shared_dir(spark, "ties")
    path, half = log.table_path(root, "CDC", "USERS"), _half(spark, sf_dir)
    log.append_changelog(events.where(F.col("event_id") >= half), path, "late half", seq="event_id")
    log.append_changelog(events.where(F.col("event_id") < half), path, "early half", seq="event_id")
    recovered = TargetTable(spark, f"{root}/recovered", KEYS)
    jobs.recover(spark, path, recovered, 0)
    events.write.parquet(f"{root}/arrived")
    arriving = streams.message_stream(spark, f"{root}/arrived", events.schema, "parquet", maxFilesPerTrigger="1")
    followed = TargetTable(spark, f"{root}/followed", KEYS)
    streams.start_apply(
        arriving, followed, f"{root}/checkpoint", seq="event_id", interval=None
    ).awaitTermination()
    sides = (("changelog", recovered), ("stream", followed))
    found = [_flat(t.read()).withColumn("path", F.lit(name)) for name, t in sides]
    return found[0].unionByName(found[1])


def _columns_sql(amt: str, st: str) -> str:
    """Each column from the last change that carries it; a delete carries both."""
    return f"""
      SELECT id, CAST(amt AS DOUBLE) AS amt, st FROM (
        SELECT id, arg_max(op, event_id) AS last_op,
               arg_max_null(CASE WHEN op <> 'd' THEN amt END, event_id) FILTER (op = 'd' OR {amt}) AS amt,
               arg_max_null(CASE WHEN op <> 'd' THEN st END, event_id) FILTER (op = 'd' OR {st}) AS st
        FROM ops, half GROUP BY id
      ) WHERE last_op <> 'd'
    """


@query(f"WITH ops AS ({OPS}), half AS (SELECT max(event_id) // 2 AS h FROM ops) {_columns_sql('event_id < h', 'true')}")
def narrow_batch(spark, sf_dir):
    """The second half comes without the amount: the target keeps the one it has."""
    target = TargetTable(spark, shared_dir(spark, "target"), KEYS)
    rows, half = state.change_rows(changes(spark, sf_dir), "event_id"), _half(spark, sf_dir)
    target.apply(rows.where(F.col("_scn") < half), "full")
    target.apply(rows.where(F.col("_scn") >= half).drop("AMT"), "narrow")
    target.apply(rows.where(F.col("_scn") >= half).drop("AMT"), "narrow")
    return _flat(target.read())


@query(
    f"WITH ops AS ({OPS}), half AS (SELECT max(event_id) // 5 AS h FROM ops)"
    + _columns_sql("least(event_id // h, 4) NOT IN (1, 4)", "least(event_id // h, 4) <> 3")
)
def late_batches_by_column(spark, sf_dir):
    """Five batches, two without the amount and one without the state; they come late, twice and past a compaction."""
    target = TargetTable(spark, shared_dir(spark, "target"), KEYS)
    rows = state.change_rows(changes(spark, sf_dir), "event_id")
    fifth = ops(spark, sf_dir).agg(F.expr("max(event_id) div 5")).scalar()
    part = F.least(F.floor(F.col("_scn") / fifth), F.lit(4))
    lacks = {1: ["AMT"], 3: ["ST"], 4: ["AMT"]}
    for n in (2, 4, 3, 0):
        target.apply(rows.where(part == n).drop(*lacks.get(n, [])), f"part-{n}")
    target.compact()
    target.apply(rows.where(part == 1).drop("AMT"), "part-1")
    target.apply(rows.where(part == 2), "part-2")
    return _flat(target.read())


@query(
    """SELECT CASE WHEN event_id % 11 = 0 THEN 'malformed' WHEN event_id % 13 = 0 THEN 'malformed'
                   WHEN event_id % 17 = 0 THEN 'no operation' ELSE 'taken' END AS reason, count(*) AS n
       FROM events GROUP BY 1"""
)
def rejected_messages(spark, sf_dir):
    """Messages that are cut off, carry text for a number, or name no operation are told apart."""
    from tidemark.functions.connect import connect_value

    events = changes(spark, sf_dir)
    number = F.col("event_id")
    messages = events.select(connect_value(events.drop("event_id").schema).alias("value"), number)
    broken = (
        F.when(number % 11 == 0, F.substring("value", 1, 60))
        .when(number % 13 == 0, F.regexp_replace("value", r'"ID":\d+', '"ID":"x"'))
        .when(number % 17 == 0, F.regexp_replace("value", r'"op":"."', '"op":null'))
        .otherwise(F.col("value"))
    )
    messages = messages.withColumn("value", broken)
    row, source = events.schema["after"].dataType, events.schema["source"].dataType
    taken = read_envelopes(messages, row, source=source, on_error="drop")
    reasons = taken.select(F.lit("taken").alias("reason")).unionByName(
        rejected(messages, row, source=source).select("reason")
    )
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(STATE)
def target_upsert(spark, sf_dir):
    """The target after two batches, the newer one first and the older one twice."""
    target = TargetTable(spark, shared_dir(spark, "target"), KEYS)
    rows, half = state.change_rows(changes(spark, sf_dir), "event_id"), _half(spark, sf_dir)
    older, newer = rows.where(F.col("_scn") < half), rows.where(F.col("_scn") >= half)
    target.apply(newer, "b2")
    target.apply(older, "b1")
    target.compact()
    target.apply(older, "b3")
    return _flat(target.read())


@query(
    f"""WITH ops AS ({OPS}), half AS (SELECT max(event_id) // 2 AS h FROM ops), last AS (
      SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1)
    SELECT id, op = 'd' AS deleted FROM last, half WHERE op <> 'd' OR event_id >= h"""
)
def expired_tombstones(spark, sf_dir):
    """Deletes that both consumers have passed leave the base, later ones stay; readers see the same rows."""
    root = shared_dir(spark, "expiry")
    target = TargetTable(spark, f"{root}/target", KEYS)
    rows, half = state.change_rows(changes(spark, sf_dir), "event_id"), _half(spark, sf_dir)
    target.apply(rows.where(F.col("_scn") < half), "old")
    target.apply(rows.where(F.col("_scn") >= half), "new")
    bounds = ops(spark, sf_dir).agg(F.expr("max(event_id) div 2"), F.max("event_id")).first()
    save_position(spark, f"{root}/consumers", "replay", bounds[0])
    save_position(spark, f"{root}/consumers", "apply", bounds[1])
    streams.expire(target, f"{root}/consumers")
    return target.state().select(F.col("ID").alias("id"), F.col("_deleted").alias("deleted"))


@query(STATE)
def recovery_rehearsal(spark, sf_dir):
    """Changelog stored, target emptied, replayed from the start, read back."""
    path = _stored(spark, sf_dir)
    target = TargetTable(spark, shared_dir(spark, "target"), KEYS)
    half = int(ops(spark, sf_dir).agg(F.expr("max(event_id) div 2")).first()[0])
    jobs.recover(spark, path, target, half)
    target.truncate()
    jobs.recover(spark, path, target, 0)
    return _flat(target.read())


@query(
    """SELECT count(*) AS source_rows, count(*) AS target_rows, true AS matched FROM orders"""
)
def resnapshot_verified(spark, sf_dir):
    """A target holding strays is truncated, loaded and verified."""
    source = table(spark, sf_dir, "orders")
    target = TargetTable(spark, shared_dir(spark, "target"), ["o_orderkey"])
    strays = source.withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    at = 1_700_000_000_000
    target.apply(state.change_rows(snapshot_load(strays, "CDC", "ORDERS", 1, at)), "old")
    jobs.resnapshot(spark, source, target, "CDC", "ORDERS", 2, at, truncate=True)
    found = jobs.verify(source, target, ["o_orderkey", "o_orderstatus", "o_custkey"])
    return found.select("source_rows", "target_rows", "matched")


@query(
    """SELECT 'ORDERS' AS table_name, count(*) AS row_count FROM orders
       UNION ALL SELECT 'CUSTOMER', count(*) FROM customer
       UNION ALL SELECT 'LINEITEM', count(*) FROM lineitem"""
)
def target_row_counts(spark, sf_dir):
    names = ["orders", "customer", "lineitem"]
    return target_counts({n.upper(): table(spark, sf_dir, n) for n in names})
