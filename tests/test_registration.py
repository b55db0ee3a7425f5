import pytest
from pyspark.sql import functions as F

from fixtures import rows
from tidemark.operators import mapping as mp, registration as reg, timeline

COLUMNS = [("ID", "NUMBER", 1), ("AMOUNT", "NUMBER", 2), ("STATUS", "VARCHAR2", 3)]
TABLES = ["T1", "TEST_1", "TEST_2", "NOPK", "NOLOG", "AUTO_100"]
SPEC = "spec_no int, source string, target_schema string, target_table string, snapshot_mode string"
MAPPING = "spec_no int, position int, target_column string, source_expr string, enabled boolean"


@pytest.fixture(scope="module")
def relations(spark):
    tables = spark.createDataFrame(
        [("CDC", t, 5) for t in TABLES] + [("OTHER", "T1", None)],
        "schema_name string, table_name string, num_rows bigint",
    )
    constraints = spark.createDataFrame(
        [(s, t, k, f"{k}_{t}") for s, t in [("CDC", x) for x in TABLES] + [("OTHER", "T1")] for k in "PC" if (t, k) != ("NOPK", "P")],
        "schema_name string, table_name string, constraint_type string, constraint_name string",
    )
    logs = spark.createDataFrame(
        [(s, t, "ALL COLUMN LOGGING" if t != "NOLOG" else "USER LOG GROUP") for s, t in [("CDC", x) for x in TABLES] + [("OTHER", "T1")]],
        "schema_name string, table_name string, log_group_type string",
    )
    columns = spark.createDataFrame(
        [(s, t, *c) for s, t in [("CDC", x) for x in TABLES] + [("OTHER", "T1")] for c in COLUMNS],
        "schema_name string, table_name string, column_name string, data_type string, column_id int",
    )
    keys = constraints.select("schema_name", "table_name", "constraint_name").withColumn("column_name", F.lit("ID"))
    return reg.list_tables(tables, constraints, logs), reg.list_columns(columns, constraints, keys)


def validate(spark, relations, specs, mappings=(), registered=(), **kw):
    found = reg.validate_registration(
        spark.createDataFrame([(n, s, None, None, None) if isinstance(s, str) else (n, *s) for n, s in enumerate(specs)], SPEC),
        spark.createDataFrame(list(mappings), MAPPING),
        *relations,
        spark.createDataFrame(list(registered), "schema_name string, table_name string"),
        **kw,
    )
    return {r["spec_no"]: r for r in found.collect()}


def test_patterns():
    assert reg.parse_pattern("CDC.*") == ("CDC", "%")
    assert reg.parse_pattern(" cdc.test_% ") == ("CDC", "TEST_%")
    assert reg.parse_pattern("CDC.T1") == ("CDC", "T1")
    for bad in ("T1", ".T1", "CDC.", None, " . "):
        with pytest.raises(ValueError):
            reg.parse_pattern(bad)


def test_discovery_uses_like(relations):
    tables, _ = relations
    assert rows(reg.discover(tables, "CDC.TEST_%").select("table_name")) == [("TEST_1",), ("TEST_2",)]
    # An underscore is a wildcard too.
    assert rows(reg.discover(tables, "CDC.N_PK").select("table_name")) == [("NOPK",)]


def test_dictionary(relations):
    tables, columns = relations
    flags = {(r["schema_name"], r["table_name"]): (r["has_pk"], r["supp_log_all"], r["num_rows"]) for r in tables.collect()}
    assert flags["CDC", "T1"] == (True, True, 5)
    assert flags["CDC", "NOPK"] == (False, True, 5)
    assert flags["CDC", "NOLOG"] == (True, False, 5)
    assert flags["OTHER", "T1"] == (True, True, None)
    assert rows(columns.where("table_name = 'TEST_1'").select("column_name", "is_pk")) == [("AMOUNT", False), ("ID", True), ("STATUS", False)]
    assert not columns.where("table_name = 'NOPK' AND is_pk").count()


def test_work_is_dealt_to_tasks_that_stay(spark, relations):
    n = reg.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    specs = spark.createDataFrame([(k, "CDC.*", None, None, None) for k in range(50)] + [(50, "CDC.T1", None, None, None)], SPEC)
    nothing = spark.createDataFrame([], "schema_name string, table_name string")
    found = reg.validate_registration(specs, spark.createDataFrame([], MAPPING), *relations, nothing)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Refused specs of one name are not gathered in one partition of the window.
    window = next(x for x in plan.splitlines() if "Window [" in x)
    assert "_refused" in window
    assert "hashpartitioning(spec_no" in plan and plan.count(f", {n}), REPARTITION_BY_NUM") >= 8
    got = {r["spec_no"]: r["reason"] for r in found.collect()}
    assert got == {k: "wildcard or malformed name" for k in range(50)} | {50: None}


def test_rules_without_mappings(spark, relations):
    specs = ["CDC.T1", "CDC.*", "CDC.TEST_%", "CDC.MISSING", "cdc.nopk", "CDC.NOLOG", "CDC.TEST_1", "CDC.TEST_2", "NODOT", ("CDC.AUTO_100", "tgt ", " ", "Sometimes")]
    got = validate(spark, relations, specs, registered=[("CDC", "TEST_1"), ("ELSE", "TEST_2")])
    assert {n: r["reason"] for n, r in got.items()} == {
        0: None, 1: "wildcard or malformed name", 2: "wildcard or malformed name", 3: "table not in source",
        4: "no primary key", 5: "change logging not set", 6: "already registered",
        7: "same table name under another schema", 8: "wildcard or malformed name", 9: "snapshot mode unknown",
    }
    assert [n for n, r in got.items() if r["accepted"]] == [0]


def test_names_and_modes(spark, relations):
    got = validate(spark, relations, [("cdc.t1", " tgt ", "copy", "no_data"), ("CDC.TEST_1", None, "", None)])
    assert (got[0]["target_schema"], got[0]["target_table"], got[0]["snapshot_mode"]) == ("TGT", "COPY", "NO_DATA")
    assert (got[1]["target_schema"], got[1]["target_table"], got[1]["snapshot_mode"]) == ("CDC", "TEST_1", "INITIAL")


ID, AMT, ST = ("ID", "${ID}", True), ("AMOUNT", "${AMOUNT}", True), ("STATUS", "${STATUS}", True)


@pytest.mark.parametrize(
    "maps,reason",
    [
        ([ID, AMT, ST], None),
        ([ID, ("AMOUNT", "", False), ("STATUS2", " ${status} ", True)], None),
        ([ID, (" ", "${AMOUNT}", False)], "target column is blank"),
        ([ID, ("AMOUNT", "AMOUNT", True)], "mapping expression does not parse"),
        ([ID, ("AMOUNT", "${NOPE}", True)], "mapping names an unknown source column"),
        ([("ID", "${ID}", False), AMT], "primary key not fully mapped"),
        ([("KEY", "${ID}", True), AMT], "primary key not fully mapped"),
        ([AMT, ("X", "${NOPE}", True), ("Y", "bad", True)], "mapping names an unknown source column"),
        ([("X", "${NOPE}", False), ID], None),
    ],
)
def test_mapping_rules(spark, relations, maps, reason):
    got = validate(spark, relations, ["CDC.T1"], [(0, i, *m) for i, m in enumerate(maps)])
    assert got[0]["reason"] == reason and got[0]["accepted"] == (reason is None)


def test_a_table_name_is_won_once_per_batch(spark, relations):
    got = validate(spark, relations, ["CDC.T1", "OTHER.T1", "CDC.T1"])
    assert {n: r["reason"] for n, r in got.items()} == {0: None, 1: "same table name under another schema", 2: "already registered"}


def test_all_or_nothing(spark, relations):
    got = validate(spark, relations, ["CDC.T1", "CDC.NOPK"], all_or_nothing=True)
    assert not any(r["accepted"] for r in got.values())
    got = validate(spark, relations, ["CDC.T1", "CDC.TEST_1"], all_or_nothing=True)
    assert all(r["accepted"] for r in got.values())


def test_oldest_registration_sets_the_mode(spark):
    df = spark.createDataFrame([(2, "INITIAL"), (1, "no_data"), (3, "INITIAL")], "id int, snapshot_mode string")
    assert reg.effective_snapshot_mode(df).first()[0] == "no_data"
    assert reg.effective_snapshot_mode(df.where("id > 1")).first()[0] == "initial"
    assert reg.effective_snapshot_mode(df.where("false")).first()[0] == "initial"


def test_roles(spark):
    df = spark.createDataFrame([("SOURCE", "TARGET"), ("TARGET", "SOURCE"), ("SOURCE", None)], "source_role string, target_role string")
    assert [r["accepted"] for r in reg.check_roles(df).collect()] == [True, False, False]


def test_session_catalog_as_dictionary(spark, path):
    spark.createDataFrame([(1, "a")], "id int, name string").write.option("path", f"{path}/t").saveAsTable("default.stock")
    try:
        got = rows(reg.catalog_columns(spark, "default").where("table_name = 'STOCK'"))
    finally:
        spark.sql("DROP TABLE default.stock")
    assert got == [("DEFAULT", "STOCK", "ID", "int", 1), ("DEFAULT", "STOCK", "NAME", "string", 2)]


# --- mappings -------------------------------------------------------------------------


def names(spark, *cols):
    return spark.createDataFrame([("CDC", "T1", c) for c in cols], "schema_name string, table_name string, column_name string")


def test_auto_and_default_mapping(spark):
    got = rows(mp.auto_map(names(spark, "ID", "AMOUNT"), names(spark, "id", "EXTRA")).drop("schema_name", "table_name"))
    assert got == [("EXTRA", "", False), ("id", "${id}", True)]
    got = rows(mp.default_mapping(names(spark, "ID", "B")).drop("schema_name", "table_name"))
    assert got == [("B", "${B}", True), ("ID", "${ID}", True)]


def test_include_filter(spark):
    shape = "schema_name string, table_name string, position int, target_column string, source_expr string, enabled boolean"
    some = [("CDC", "T1", 0, "ID", "${ID}", True), ("CDC", "T1", 1, "AMOUNT", "${AMOUNT}", False), ("CDC", "T1", 2, "STATUS2", "${STATUS}", True)]
    every = [("CDC", "T2", 1, "AMOUNT", "${AMOUNT}", True), ("CDC", "T2", 0, "id", "${ID}", True)]
    got = {r["table_name"]: r["include_list"] for r in mp.include_filter(spark.createDataFrame(some + every, shape)).collect()}
    assert got == {"T1": "ID", "T2": None}


def test_apply_mapping_prunes_the_scan(spark, path):
    spark.createDataFrame([(1, "a", "b")], "id int, amount string, status string").write.parquet(f"{path}/t")
    df = spark.read.parquet(f"{path}/t")
    out = mp.apply_mapping(df, [("ID", "${ID}", True), ("AMOUNT", "${AMOUNT}", False), ("STATUS2", "${STATUS}", True)])
    assert out.columns == ["id"]
    assert "ReadSchema: struct<id:int>" in out._jdf.queryExecution().executedPlan().toString()
    assert mp.apply_mapping(df, []).columns == ["id", "amount", "status"]


# --- lists ---------------------------------------------------------------------------


def test_timeline_write_never_fails_the_caller(spark, path):
    from tidemark.sinks.stores import record_events

    df = spark.createDataFrame([(1, "CDC")], "event_id bigint, schema_name string")
    assert record_events(df, f"{path}/events")
    assert not record_events(df.withColumn("bad", F.raise_error(F.lit("no")).cast("string")), f"{path}/events")
    assert spark.read.parquet(f"{path}/events").count() == 1


def test_timeline(spark):
    df = spark.createDataFrame(
        [(i, "CDC", "AUTO_100" if i % 2 else "T1", "ERROR" if i % 3 == 0 else "INFO") for i in range(300)],
        "event_id bigint, schema_name string, table_name string, severity string",
    )
    ids = lambda d: [r["event_id"] for r in d.collect()]
    assert ids(timeline.timeline(df)) == list(range(299, 199, -1))
    assert ids(timeline.timeline(df, table=("CDC", "T1"), limit=2)) == [298, 296]
    assert ids(timeline.timeline(df, severity="ERROR", limit=2)) == [297, 294]
    assert ids(timeline.timeline(df, text="cdc.auto", limit=2)) == [299, 297]
    plan = timeline.timeline(df)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
