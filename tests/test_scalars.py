from pyspark.sql import functions as F

from tidemark.functions import scalars as S, text as X


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_names(spark):
    r = one(
        spark,
        log=S.changelog_name(F.lit("SRC"), F.lit("ORDERS")),
        log2=S.changelog_name(F.lit("CDC"), F.lit("TEST_TABLE_01")),
        topic=S.topic_name("dz", F.lit("CDC"), F.lit("T1")),
        rec=S.recovery_topic(F.lit("CDC"), F.lit("AUTO_100")),
    )
    assert tuple(r) == (
        "changelog.src_orders", "changelog.cdc_test_table_01", "dz.CDC.T1", "dz-recovery.cdc_auto_100",
    )


def test_scn_is_strict(spark):
    texts = ["1000", "+5", "-7", " 5 ", "5.0", "x", "", "9223372036854775807", "9223372036854775808", None, "5\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(S.strict_long("t")).collect()]
    assert got == [1000, 5, -7, None, None, None, None, 2**63 - 1, None, None, None]


def test_day_floor_below_zero(spark):
    r = one(
        spark,
        a=S.truncate_ms(F.lit(-1)), b=S.truncate_ms(F.lit(0)), c=S.truncate_ms(F.lit(86_400_001)),
        d=S.day_label(F.lit(-1)), e=S.day_label(F.lit(1_753_305_600_000)),
    )
    assert tuple(r) == (-86_400_000, 0, 86_400_000, "1969-12-31", "2025-07-23")


def test_times_do_not_depend_on_the_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-03-10 02:30:59.123456' t, timestamp_ntz'1969-12-31 23:59:59.9999' u")
    cols = [
        S.ntz_millis("t"), S.ntz_millis("u"), S.truncate_time("HOUR", "t").cast("string"),
        S.truncate_time("DAY", "u").cast("string"), S.millis_to_ntz(F.lit(-1)).cast("string"),
    ]
    want = (1710037859123, -1, "2024-03-10 02:00:00", "1969-12-31 00:00:00", "1969-12-31 23:59:59.999")
    for zone in ("UTC", "America/New_York", "Asia/Seoul"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert tuple(df.select(*cols).first()) == want
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_mean_rounds_halves_away_from_zero(spark):
    cases = [(5, 2, 3), (-5, 2, -3), (7, 3, 2), (8, 3, 3), (0, 4, 0), (9007199254740993, 1, 9007199254740993)]
    df = spark.createDataFrame(cases, "s bigint, n bigint, want bigint")
    assert df.where(S.mean_half_away(F.col("s"), F.col("n")) != F.col("want")).count() == 0


def test_mapping_expressions(spark):
    good = {"${COL1}": "COL1", "${col_1#$}": "COL_1#$", "  ${COL1}  ": "COL1"}
    bad = ["${{COL1}", "${COL1", "COL1", "${}", "${1COL}", "$COL1", "${COL1}}", "${COL1} ${COL2}", "", "${UPPER(COL1)}"]
    df = spark.createDataFrame([(e,) for e in [*good, *bad]], "e string")
    got = {r[0]: r[1] for r in df.select("e", X.source_column("e")).collect()}
    assert got == {**good, **dict.fromkeys(bad)}


def test_identity_ignores_case(spark):
    df = spark.createDataFrame([("id", "${ID}"), ("ID", "${NAME}"), ("ID", "x")], "t string, e string")
    assert [r[0] for r in df.select(X.is_identity("t", "e")).collect()] == [True, False, False]


def test_ignorable_ddl(spark):
    cases = {
        "ALTER TABLE T ADD SUPPLEMENTAL LOG DATA (ALL) COLUMNS": True,
        "  grant select on T to U": True,
        "COMMENT ON TABLE T IS 'x'": True,
        "analyze\ttable T": True,
        "ALTER TABLE T ADD (GRANTED NUMBER)": False,
        "DROP TABLE T": False,
        "GRANTS": False,
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r[0]: r[1] for r in df.select("d", X.is_ignorable("d")).collect()} == cases


def test_first_line(spark):
    cases = {"a": "a", " a\nb": "a", "x" * 121: "x" * 120 + "…", "x" * 120: "x" * 120, "y" * 200 + "\nz": "y" * 200}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r[0]: r[1] for r in df.select("d", X.first_line("d")).collect()} == cases


TARGET = '"TGT_OWN"."AUTO_100_COPY"'


def test_retarget(spark):
    cases = {
        "ALTER TABLE CDC.AUTO_100 ADD (X NUMBER)": f"ALTER TABLE {TARGET} ADD (X NUMBER)",
        'ALTER TABLE "CDC"."AUTO_100" DROP (Y)': f"ALTER TABLE {TARGET} DROP (Y)",
        "alter table cdc.auto_100 drop (y)": f"alter table {TARGET} drop (y)",
        "ALTER TABLE AUTO_100 ADD (Z NUMBER)": f"ALTER TABLE {TARGET} ADD (Z NUMBER)",
        "CREATE INDEX IDX_AUTO_100X ON CDC.AUTO_100(COL1)": f"CREATE INDEX IDX_AUTO_100X ON {TARGET}(COL1)",
        "ALTER TABLE CDC.AUTO_1000 ADD (X NUMBER)": "ALTER TABLE CDC.AUTO_1000 ADD (X NUMBER)",
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    names = [F.lit(x) for x in ("CDC", "AUTO_100", "TGT_OWN", "AUTO_100_COPY")]
    assert {r[0]: r[1] for r in df.select("d", X.retarget_ddl("d", *names)).collect()} == cases


def test_retarget_leaves_same_names_alone_and_takes_names_literally(spark):
    ddl = F.lit("ALTER TABLE CDC.A$1 ADD (X NUMBER)")
    same = X.retarget_ddl(ddl, *[F.lit(x) for x in ("CDC", "A$1", "cdc", "a$1")])
    other = X.retarget_ddl(ddl, *[F.lit(x) for x in ("CDC", "A$1", "T", "B$1\\")])
    short = X.retarget_ddl(F.lit("DROP TABLE CDC.AUTO_100"), *[F.lit(x) for x in ("CDC", "AUTO_1", "T", "T")])
    assert tuple(one(spark, a=same, b=other, c=short)) == (
        "ALTER TABLE CDC.A$1 ADD (X NUMBER)",
        'ALTER TABLE "T"."B$1\\" ADD (X NUMBER)',
        "DROP TABLE CDC.AUTO_100",
    )


def test_cause_line(spark):
    cases = {
        "top\nCaused by: a\nCaused by: b ": "b",
        " first \nsecond": "first",
        "Caused by: only": "only",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None, ""]], "t string")
    got = {r[0]: r[1] for r in df.select("t", X.cause_line("t")).collect()}
    assert got == {**cases, None: None, "": None}


def test_process_texts(spark):
    status = ["Name: x\nVmRSS:\t 2097152 kB\nX: 1", "Name: x", "VmRSS: lots kB", "XVmRSS: 5 kB"]
    stat = ["12 ((a b) c) S 1 2 3 4 5 6 7 8 9 10 600 400 0 0", "no bracket", "1 (x) S 1 2", "1 (x) S 1 2 3 4 5 6 7 8 9 10 a 4"]
    df = spark.createDataFrame(list(zip(range(4), status, stat)), "i int, a string, b string").orderBy("i")
    got = [tuple(r) for r in df.select(X.rss_kb("a"), X.cpu_ticks("b")).collect()]
    assert got == [(2097152, 1000), (-1, -1), (-1, -1), (-1, -1)]


def test_table_badge(spark):
    df = spark.createDataFrame(
        [("RUNNING", 101), ("RUNNING", 100), ("PAUSED", 0), ("N/A", 0), ("FAILED", 0)], "s string, l bigint"
    )
    got = [r[0] for r in df.select(X.table_badge("s", "l")).collect()]
    assert got == ["warn", "ok", "dim", "dim", "crit"]
