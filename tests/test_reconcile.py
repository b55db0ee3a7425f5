from decimal import Decimal
import hashlib

from pyspark.sql import functions as F

from fixtures import rows
from tidemark.operators import reconcile as R

COLS = ["id", "amt", "st"]
DATA = [(i, Decimal(i) / 4, None if i % 5 == 0 else f"s{i}") for i in range(50)]
SHAPE = "id bigint, amt decimal(14,2), st string"


def frame(spark, data):
    return spark.createDataFrame(data, SHAPE)


def expected(data):
    total = 0
    for row in data:
        text = "|".join("~null~" if v is None else (f"{v:.2f}" if isinstance(v, Decimal) else str(v)) for v in row)
        total += int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    return len(data), Decimal(total)


def test_checksum_value(spark):
    assert tuple(R.checksum(frame(spark, DATA), COLS).first()) == expected(DATA)
    assert tuple(R.checksum(frame(spark, []), COLS).first()) == (0, Decimal(0))


def test_order_is_ignored_and_duplicates_are_not(spark):
    df = frame(spark, DATA)
    base = tuple(R.checksum(df, COLS).first())
    assert tuple(R.checksum(df.orderBy(F.desc("id")).repartition(7), COLS).first()) == base
    assert tuple(R.checksum(frame(spark, [*DATA, DATA[3]]), COLS).first()) != base
    swapped = [*DATA[:-2], (DATA[-2][0], DATA[-1][1], DATA[-2][2]), (DATA[-1][0], DATA[-2][1], DATA[-1][2])]
    assert tuple(R.checksum(frame(spark, swapped), COLS).first()) != base


def test_null_and_its_text_collide(spark):
    """A known limit of text checksums, kept as it is."""
    a, b = frame(spark, [(1, None, None)]), frame(spark, [(1, None, "~null~")])
    assert R.reconcile(a, b, COLS).first()["matched"]


def test_verdicts(spark):
    df = frame(spark, DATA)
    assert R.reconcile(df, df.repartition(3), COLS).first()["matched"]
    assert not R.reconcile(df, frame(spark, DATA[1:]), COLS).first()["matched"]
    changed = [(DATA[0][0], DATA[0][1], "other"), *DATA[1:]]
    assert not R.reconcile(df, frame(spark, changed), COLS).first()["matched"]
    # Columns left out do not count.
    assert R.reconcile(df, frame(spark, changed), ["id", "amt"]).first()["matched"]
    assert R.reconcile(frame(spark, []), frame(spark, []), COLS).first()["matched"]


def test_half_sums_add_up(spark):
    """The two half sums add up to the plain sum."""
    df = spark.range(100_000).select(F.col("id"))
    got = R.checksum(df, ["id"]).first()["checksum"]
    plain = df.agg(F.sum(R.row_hash(["id"]).cast("decimal(20,0)"))).first()[0]
    assert got == plain


def test_orphans_keep_duplicates_of_the_target(spark):
    src = frame(spark, DATA[:40] + DATA[:5])
    tgt = frame(spark, DATA + DATA[45:])
    assert rows(R.orphans(src, tgt, ["id"]).select("id")) == sorted((i,) for i in [*range(40, 50), *range(45, 50)])


def test_duplicate_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b")], "x int, y string")
    got = {(r["x"], r["y"]): r["n"] for r in R.duplicate_keys(df, ["x", "y"]).collect()}
    assert got == {(1, "a"): 2, (None, "b"): 1}


def test_target_gate(spark):
    df = frame(spark, DATA)
    assert rows(R.target_counts({"A": df, "B": df.where("false")})) == [("A", 50), ("B", 0)]


def test_missing_columns(spark):
    a = frame(spark, [])
    assert R.missing_columns(a, a.withColumnRenamed("st", "ST")) == []
    assert R.missing_columns(a, a.drop("st").withColumn("amt", F.lit("x"))) == ["amt", "st"]
