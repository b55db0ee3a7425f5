"""Small driver-side file steps on whatever file system a path lives on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _open(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, sorted; nothing when it does not exist."""
    _, p, fs = _open(spark, path)
    if not fs.exists(p):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(p))


def size(spark: SparkSession, paths: list[str]) -> int:
    """Bytes below some folders, from file system metadata."""
    total = 0
    for path in paths:
        _, p, fs = _open(spark, path)
        total += fs.getContentSummary(p).getLength()
    return total


def remove(spark: SparkSession, path: str) -> bool:
    _, p, fs = _open(spark, path)
    return fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: a temporary name first, then a rename."""
    jvm, p, fs = _open(spark, path)
    staged = jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{p.getName()}.tmp")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(staged, p):
        fs.delete(staged, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    jvm, p, fs = _open(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def numbered(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of ``<n>.json`` files in a folder, ascending."""
    names = children(spark, folder)
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def rename(spark: SparkSession, old: str, new: str) -> None:
    jvm, p, fs = _open(spark, old)
    target = jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"cannot rename {old} to {new}")


def listing(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names and bytes of the data files directly in a folder; nothing when it does not exist."""
    _, p, fs = _open(spark, folder)
    if not fs.exists(p):
        return {}
    return {
        s.getPath().getName(): s.getLen() for s in fs.listStatus(p)
        if s.isFile() and not s.getPath().getName().startswith(("_", "."))
    }
