"""Text sources: folded stacks, symbol listings, process maps, and raw address lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions.frames import markers_are_roots
from stackloom.functions.metadata import parse_metadata
from stackloom.sources.store import file_path

#: Markers in a raw address list, as unsigned 64-bit numbers (fixed values): what follows is kernel, or user.
KERNEL_CONTEXT, USER_CONTEXT = 18446744073709551488, 18446744073709551104
ADDRESS = "decimal(20,0)"


def hex_address(digits: Column) -> Column:
    """The number that hexadecimal digits name, exactly, also above 64 bits; null where it does not fit ``ADDRESS``."""
    # conv stops at 64 bits, so the last 15 digits and those before them are read apart.
    high, low = (F.regexp_extract(digits, r"^0*(.*?)(.{0,15})$", i) for i in (1, 2))
    value = [F.conv(F.concat(F.lit("0"), F.when(F.length(x) < 16, x)), 16, 10).cast("decimal(20,0)") for x in (high, low)]
    return (value[0] * F.lit(1 << 60).cast("decimal(19,0)") + value[1]).try_cast(ADDRESS)


def parse_folded(lines: DataFrame) -> DataFrame:
    """``lines(value)`` to ``meta, stack, samples, _corrupt``: the count after the last space, frames between semicolons, the header first.

    Lines without a count, with a malformed header, or with a marker that is no root, are kept in ``_corrupt``.
    """
    shape = r"^([\s\S]*) (\d+)$"
    parts = F.filter(F.split(F.regexp_extract("value", shape, 1), ";"), lambda p: p != "")
    parsed = lines.withColumn("_p", parts).withColumn("_m", parse_metadata(F.get("_p", F.lit(0)))).withColumn("_s", F.slice("_p", F.lit(2), F.greatest(F.size("_p"), F.lit(1))))
    ok = F.col("value").rlike(shape) & F.coalesce(F.col("_m.ok"), F.lit(False)) & markers_are_roots(F.col("_s"))
    return parsed.select(
        F.when(ok, F.col("_m")).alias("meta"), F.when(ok, F.col("_s")).alias("stack"), F.when(ok, F.regexp_extract("value", shape, 2).try_cast("bigint")).alias("samples"), F.when(~ok, F.col("value")).alias("_corrupt")
    )


def read_folded(spark: SparkSession, path: str) -> DataFrame:
    """Lines of files that Spark splits; invalid UTF-8 is replaced, not refused."""
    return parse_folded(spark.read.text(path).select(F.make_valid_utf8("value").alias("value")).where("value <> ''"))


def write_folded(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def parse_kallsyms(lines: DataFrame) -> DataFrame:
    """``lines(.., value)`` to ``.., addr, kind, sym``; malformed lines are skipped."""
    shape = r"^([0-9a-f]+) (\S) (\S+)"
    rest = [c for c in lines.columns if c != "value"]
    rows = lines.where(F.col("value").rlike(shape)).select(*rest, hex_address(F.regexp_extract("value", shape, 1)).alias("addr"), F.regexp_extract("value", shape, 2).alias("kind"), F.regexp_extract("value", shape, 3).alias("sym"))
    return rows.where("addr is not null")


def read_kallsyms(spark: SparkSession, path: str) -> DataFrame:
    """``host, file, line_no, addr, kind, sym`` of listings in folders named by host.

    A listing is as large as a kernel has symbols, whatever the number of hosts, so a file is one
    row and its lines have numbers: of one address the last line counts.
    """
    names = F.split("path", "/")
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select("value", file_path().alias("path"))
    lines = files.select(F.element_at(names, -2).alias("host"), F.element_at(names, -1).alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return parse_kallsyms(lines)


def parse_proc_maps(lines: DataFrame, permissions: str = "x") -> DataFrame:
    """``lines(.., line_no, value)`` to ``.., line_no, start, stop, perm, path`` for rows with any of the permissions."""
    shape = r"^([0-9a-f]+)-([0-9a-f]+) (\S+) \S+ \S+ \S+\s*(.*)$"
    rest = [c for c in lines.columns if c != "value"]
    rows = lines.where(F.col("value").rlike(shape)).select(*rest, *[hex_address(F.regexp_extract("value", shape, i)).alias(n) for i, n in ((1, "start"), (2, "stop"))], F.regexp_extract("value", shape, 3).alias("perm"), F.regexp_extract("value", shape, 4).alias("path"))
    return rows.where(F.col("perm").rlike(f"[{permissions}]") & F.col("start").isNotNull() & F.col("stop").isNotNull())


def split_callchain(ips: Column, depth: int = 127) -> Column:
    """Struct ``kernel, user`` of one address list with context marks; each part is cut to ``depth``."""
    empty = F.array().cast(f"array<{ADDRESS}>")
    start = F.struct(F.lit(0).alias("state"), empty.alias("kernel"), empty.alias("user"))
    kernel, user = F.lit(str(KERNEL_CONTEXT)).cast(ADDRESS), F.lit(str(USER_CONTEXT)).cast(ADDRESS)

    def step(a: Column, ip: Column) -> Column:
        mark = (ip == kernel) | (ip == user)
        return F.struct(
            F.when(ip == kernel, 1).when(ip == user, 2).otherwise(a["state"]).alias("state"),
            F.when(~mark & (a["state"] == 1), F.array_append(a["kernel"], ip)).otherwise(a["kernel"]).alias("kernel"),
            F.when(~mark & (a["state"] == 2), F.array_append(a["user"], ip)).otherwise(a["user"]).alias("user"),
        )

    done = F.aggregate(ips, start, step)
    return F.struct(F.slice(done["kernel"], 1, depth).alias("kernel"), F.slice(done["user"], 1, depth).alias("user"))


SAMPLE_SCHEMA = "host string, ts timestamp, record_ms bigint, pid int, tid int, cpu int, cgroup_id decimal(20,0), comm string, group_comm string, env string, user_frames array<string>, kernel_frames array<string>, weight bigint"


def read_sample_stream(spark: SparkSession, path: str, schema: str = SAMPLE_SCHEMA, max_files: int | None = None) -> DataFrame:
    """A stream of samples from Parquet files; rows without a time or a host are malformed and filtered out."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path).where("ts is not null and host is not null")
