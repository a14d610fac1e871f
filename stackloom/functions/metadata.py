"""Metadata headers, environment values and labels, as column functions.

A header is ``<comm 15><group 15>-<cgroup>-<cpu>-<pid>|<env>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_WIDTH = 15
HEADER = r"^([\s\S]{15})([\s\S]{15})-(\d+)-(\d+)-(-?\d+)\|([\s\S]*)$"
SYSTEM, KERNEL_GROUP = "SYSTEM", "[kernel]"
EXIT_TASK, ERR_COMM = "<exit task>", "<err read comm>"


def generate_metadata(comm: Column, group_comm: Column, cgroup_id: Column, cpu: Column, pid: Column, env: Column) -> Column:
    """The header; names are padded or cut to their width."""
    names = [F.rpad(c, NAME_WIDTH, " ") for c in (comm, group_comm)]
    numbers = [part for c in (cgroup_id, cpu, pid) for part in (F.lit("-"), c.cast("string"))]
    return F.concat(*names, *numbers, F.lit("|"), env)


def parse_metadata(raw: Column) -> Column:
    """Struct ``ok, comm, group_comm, cgroup_id, cpu, pid, env``; the fields are null if the header is malformed."""
    ok = raw.rlike(HEADER)

    def part(i: int) -> Column:
        return F.when(ok, F.regexp_extract(raw, HEADER, i))

    return F.struct(
        ok.alias("ok"),
        F.rtrim(part(1)).alias("comm"),
        F.rtrim(part(2)).alias("group_comm"),
        part(3).try_cast("decimal(20,0)").alias("cgroup_id"),
        part(4).try_cast("int").alias("cpu"),
        part(5).try_cast("bigint").alias("pid"),
        part(6).alias("env"),
    )


def select_env(environ: Column, keys: list[str], is_kthread: Column | None = None, separator: str = "\0") -> Column:
    """Value of the first entry, in environ order, whose key is listed; ``SYSTEM`` otherwise and for kernel threads."""
    entries = F.filter(F.split(environ, separator), lambda e: F.split(e, "=", 2)[0].isin(keys) & e.contains("="))
    found = F.coalesce(F.get(F.split(F.get(entries, F.lit(0)), "=", 2), F.lit(1)), F.lit(SYSTEM)) if keys else F.lit(SYSTEM)
    return found if is_kthread is None else F.when(is_kthread, F.lit(SYSTEM)).otherwise(found)


def process_name(name: Column, readable: Column | None = None) -> Column:
    """The name of a process; a marker where it has ended, another where its name cannot be read."""
    ended = F.coalesce(name, F.lit(EXIT_TASK))
    return ended if readable is None else F.when(readable, ended).otherwise(F.lit(ERR_COMM))


def group_name(group_comm: Column, is_kthread: Column) -> Column:
    return F.when(is_kthread, F.lit(KERNEL_GROUP)).otherwise(group_comm)


def looks_like_kthread(pid: Column, name: Column) -> Column:
    """The perf rule: pid 0, or a name in brackets."""
    return (pid == 0) | name.startswith("[")


def should_unwind_user(env: Column, kernel_only: bool, values: list[str]) -> Column:
    return env.isin(values) if kernel_only else F.lit(True)


def export_labels(env: bool = True, group: bool = True, pid: bool = False, thread: bool = False, raw: Column | None = None) -> Column:
    """Labels before the frames: env, then ``group:pid`` or ``group``, then the thread name; or the raw header alone."""
    if raw is not None:
        return F.array(raw)
    parts = [F.col("env")] if env else []
    if group:
        parts.append(F.concat("group_comm", F.lit(":"), F.col("pid").cast("string")) if pid else F.col("group_comm"))
    if thread:
        parts.append(F.col("comm"))
    return F.array(*parts) if parts else F.array().cast("array<string>")


def viewer_labels(env: bool = False, cgroup: bool = False, cpu: bool = False, group: bool = False, pid: bool = False, comm: bool = False) -> Column:
    """Labels in viewer order: env, ``CGID n``, ``CPU %4d``, then ``group:pid``, the pid alone, or (with the name but no pid) the thread's name; ``comm`` adds the thread's name once more."""
    parts = [F.col("env")] if env else []
    if cgroup:
        parts.append(F.concat(F.lit("CGID "), F.col("cgroup_id").cast("string")))
    if cpu:
        parts.append(F.format_string("CPU %4d", F.col("cpu")))
    if group and pid:
        parts.append(F.concat("group_comm", F.lit(":"), F.col("pid").cast("string")))
    elif pid:
        parts.append(F.col("pid").cast("string"))
    elif group:
        parts.append(F.col("comm"))
    if comm:
        parts.append(F.col("comm"))
    return F.array(*parts) if parts else F.array().cast("array<string>")
