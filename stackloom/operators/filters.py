"""Filters on decoded stacks and on raw samples."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from stackloom.functions.cpuset import parse_cpu_set

#: Filter kinds of the viewer and the columns they test; a name with ``v`` excludes.
KINDS = {"pid": "pid", "cpu": "cpu", "pod": "env", "comm": "group_comm", "cgid": "cgroup_id"}


@dataclass
class ViewerFilter:
    """Include and exclude filters; all must hold."""

    tests: list[tuple[str, list]] = field(default_factory=list)

    def set(self, command: str) -> ViewerFilter:
        """``pid 42``, ``cpuv 0-3``, ...: an empty argument or an unknown kind is an error."""
        kind, _, argument = command.strip().partition(" ")
        argument = argument.strip()
        name = kind.removesuffix("v")
        if name not in KINDS or not argument:
            raise ValueError(f"bad filter: {command!r}")
        values: list = sorted(parse_cpu_set(argument) or ()) if name == "cpu" else [int(argument)] if name in ("pid", "cgid") else [argument]
        return ViewerFilter([*self.tests, (kind, values)])

    def unset(self, kind: str) -> ViewerFilter:
        return ViewerFilter([t for t in self.tests if t[0] != kind])

    def condition(self) -> Column:
        out = F.lit(True)
        for kind, values in self.tests:
            test = F.col(KINDS[kind.removesuffix("v")]).isin(values)
            out = out & (~test if kind.endswith("v") else test)
        return out


def export_filter(cgroup: int = 0, cpus: set[int] | None = None, comm: str | None = None, pid: int = 0, env: str | None = None) -> Column:
    """The export's targets: 0 or None means no filter, comm is a prefix of the group name."""
    out = F.lit(True)
    if cgroup:
        out = out & (F.col("cgroup_id") == cgroup)
    if cpus is not None:
        out = out & F.col("cpu").isin(sorted(cpus))
    if comm:
        out = out & F.col("group_comm").startswith(comm)
    if pid:
        out = out & (F.col("pid") == pid)
    if env:
        out = out & (F.col("env") == env)
    return out


def unparseable_policy(meta_ok: Column, condition: Column, mode: str) -> Column:
    """Rows with a malformed header: ``export`` keeps them unfiltered, ``tree`` drops them, ``curve`` keeps them."""
    return F.when(meta_ok, condition).otherwise(F.lit(mode != "tree"))


def not_idle(pid: Column) -> Column:
    """Samples of the idle task, process 0, are skipped."""
    return pid != 0


def counted(count: Column) -> Column:
    """Entries without a count are skipped."""
    return count != 0


def capture_filter(pid: int = 0, comm: str = "", tid: str = "tid", tgid: str = "pid") -> Column:
    """Kept if neither is set, or the pid equals thread or process id, or the name is equal."""
    if not pid and not comm:
        return F.lit(True)
    out = F.lit(False)
    if pid:
        out = out | (F.col(tid) == pid) | (F.col(tgid) == pid)
    return out | (F.col("comm") == comm) if comm else out
