"""Frame and symbol text, as column functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stackloom.functions import itanium

KERNEL_MARK = "_[k]"
MARKER = r"^<#.*#>$"
LOST_STRING = "<# STRMAP LOST ID #>"
KERNEL_DROPPED = "kernel_drop_stack_[k]"
MAX_DEPTH = 127


def has_kernel(frames: Column) -> Column:
    """Whether any frame contains the kernel mark."""
    return F.exists(frames, lambda f: f.contains(KERNEL_MARK))


def contains_ordered(frames: Column, names: list[str]) -> Column:
    """Whether the names occur as parts of frames, in order, gaps allowed."""
    wanted = F.array(*map(F.lit, names))
    seen = F.aggregate(frames, F.lit(0), lambda i, f: F.when((i < len(names)) & f.contains(F.coalesce(F.get(wanted, i), F.lit("\0"))), i + 1).otherwise(i))
    return seen == len(names)


def markers_are_roots(frames: Column) -> Column:
    """Whether no marker follows an ordinary frame."""
    start = F.struct(F.lit(True).alias("ok"), F.lit(False).alias("plain"))
    walked = F.aggregate(frames, start, lambda a, f: F.struct((a["ok"] & ~(a["plain"] & f.rlike(MARKER))).alias("ok"), (a["plain"] | ~f.rlike(MARKER)).alias("plain")))
    return walked["ok"]


def without_hash(frames: Column) -> Column:
    return F.filter(frames, lambda f: ~f.startswith("#"))


def collapse_hex(frame: Column) -> Column:
    """``0x56d20 [libc.so.6]`` to ``<...> [libc.so.6]``; other frames stay."""
    shape = r"^0x[0-9a-fA-F]+[^\[]*(\[[^\]]*\]).*$"
    return F.when(F.trim(frame).rlike(shape), F.concat(F.lit("<...> "), F.regexp_extract(F.trim(frame), shape, 1))).otherwise(frame)


def collapse_irqoff(frame: Column) -> Column:
    """The CPU number of an IRQ-off marker to ``<...>``."""
    return F.regexp_replace(frame, r"^(<# IRQOFF SAMPLE ON CPU )[0-9]+", r"$1<...>")


def normalize_frame(frame: Column, hexes: bool = True, irqoff: bool = True) -> Column:
    """Trimmed, then the first of the two rules that applies; each can be turned off."""
    trimmed = F.trim(frame)
    changed = collapse_hex(trimmed) if hexes else trimmed
    return F.when(changed != trimmed, changed).otherwise(collapse_irqoff(trimmed) if irqoff else trimmed)


def render_user_frame(pc: Column, symbol: Column, module: Column, show_path: Column) -> Column:
    """``sym``, ``sym [path]``, ``0xpc [module]`` or ``0xpc [anon exec segment]``; a path is cut after the first ``/root``."""
    path = cut_root(module)
    address = F.concat(F.lit("0x"), F.lower(F.hex(pc)))
    known = F.when(show_path & module.isNotNull(), F.concat(symbol, F.lit(" ["), path, F.lit("]"))).otherwise(symbol)
    unknown = F.concat(address, F.lit(" ["), F.coalesce(F.element_at(F.split(module, "/"), -1), F.lit("anon exec segment")), F.lit("]"))
    return F.when(symbol.isNotNull(), known).otherwise(unknown)


def cut_root(path: Column) -> Column:
    at = F.instr(path, "/root")
    return F.when(at > 0, F.substr(path, at + 5)).otherwise(path)


#: Why unwinding stopped, where a stack shows it, and a kernel address that stands for a frame already restored (fixed values).
STOP_REASONS = {"process_exit": "<# PROCESS EXIT #>", "language": "<# DROP BY LANG TYPE #>"}
RESTORED = "<#ALREADY RESTORE#>"


def sample_markers(pressure: Column, is_irqoff: Column, cpu: Column, is_offcpu: Column, state: Column) -> Column:
    """The markers between a stack's header and its frames, in order: load shedding (``full``, ``high`` or null), IRQ-off, off-CPU with the thread's state."""
    shed = F.when(pressure == "full", F.lit("<# PRESSURE FULL DROP SAMPLE #>")).when(pressure == "high", F.lit("<# PRESSURE HIGH DROP SAMPLE #>"))
    irqoff = F.when(is_irqoff, F.concat(F.lit("<# IRQOFF SAMPLE ON CPU "), cpu.cast("string"), F.lit(" #>")))
    offcpu = F.when(is_offcpu, F.concat(F.lit("<# OFFCPU SAMPLE: ("), state, F.lit(") #>")))
    return F.array_compact(F.array(shed, irqoff, offcpu))


def user_part(user: Column, unwinds_user: Column, stop_reason: Column) -> Column:
    """Leaf-first user frames with the reason that unwinding stopped, if a stack shows it; none of kernel threads, shed samples and pods that are not unwound."""
    shown = F.create_map(*[F.lit(x) for pair in STOP_REASONS.items() for x in pair])
    reason = F.array_compact(F.array(F.try_element_at(shown, stop_reason)))
    return F.when(unwinds_user, F.concat(user, reason)).otherwise(F.array().cast("array<string>"))


def assemble_stack(meta: Column, markers: Column, user: Column, kernel: Column, kernel_mode: Column) -> Column:
    """Header, markers, user and kernel frames root-first; in kernel mode without frames a drop marker stands for the kernel part."""
    kernel = F.slice(kernel, 1, MAX_DEPTH)
    tail = F.when(kernel_mode & (F.size(kernel) == 0), F.array(F.lit(KERNEL_DROPPED))).otherwise(F.reverse(kernel))
    return F.concat(F.array(meta), markers, F.reverse(user), tail)


def parse_procstack(text: Column) -> Column:
    """Per line the part after the first token, lines reversed."""
    lines = F.filter(F.split(text, "\n"), lambda l: l != "")
    return F.reverse(F.transform(lines, lambda l: F.regexp_replace(l, r"^\S+\s", "")))


def hex_to_binary(text: Column) -> Column:
    return F.when(text.rlike("^([0-9a-fA-F]{2})+$"), F.unhex(text))


def list_argument(text: Column) -> Column:
    return F.filter(F.split(text, ","), lambda p: p != "")


def null_default(value: Column) -> Column:
    return F.nullif(value, F.lit("null"))


def strip_safe(text: str) -> str:
    """Without ``<...>`` at any depth; a text without balanced brackets stays."""
    depth, out = 0, []
    for c in text:
        if c == "<":
            depth += 1
        elif c == ">":
            if not depth:
                return text
            depth -= 1
        elif not depth:
            out.append(c)
    return text if depth else "".join(out)


@F.pandas_udf(StringType())
def strip_deep(texts: pd.Series) -> pd.Series:
    return texts.map(strip_safe, na_action="ignore")


def strip_templates(text: Column, depth: int = 4) -> Column:
    """Removes ``<...>`` if balanced, else keeps the text.

    Innermost pairs go first, ``depth`` times, in the JVM; only texts that still have brackets go
    through the counter of :func:`strip_safe`.
    """
    out = text
    for _ in range(depth):
        out = F.regexp_replace(out, r"<[^<>]*>", "")
    rest = out.contains("<") | out.contains(">")
    return F.when(rest, strip_deep(F.when(rest, text))).otherwise(out)


def strip_plain(text: str) -> str:
    depth, out = 0, []
    for c in text:
        if c == "<":
            depth += 1
        elif c == ">" and depth:
            depth -= 1
        elif not depth:
            out.append(c)
    return "".join(out)


@F.pandas_udf(StringType())
def strip_templates_plain(texts: pd.Series) -> pd.Series:
    """The export's form: a depth counter and no balance check."""
    return texts.map(strip_plain, na_action="ignore")


def demangle_name(symbol: str) -> str:
    """The C++ name at the start of ``symbol`` without parameters and template arguments, the rest kept; what is no such name stays unchanged."""
    token = re.match(r"[A-Za-z0-9_.$]*", symbol)[0]
    name = itanium.name_of(token)
    return symbol if name is None else strip_safe(name) + symbol[len(token) :]


@F.pandas_udf(StringType())
def demangle(symbols: pd.Series) -> pd.Series:
    """For distinct dictionary strings, never for facts."""
    return symbols.map(demangle_name, na_action="ignore")
