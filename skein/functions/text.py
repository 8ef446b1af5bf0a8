"""Text expressions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import fixed as K


def mark(*parts: Column | str) -> Column:
    """An elision marker around the given parts."""
    return F.concat(F.lit(K.MARK + " "), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts), F.lit("]"))


def any_of(line: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (line.rlike(p) for p in patterns))


def units(text: Column) -> Column:
    """UTF-16 code units of a text."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def bare(text: Column) -> Column:
    """Without white space at the ends, Unicode spaces included."""
    return F.regexp_replace(text, r"^[\s ﻿  　]+|[\s ﻿  　]+\z", "")


def unix_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def chomp(text: Column) -> Column:
    """Without newlines at the end."""
    return F.regexp_replace(text, r"\n+\z", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, K.ANSI_ESCAPE, ""), K.ANSI_LITERAL, "")


def solid_lines(text: Column) -> Column:
    """Lines with something on them, after escapes and trailing newlines are gone."""
    return F.filter(lines(chomp(unix_newlines(strip_ansi(text)))), lambda x: bare(x) != "")


def is_progress(line: Column, build: bool = False) -> Column:
    shown = bare(line)
    noise = any_of(shown, K.PROGRESS + ((K.BUILD_PROGRESS,) if build else ()))
    return (shown != "") & ~shown.contains("100%") & noise


def strip_progress(text: Column, build: bool = False) -> Column:
    """Progress lines out; of overwritten lines the last state stays; one marker with the count."""
    shown = F.transform(lines(unix_newlines(text)), lambda x: F.element_at(F.split(x, K.CARRIAGE, -1), -1))
    kept = F.filter(shown, lambda x: ~is_progress(x, build))
    omitted = F.size(shown) - F.size(kept)
    body = chomp(F.array_join(kept, "\n"))
    joint = F.when(body == "", F.lit("")).otherwise(F.lit("\n"))
    # a text of empty lines only has no body, yet a marker still stands alone
    return F.when(omitted > 0, F.concat(body, joint, mark(omitted, " progress lines omitted"))).otherwise(body)


def fingerprint(line: Column) -> Column:
    return bare(reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), K.FINGERPRINT, line))


def has_failure(text: Column) -> Column:
    shown = strip_ansi(F.coalesce(text, F.lit("")))
    return shown.rlike(K.FAILURE)


def is_test_output(text: Column) -> Column:
    ls = lines(unix_newlines(text))
    signals = F.size(F.array_distinct(F.filter(ls, lambda x: x.rlike(K.TEST_SIGNAL))))
    return (signals >= 2) | ((signals == 1) & F.exists(ls, lambda x: x.rlike(K.TEST_SUMMARY)))


def is_passing(line: Column) -> Column:
    return line.rlike(K.PASS_WORD) & ~line.rlike(K.FAIL_LINE)


def has_fail_line(text: Column) -> Column:
    return F.exists(lines(unix_newlines(text)), lambda x: x.rlike(K.FAIL_LINE))


def passing_summary(text: Column) -> Column:
    """Summary lines of a passing test run with a count of the rest; unchanged without any."""
    ls = lines(unix_newlines(text))
    kept = F.filter(ls, lambda x: x.rlike(K.SUMMARY_KEPT) & ~is_passing(x))
    omitted = F.size(ls) - F.size(kept)
    out = F.when(omitted > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n"), mark(omitted, " passing test lines omitted"))).otherwise(chomp(F.array_join(kept, "\n")))
    return F.when((F.size(kept) == 0) | (out == ""), text).otherwise(out)


def head_tail(text: Column, max_chars: int = K.MAX_CHARS, head: int = K.HEAD_LINES, tail: int = K.TAIL_LINES) -> Column:
    """First and last lines of a long text, with the important lines between them."""
    ls = lines(unix_newlines(text))
    middle = F.slice(ls, F.lit(head + 1), F.greatest(F.size(ls) - head - tail, F.lit(0)))
    important = F.filter(middle, lambda x: x.rlike(K.IMPORTANT))
    notes = F.when(F.size(important) > 0, F.concat(F.array(mark("important omitted lines")), important)).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.slice(ls, F.lit(1), F.lit(head)), F.array(mark(F.size(middle), " lines omitted")), notes, F.slice(ls, F.size(ls) - tail + 1, F.lit(tail)))
    return F.when((units(text) > max_chars) & (F.size(ls) > head + tail), chomp(F.array_join(parts, "\n"))).otherwise(text)


def half_up(x: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x + F.lit(0.5)).cast("long")


def est_tokens(saved: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), half_up(saved / F.lit(K.CHARS_PER_TOKEN)))


def cost_usd(tokens: Column) -> Column:
    return tokens / F.lit(1e6) * F.lit(K.USD_PER_MILLION_TOKENS)


def one_decimal(n: Column, unit: int) -> Column:
    """n / unit as C's %.1f writes it, for whole n >= 0: the nearest tenth of the double, of two as near the even one.

    Java's %.1f rounds the shortest decimal form of the double instead, halves up.
    """
    n = n.cast("long")
    rest = n % unit * 20
    down = F.floor(n / F.lit(unit)) * 10 + F.floor(rest / F.lit(2 * unit))
    half = rest % (2 * unit)
    # on a half of the quotient the double may lie beside it: five times the double without rounding, less five times the half
    x = n / F.lit(float(unit))
    five = x * 4.0 + x
    beside = (five - (down * 2 + 1) / F.lit(4.0)) + (x - (five - x * 4.0))
    up = (half > unit) | ((half == unit) & ((beside > 0) | ((beside == 0) & (down % 2 == 1))))
    tenths = down + up.cast("long")
    return F.concat(F.floor(tenths / F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def human_size(n: Column) -> Column:
    return F.when(n >= 1048576, F.concat(one_decimal(n, 1048576), F.lit("MB"))).when(n >= 1024, F.concat(one_decimal(n, 1024), F.lit("KB"))).otherwise(F.concat(n.cast("string"), F.lit("B")))


def session_id(x: Column) -> Column:
    cleaned = F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9_-]", "")
    return F.when(cleaned == "", F.lit("unknown")).otherwise(cleaned)


def project_slug(path: Column) -> Column:
    return F.regexp_replace(path, "[^A-Za-z0-9]", "-")


def dirname(path: Column) -> Column:
    cut = F.regexp_replace(path, "/+[^/]*/*$", "")
    return F.when(~path.contains("/"), F.lit(".")).when(cut == "", F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("."))).otherwise(cut)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def reduction_percent(n_in: Column, n_out: Column) -> Column:
    """Percent saved, at least 0, to one decimal."""
    share = F.when(n_in == 0, F.lit(0.0)).otherwise((n_in - n_out) / n_in * 100)
    return F.floor(F.greatest(share, F.lit(0.0)) * 10 + 0.5) / 10


def poor_ratio(n_in: Column, n_out: Column) -> Column:
    """Whether less than a tenth is saved (integers only)."""
    return (n_in == 0) | (n_out * 10 > n_in * 9)


def run_starts(items: Column, key: str) -> Column:
    """(at, n) of each run of structs with equal ``key`` in an array, in one pass over it.

    A null key stands alone.  Neighbours meet by zipping the array with itself,
    as a look-up of the array inside a lambda would make it anew for each element.
    """
    none = F.transform(F.slice(items, F.lit(1), F.lit(1)), lambda x: F.lit(None).cast("string"))
    last = F.concat(none, F.transform(F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), lambda x: x[key]))
    new = F.zip_with(F.transform(items, lambda x, i: F.struct(i.alias("at"), x[key].alias("key"))), last, lambda a, b: F.when(a["key"].isNull() | (a["at"] == 0) | ~a["key"].eqNullSafe(b), a["at"]))
    starts = F.array_compact(new)
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(items)))
    return F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), (b - a).alias("n"))), lambda r: r["at"].isNotNull())
