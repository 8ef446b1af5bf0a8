"""Ordered folds over the lines of a text that no window can state, in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, dropwhile, groupby, islice
from itertools import chain as chain_
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructType

from skein.functions import fixed as K

_FINGERPRINT = [(re.compile(p, re.A), r) for p, r in K.FINGERPRINT]
_WORDS = re.compile(r"\w+")
_SUMMARY, _FAIL, _PASS = (re.compile(p, re.A) for p in (K.SUMMARY_KEPT, K.FAIL_LINE, K.PASS_WORD))
_BANNER, _RESULT, _FAIL_HEAD = (re.compile(p, re.A) for p in (K.FAILURES_BANNER, K.RESULT_BANNER, K.FAIL_HEAD))
_HEADING, _TSC, _TSC_RULE, _STYLISH, _CONCISE = (re.compile(p, re.A) for p in (K.LINT_HEADING, K.LINT_TSC, K.LINT_TSC_RULE, K.LINT_STYLISH, K.LINT_CONCISE))
_SIGNAL, _RUN_SUMMARY = (re.compile(p, re.A) for p in (K.TEST_SIGNAL, K.TEST_SUMMARY))
_LIVE, _META = re.compile(K.DIFF_LIVE), re.compile(K.DIFF_META)
_TRACE_START, _TRACE_END, _FRAME, _BODY = (re.compile(p, re.A) for p in (K.TRACE_START, K.TRACE_END, K.FRAME, K.FRAME_BODY))


def fingerprint(line: str) -> str:
    for pattern, to in _FINGERPRINT:
        line = pattern.sub(to, line)
    return line.strip()


def alike(anchor: str, line: str) -> bool:
    """A common start of 16 UTF-16 units, or three fifths of the words in common."""
    if min(len(anchor), len(line)) >= K.PREFIX_UNITS and anchor[: K.PREFIX_UNITS] == line[: K.PREFIX_UNITS]:
        return True
    if anchor.encode("utf-16-le", "surrogatepass")[: 2 * K.PREFIX_UNITS] == line.encode("utf-16-le", "surrogatepass")[: 2 * K.PREFIX_UNITS] and len(anchor.encode("utf-16-le", "surrogatepass")) >= 2 * K.PREFIX_UNITS:
        return True
    a, b = _WORDS.findall(anchor), _WORDS.findall(line)
    if not a or not b:
        return False
    known = set(b)
    return 10 * sum(w in known for w in a) >= 6 * max(len(a), len(b))


def each_line(text: str, most: int = 1 << 20) -> Iterator[str]:
    """Lines of a text, cut out a stretch of it at a time: all at once take many times its size."""
    at = 0
    while (end := text.find("\n", at + most)) >= 0:
        yield from text[at:end].split("\n")
        at = end + 1
    yield from text[at:].split("\n")


def joined_lines(ls: Iterator[str], most: int = 10_000) -> str:
    """Lines joined by newlines, in stretches first."""
    return "\n".join(map("\n".join, iter(lambda: list(islice(ls, most)), [])))


def runs(ls: Iterable[str]) -> Iterator[tuple[bool, list[str]]]:
    """(collapsible, lines): maximal runs of lines alike to their first one; blank lines stand alone."""
    held: list[str] = []
    key = ""
    for line in ls:
        print_ = fingerprint(line)
        if held and print_ and print_ == key and alike(held[0], line):
            held.append(line)
            continue
        if held:
            yield True, held
        held, key = ([line], print_) if print_ else ([], "")
        if not print_:
            yield False, [line]
    if held:
        yield True, held


def collapse_runs(text: str) -> str:
    shown = ([run[0], f"{K.MARK} {len(run) - 1} more similar lines collapsed]"] if foldable and len(run) >= K.RUN_MIN else run for foldable, run in runs(each_line(text.replace("\r\n", "\n"))))
    return joined_lines(chain_.from_iterable(shown)).rstrip("\n")


#: What a line's class does to the two things that outlast it: an open failures section, and an open failure's indented lines.
SECTION = {"banner": True, "result": False}
INSET = {"head": True, "blank": False, "plain": False}


def line_class(line: str) -> str:
    """banner, result or head by what a line says, else blank, inset or plain by how it begins."""
    for name, pattern in (("banner", _BANNER), ("result", _RESULT), ("head", _FAIL_HEAD)):
        if pattern.search(line):
            return name
    return "blank" if not line.strip() else "inset" if line[0].isspace() else "plain"


def before(classes: list[str], sets: dict[str, bool], first: bool) -> list[bool]:
    """For each place, and the end, what the last class before it that sets anything has set."""
    return list(accumulate(classes, lambda on, c: sets.get(c, on), initial=first))


def is_summary(line: str) -> bool:
    return bool(_SUMMARY.search(line)) and not (_PASS.search(line) and not _FAIL.search(line))


def failing_lines(ls: list[str], section: bool = False, inset: bool = False) -> list[str]:
    """Lines of a failing test run that stay: failures and their sections, and summary lines."""
    classes = [line_class(x) for x in ls]
    opened = zip(ls, classes, before(classes, SECTION, section), before(classes, INSET, inset))
    return [x for x, c, in_section, in_failure in opened if c in ("banner", "result", "head") or in_section or (in_failure and c in ("blank", "inset")) or is_summary(x)]


def failing_summary(text: str) -> str:
    """Failure blocks and summary lines of a failing test run, with a count of the rest."""
    ls = text.replace("\r\n", "\n").split("\n")
    kept = failing_lines(ls)
    if len(kept) < len(ls):
        kept.append(f"{K.MARK} {len(ls) - len(kept)} test runner lines omitted]")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).rstrip("\n") or text


def traces(ls: Iterable[str]) -> Iterator[tuple[bool, list[str]]]:
    """(is a trace, lines): a trace runs from its start through the first line that names an error."""
    rest = iter(ls)
    for line in rest:
        if not _TRACE_START.search(line):
            yield False, [line]
            continue
        trace = [line]
        for more in rest:
            trace.append(more)
            if _TRACE_END.search(more):
                break
        yield True, trace


def frames(trace: list[str]) -> list[str]:
    """A trace with adjacent equal frames folded into the first and a count."""
    units: list[tuple[bool, tuple[str, ...]]] = []
    k = 0
    while k < len(trace):
        if _FRAME.search(trace[k]):
            size = 2 if k + 1 < len(trace) and _BODY.search(trace[k + 1]) else 1
            units.append((True, tuple(trace[k : k + size])))
            k += size
        else:
            units.append((False, (trace[k],)))
            k += 1
    out: list[str] = []
    for (is_frame, lines), same in groupby(units):
        n = sum(1 for _ in same)
        out += lines if is_frame else lines * n
        if is_frame and n > 1:
            out.append(f"{K.MARK} {n} repeated frames]")
    return out


def dedup_traces(text: str) -> str:
    text = text.replace("\r\n", "\n")
    count = Counter(tuple(part) for is_trace, part in traces(each_line(text)) if is_trace)

    def shown() -> Iterator[list[str]]:
        done: set[tuple[str, ...]] = set()
        for is_trace, part in traces(each_line(text)):
            if not is_trace:
                yield part
            elif tuple(part) not in done:
                done.add(tuple(part))
                yield frames(part)
                if count[tuple(part)] > 1:
                    yield [f"{K.MARK} stack trace repeated {count[tuple(part)]} times]"]

    return joined_lines(chain_.from_iterable(shown())).rstrip("\n")


def folded_context(run: list[str]) -> list[str]:
    """A stretch of context with its middle counted where it is long."""
    shown = K.CONTEXT_SHOWN
    if len(run) <= 2 * shown:
        return run
    return [*run[:shown], f"... {K.MARK} {len(run) - 2 * shown} unchanged context lines omitted]", *run[-shown:]]


def diff_context(text: str) -> str:
    """A diff without reproducible metadata and with long stretches of context folded."""
    stretches = groupby(each_line(text.replace("\r\n", "\n").rstrip("\n")), key=lambda x: bool(_LIVE.search(x)))
    return joined_lines(chain_.from_iterable(part if live else folded_context(list(dropwhile(_META.search, part))) for live, part in stretches))


class Diagnostic(NamedTuple):
    """A linter's report on one place, with the heading it stands under."""

    heading: str
    owner: str
    rule: str
    message: str
    line: str

    @property
    def kind(self) -> tuple[str, str, str]:
        return self.owner, self.rule, self.message


def diagnostics(text: str) -> Iterator[Diagnostic]:
    """All diagnostics of a linter's output in order, whichever of three forms each has."""
    heading = ""
    for line in filter(str.strip, text.split("\n")):
        if _HEADING.search(line):
            heading = line
        elif m := _TSC.search(line):
            code = _TSC_RULE.search(m[4])
            yield Diagnostic(heading, m[1], code[1] if code else "diagnostic", m[4], line)
        elif m := _STYLISH.search(line):
            yield Diagnostic(heading, heading, m[4], m[3], line)
        elif m := _CONCISE.search(line):
            yield Diagnostic(heading, m[1], m[4], m[5], line)


def lint_summary(text: str) -> str | None:
    """Diagnostics, the first few of each kind, under their file headings, with counts of the rest."""
    found = list(diagnostics(text))
    nth: Counter[tuple[str, str, str]] = Counter()
    shown = []
    for d in found:
        nth[d.kind] += 1
        if nth[d.kind] <= K.DIAGNOSTIC_SHOWN:
            shown.append(d)
    out: list[str] = []
    last = ""
    for heading, same in groupby(shown, key=lambda d: d.heading):
        out += [heading] if heading and heading != last else []
        last = heading or last
        out += [d.line for d in same]
    first = {d.kind: d for d in reversed(found)}
    for kind in dict.fromkeys(d.kind for d in found):
        if (more := nth[kind] - K.DIAGNOSTIC_SHOWN) > 0:
            where = f" for {first[kind].heading}" if first[kind].heading else ""
            out.append(f"... {K.MARK} {more} identical diagnostics omitted{where} ({kind[1]})]")
    return "\n".join(out) or None


def passing_summary(ls: list[str]) -> str | None:
    """Summary lines of a passing test run with a count of the rest; None without any."""
    kept = [x for x in ls if is_summary(x)]
    more = len(ls) - len(kept)
    return "\n".join([*kept, f"{K.MARK} {more} passing test lines omitted]"] if more else kept).rstrip("\n") or None if kept else None


def _matches(pattern: re.Pattern) -> Callable[[str], bool]:
    return lambda line: pattern.search(line) is not None


is_signal, is_run_summary, is_failure, is_live, is_meta = map(_matches, (_SIGNAL, _RUN_SUMMARY, _FAIL, _LIVE, _META))
starts_trace, ends_trace, is_frame, is_body = map(_matches, (_TRACE_START, _TRACE_END, _FRAME, _BODY))


def is_test_output(text: str) -> bool:
    signals = set(filter(is_signal, each_line(text)))
    return len(signals) > 1 or bool(signals) and any(map(is_run_summary, each_line(text)))


def chain(text: str) -> tuple[str, bool, bool, bool]:
    """(text, whether runs were collapsed, a test run was summarised, traces were folded): the folds in their order, in one pass to Python."""
    collapsed = collapse_runs(text)
    summed = collapsed
    unix = collapsed.replace("\r\n", "\n")
    if is_test_output(unix):
        ls = unix.split("\n")
        summed = failing_summary(collapsed) if any(map(_FAIL.search, ls)) else passing_summary(ls) or collapsed
    out = dedup_traces(summed)
    # a summary of a test run that dropped the folded runs takes their rule with it
    gone = summed != collapsed and "more similar lines collapsed]" not in summed
    return out, collapsed != text and not gone, summed != collapsed, out != summed


@F.pandas_udf(StructType().add("text", StringType()).add("collapsed", BooleanType()).add("summed", BooleanType()).add("traced", BooleanType()))
def chained(batch: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None, None) if x is None else chain(x) for x in batch]
    return pd.DataFrame({name: pd.Series([r[k] for r in rows], dtype=object) for k, name in enumerate(("text", "collapsed", "summed", "traced"))})


def text_udf(fold: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """An Arrow-batched string expression of a fold; null stays null."""

    @F.pandas_udf(StringType())
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else fold(x))

    return run
