"""Folds over texts of any size, as blocks of lines.

A block is a row (id, seq, text) whose text is whole lines, each ended by a
newline; the blocks of an id, by seq, are its text.  No task holds a text, and no
id's blocks need to meet in one task:

* Where the state of a fold is the last of a few things said before (open test
  sections, blank lines so far), each block states what it leaves behind, a
  window over these small rows gives what each block begins with, and all blocks
  are then folded at once (``failing_blocks``, ``squeezed``, ``chomped``).
* Where the state is a line (runs alike to their first one, traces, context), a
  block is cut before its first line that no earlier line has a say in.  What
  lies between two such cuts is a segment; segments go to tasks by their own key
  and pass through in order, a block at a time, with a few lines held
  (``collapsed_blocks``, ``trace_blocks``, ``diff_blocks``).  A segment is as
  long as the stretch that depends on its beginning, such as a stretch of lines
  with one fingerprint.

Blocks without lines are left out; a null text has no blocks.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from skein.functions import fixed as K
from skein.functions import folds
from skein.functions import text as T
from skein.sources.tables import bounded_batches, stored

BROADCAST_BLOCKS = 1_000_000  # small rows, one for a block; more of them are joined by a shuffle
BLOCK_LINES = 100_000
KINDS = {StringType: pa.string(), BooleanType: pa.bool_(), LongType: pa.int64()}
TEXT = StructField("text", StringType())
PIECE_CHARS = 1 << 20  # of a trace that is held before a piece of it goes on


def blocks(df: DataFrame, lines: int = BLOCK_LINES, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, seq, text) from whole texts, ``lines`` lines to a block."""
    ls = F.split(F.regexp_replace(text_col, "\r\n", "\n"), "\n", -1)
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / lines).cast("int")), lambda k: F.concat(F.array_join(F.slice("ls", k * lines + 1, lines), "\n"), F.lit("\n")))
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), ls.alias("ls"))
    return rows.select("id", F.posexplode(cut).alias("seq", "text")).select("id", F.col("seq").cast("long").alias("seq"), "text")


def whole(rows: DataFrame) -> DataFrame:
    """(id, text): blocks joined, without newlines at the end.  For texts that fit in a row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return rows.groupBy("id").agg(T.chomp(F.array_join(parts, "")).alias("text"))


def split_lines(text: str) -> list[str]:
    """Lines of a block."""
    return text.replace("\r\n", "\n")[:-1].split("\n") if text else []


def ended(lines: list[str]) -> str:
    """A block's text from its lines."""
    return "\n".join(lines) + "\n" if lines else ""


def _mapped(rows: DataFrame, f: Callable[..., tuple], fields: list[StructField], *more: str) -> DataFrame:
    """(id, seq, what ``f`` gives for the text and ``more`` columns) of each block, in Arrow batches bounded by bytes."""
    bounded_batches(rows.sparkSession)
    schema = StructType([rows.schema["id"], StructField("seq", LongType()), *fields])
    kinds = [KINDS[type(x.dataType)] for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(zip(*map(f, *(c.to_pylist() for c in b.columns[2:])))) or [()] * len(kinds)
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(v, t) for v, t in zip(got, kinds))], schema.names)

    return rows.select("id", F.col("seq").cast("long").alias("seq"), "text", *more).mapInArrow(run, schema)


def _met(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Blocks with the small rows of the same (id, seq)."""
    return rows.join(F.broadcast(small) if small.count() <= BROADCAST_BLOCKS else small, ["id", "seq"])


def _order():
    """An id's blocks in order; only small rows pass through such a window."""
    return Window.partitionBy("id").orderBy("seq")


def _before():
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def _last(classes: list[str], sets: dict[str, bool]) -> bool | None:
    return next((sets[c] for c in reversed(classes) if c in sets), None)


def _test_facts(text: str) -> tuple:
    """What a block says of a test run: state left behind, two different signals, a run's summary, a failure."""
    ls = split_lines(text)
    classes = [folds.line_class(x) for x in ls]
    signals = list(dict.fromkeys(x for x in ls if folds.is_signal(x)))[:2]
    return (_last(classes, folds.SECTION), _last(classes, folds.INSET), *(signals + [None, None])[:2], any(map(folds.is_run_summary, ls)), any(map(folds.is_failure, ls)))


_TEST_FACTS = [StructField("section", BooleanType()), StructField("inset", BooleanType()), StructField("one", StringType()), StructField("two", StringType()), StructField("summary", BooleanType()), StructField("failure", BooleanType())]


def test_kind(rows: DataFrame) -> DataFrame:
    """(id, seq, section, inset, kind) of each block: what is open where it begins, and whether its text is a passing or failing test run."""
    facts = _mapped(rows, _test_facts, _TEST_FACTS)
    said = facts.select("id", "summary", "failure", F.explode_outer(F.array_compact(F.array("one", "two"))).alias("signal"))
    texts = said.groupBy("id").agg(F.count_distinct("signal").alias("n"), F.bool_or("summary").alias("summary"), F.bool_or("failure").alias("failure"))
    is_run = (F.col("n") > 1) | ((F.col("n") == 1) & F.col("summary"))
    texts = texts.select("id", F.when(is_run, F.when(F.col("failure"), "failing").otherwise("passing")).alias("kind"))
    begun = lambda c: F.coalesce(F.last(c, True).over(_before()), F.lit(False)).alias(c)
    return facts.select("id", "seq", begun("section"), begun("inset")).join(texts, "id")


def _with_count(kept: DataFrame, words: str) -> DataFrame:
    """Blocks with a last one that counts the lines left out (``gone``), if any are."""
    gone = kept.groupBy("id").agg(F.sum("gone").alias("gone"), (F.max("seq") + 1).alias("seq")).where("gone > 0")
    last = gone.select("id", "seq", F.concat(T.mark(F.col("gone"), words), F.lit("\n")).alias("text"))
    return kept.select("id", "seq", "text").where("text <> ''").unionByName(last)


def failing_blocks(rows: DataFrame, begun: DataFrame | None = None) -> DataFrame:
    """Failure blocks and summary lines of failing test runs, with a count of the rest.

    ``begun`` (id, seq, section, inset) is what is open where a block begins, if known.
    """
    begun = stored((test_kind(rows) if begun is None else begun).select("id", "seq", "section", "inset"), "begun")

    def f(text: str, section: bool, inset: bool) -> tuple:
        ls = split_lines(text)
        kept = folds.failing_lines(ls, section, inset)
        return ended(kept), len(ls) - len(kept)

    kept = stored(_mapped(_met(rows, begun), f, [TEXT, StructField("gone", LongType())], "section", "inset"), "failing")
    return chomped(squeezed(_with_count(kept, " test runner lines omitted")))


def passing_blocks(rows: DataFrame) -> DataFrame:
    """Summary lines of passing test runs with a count of the rest; texts without any stay as they are."""

    def f(text: str) -> tuple:
        ls = split_lines(text)
        kept = list(filter(folds.is_summary, ls))
        return ended(kept), len(ls) - len(kept), len(kept)

    kept = stored(_mapped(rows, f, [TEXT, StructField("gone", LongType()), StructField("n", LongType())]), "passing")
    told = kept.groupBy("id").agg(F.sum("n").alias("told")).where("told > 0").select("id")
    return chomped(_with_count(kept.join(told, "id", "left_semi"), " passing test lines omitted")).unionByName(rows.select("id", F.col("seq").cast("long").alias("seq"), "text").join(told, "id", "left_anti"))


def _blank_facts(text: str) -> tuple:
    """(blank lines at the end, whether there is nothing else)."""
    solid = text.rstrip("\n")
    return (len(text) - len(solid) - bool(solid), not solid)


_BLANK_FACTS = [StructField("blanks", LongType()), StructField("hollow", BooleanType())]


def squeezed(rows: DataFrame) -> DataFrame:
    """Of blank lines in a row one stays, at the beginning of a text two."""
    facts = _mapped(rows, _blank_facts, _BLANK_FACTS)
    solid = F.sum((~F.col("hollow")).cast("int"))
    facts = facts.withColumn("stretch", solid.over(_order()))
    facts = facts.withColumn("upto", F.sum("blanks").over(Window.partitionBy("id", "stretch").orderBy("seq")))
    begun = F.coalesce(F.lag("upto").over(_order()), F.lit(0)).alias("begun")
    begun_at = stored(facts.select("id", "seq", begun, (F.coalesce(F.lag("stretch").over(_order()), F.lit(0)) == 0).alias("first")), "blanks")

    def f(text: str, n: int, first: bool) -> tuple:
        out, limit = [], 2 if first else 1
        for line in split_lines(text):
            n, limit = (0, 1) if line else (n + 1, limit)
            if n <= limit:
                out.append(line)
        return (ended(out),)

    return _mapped(_met(rows, begun_at), f, [TEXT], "begun", "first").where("text <> ''")


def chomped(rows: DataFrame) -> DataFrame:
    """Texts without blank lines at their end."""
    ends = rows.groupBy("id").agg(F.max(F.when(T.chomp(F.col("text")) != "", F.col("seq"))).alias("end"))
    met = rows.join(ends, "id").where("seq <= end")
    return met.select("id", "seq", F.when(F.col("seq") == F.col("end"), F.concat(T.chomp(F.col("text")), F.lit("\n"))).otherwise(F.col("text")).alias("text"))


class Runs:
    """Runs of lines alike to their first one; few lines of a run are held, however long it is."""

    def __init__(self) -> None:
        self.held: list[str] = []
        self.key, self.n = "", 0

    @staticmethod
    def free(ls: list[str]) -> int | None:
        """The first line that begins something new whatever came before: a blank one, or one with another fingerprint than the line before."""
        last = None
        for k, line in enumerate(ls):
            key = folds.fingerprint(line)
            if not key or (last is not None and key != last):
                return k
            last = key
        return None

    def line(self, line: str) -> list[str]:
        key = folds.fingerprint(line)
        if self.n and key and key == self.key and folds.alike(self.held[0], line):
            self.n += 1
            if self.n < K.RUN_MIN:
                self.held.append(line)
            return []
        out = self.end()
        if not key:
            return [*out, line]
        self.held, self.key, self.n = [line], key, 1
        return out

    def end(self) -> list[str]:
        out = [self.held[0], f"{K.MARK} {self.n - 1} more similar lines collapsed]"] if self.n >= K.RUN_MIN else self.held
        self.held, self.n = [], 0
        return out


class Context:
    """Stretches of a diff's context with their middle counted."""

    def __init__(self) -> None:
        self.n = 0
        self.first: list[str] = []
        self.last: deque[str] = deque(maxlen=K.CONTEXT_SHOWN)

    @staticmethod
    def free(ls: list[str]) -> int | None:
        return next((k for k, x in enumerate(ls) if folds.is_live(x)), None)

    def line(self, line: str) -> list[str]:
        if folds.is_live(line):
            return [*self.end(), line]
        if not self.n and folds.is_meta(line):
            return []
        self.n += 1
        (self.first if self.n <= K.CONTEXT_SHOWN else self.last).append(line)
        return []

    def end(self) -> list[str]:
        more = self.n - 2 * K.CONTEXT_SHOWN
        out = [*self.first, *([f"... {K.MARK} {more} unchanged context lines omitted]"] if more > 0 else []), *self.last]
        self.n, self.first = 0, []
        self.last.clear()
        return out


class Piece(NamedTuple):
    """Output lines; of a trace also its number in the segment and, with its last piece, its digest."""

    lines: list[str]
    trace: int | None = None
    digest: str | None = None


class Traces:
    """Lines outside traces as they come; traces in pieces, adjacent equal frames folded, with a digest of all their lines."""

    def __init__(self) -> None:
        self.number, self.hash = 0, None
        self.out: list[str] = []
        self.size = 0
        self.frame: list[str] = []  # frame that may get a body line
        self.unit: tuple[str, ...] | None = None  # frame before it, with how often it came
        self.times = 0

    @staticmethod
    def free(ls: list[str]) -> int | None:
        """Behind a line that ends a trace and begins none, no trace is open."""
        return next((k + 1 for k, x in enumerate(ls[:-1]) if folds.ends_trace(x) and not folds.starts_trace(x)), None)

    def _unit(self, is_frame: bool, lines: list[str]) -> None:
        if is_frame and tuple(lines) == self.unit:
            self.times += 1
            return
        if self.unit is not None and self.times > 1:
            self._put(f"{K.MARK} {self.times} repeated frames]")
        self.unit, self.times = (tuple(lines), 1) if is_frame else (None, 0)
        for x in lines:
            self._put(x)

    def _put(self, line: str) -> None:
        self.out.append(line)
        self.size += len(line) + 1

    def _flush_frame(self) -> None:
        if self.frame:
            frame, self.frame = self.frame, []
            self._unit(True, frame)

    def _in_trace(self, line: str) -> None:
        self.hash.update(line.encode("utf-8", "surrogatepass") + b"\n")
        if self.frame and len(self.frame) == 1 and folds.is_body(line):
            # a body that is a frame by its form still belongs to the frame before it
            self.frame.append(line)
            self._flush_frame()
            return
        self._flush_frame()
        if folds.is_frame(line):
            self.frame = [line]
        else:
            self._unit(False, [line])

    def _close(self) -> Piece:
        self._flush_frame()
        if self.unit is not None and self.times > 1:
            self._put(f"{K.MARK} {self.times} repeated frames]")
        piece = Piece(self.out, self.number, self.hash.hexdigest())
        self.number += 1
        self.hash, self.out, self.size, self.unit, self.times = None, [], 0, None, 0
        return piece

    def line(self, line: str) -> list[Piece]:
        if self.hash is None:
            if not folds.starts_trace(line):
                return [Piece([line])]
            self.hash = hashlib.sha256()
            self._in_trace(line)
            return []
        self._in_trace(line)
        if folds.ends_trace(line):
            return [self._close()]
        if self.size > PIECE_CHARS:
            out, self.out, self.size = self.out, [], 0
            return [Piece(out, self.number)]
        return []

    def end(self) -> list[Piece]:
        return [self._close()] if self.hash is not None else []


def segments(rows: DataFrame, free: Callable[[list[str]], int | None]) -> DataFrame:
    """(id, segment, seq, text): blocks cut before their first free line; ``seq`` is twice the old one, one more behind the cut."""

    def place(text: str) -> tuple:
        ls = split_lines(text)
        k = free(ls)
        return (None if k is None else sum(len(x) + 1 for x in ls[:k]),)

    cuts = _mapped(rows.withColumn("text", F.regexp_replace("text", "\r\n", "\n")), place, [StructField("at", LongType())])
    begun = F.coalesce(F.last(F.when(F.col("at").isNotNull(), F.col("seq")), True).over(_before()), F.lit(-1))
    cuts = stored(cuts.select("id", "seq", "at", begun.alias("begun")), "cuts")
    text = F.regexp_replace("text", "\r\n", "\n")
    head = F.struct(F.col("begun").alias("segment"), (F.col("seq") * 2).alias("seq"), F.when(F.col("at").isNull(), text).otherwise(_units_before(text, F.col("at"))).alias("text"))
    rest = F.struct(F.col("seq").cast("long").alias("segment"), (F.col("seq") * 2 + 1).alias("seq"), F.when(F.col("at").isNull(), "").otherwise(_units_from(text, F.col("at"))).alias("text"))
    return _met(rows, cuts).select("id", F.inline(F.array(head, rest))).where("text <> ''")


def _units_before(text: Column, n: Column) -> Column:
    return F.substring(text, F.lit(1), n.cast("int"))


def _units_from(text: Column, n: Column) -> Column:
    return F.substring(text, (n + 1).cast("int"), F.length(text))


def _pieces(got: list) -> Iterator[Piece]:
    """A fold's output with neighbouring plain lines put together."""
    plain: list[str] = []
    for x in got:
        if not isinstance(x, Piece):
            plain.append(x)
        elif x.trace is None:
            plain += x.lines
        else:
            if plain:
                yield Piece(plain)
            plain = []
            yield x
    if plain:
        yield Piece(plain)


def _streamed(rows: DataFrame, make: Callable[[], object]) -> DataFrame:
    """Segments through a fold in order, each in one task, a block at a time."""
    bounded_batches(rows.sparkSession)
    own = [StructField("segment", LongType()), StructField("seq", LongType()), StructField("no", LongType()), TEXT, StructField("trace", LongType()), StructField("digest", StringType())]
    schema = StructType([rows.schema["id"], *own])
    dealt = rows.select("id", "segment", "seq", "text").repartition("id", "segment").sortWithinPartitions("id", "segment", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = machine = kinds = None
        no = 0

        def rows_of(got: list) -> list[tuple]:
            nonlocal no
            out = [(*place, no + k, ended(p.lines), p.trace, p.digest) for k, p in enumerate(_pieces(got))]
            no += len(out)
            return out

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*out), kinds)], schema.names)

        for b in batches:
            kinds = [b.column(0).type, *(KINDS[type(x.dataType)] for x in own)]
            out: list[tuple] = []
            for here in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3)):
                if place is None or here[:2] != place[:2]:
                    if machine is not None:
                        out += rows_of(machine.end())
                    machine, no = make(), 0
                place = here[:3]
                out += rows_of([x for line in split_lines(here[3].as_py()) for x in machine.line(line)])
            if out:
                yield batch(out)
        if machine is not None and (out := rows_of(machine.end())):
            yield batch(out)

    return dealt.mapInArrow(run, schema)


def _joined(rows: DataFrame) -> DataFrame:
    """(id, seq, text) from the pieces of each block; together they are no longer than a block and what was held before it."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"])
    return rows.groupBy("id", "seq").agg(F.array_join(parts, "").alias("text")).where("text <> ''")


def collapsed_blocks(rows: DataFrame) -> DataFrame:
    """Runs of similar lines collapsed."""
    return chomped(stored(_joined(_streamed(segments(rows, Runs.free), Runs)), "runs"))


def diff_blocks(rows: DataFrame) -> DataFrame:
    """Diffs without reproducible metadata and with long stretches of context folded."""
    return _joined(_streamed(segments(stored(chomped(rows), "diff"), Context.free), Context))


def trace_blocks(rows: DataFrame) -> DataFrame:
    """Each different trace once, its frames folded, with a count where it came more than once."""
    found = stored(_streamed(segments(rows, Traces.free), Traces), "traces")
    whole_traces = found.where("digest is not null")
    first = whole_traces.groupBy("id", "digest").agg(F.min(F.struct("segment", "trace")).alias("at"), F.count(F.lit(1)).alias("times"))
    first = first.select("id", "at.segment", "at.trace", "times")
    met = found.where("trace is not null").join(first, ["id", "segment", "trace"])
    told = F.when(F.col("digest").isNotNull() & (F.col("times") > 1), F.concat(T.mark("stack trace repeated ", F.col("times"), " times"), F.lit("\n"))).otherwise("")
    kept = met.select("id", "seq", "no", F.concat("text", told).alias("text")).unionByName(found.where("trace is null").select("id", "seq", "no", "text"))
    return chomped(stored(_joined(kept), "once"))


def reduced_blocks(rows: DataFrame) -> DataFrame:
    """The ordered folds of the generic chain, one after the other: similar runs, test runs, traces."""
    rows = stored(collapsed_blocks(rows), "collapsed")
    kinds = stored(test_kind(rows), "kinds")
    by_text = kinds.select("id", "kind").distinct()
    of = lambda kind: rows.join(by_text.where(F.col("kind") == kind).select("id"), "id", "left_semi")
    other = rows.join(by_text.where(F.col("kind").isNotNull()).select("id"), "id", "left_anti")
    summed = other.unionByName(failing_blocks(of("failing"), kinds)).unionByName(passing_blocks(of("passing")))
    return trace_blocks(stored(summed, "summed"))
