"""Relational line operators: lines as rows (id, pos, line), joined up again by position."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import fixed as K
from skein.functions import text as T


def settled(df: DataFrame) -> DataFrame:
    """A metrics node: what is computed up to here is computed once, the optimiser doesn't copy it into later uses."""
    return df.observe(f"settled-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (name, *(f"{name}_{k}" for k in range(len(taken) + 1))) if x.lower() not in taken)


def explode_lines(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, pos, line) of every line; a null text has none."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(T.lines(F.col(text_col))).alias("pos", "line"))


def joined(df: DataFrame, order: tuple[str, ...] = ("pos",), line: str = "line", out: str = "text") -> DataFrame:
    """Lines of each id in order, joined by newlines."""
    items = F.array_sort(F.collect_list(F.struct(*order, line)))
    return df.groupBy("id").agg(F.array_join(F.transform(items, lambda x: x[line]), "\n").alias(out))


def first_occurrences(rows: DataFrame, exempt: str | None = "--") -> DataFrame:
    """Adds ``kept``: the first of equal lines of an id, and every exempt line."""
    w = Window.partitionBy("id", "line").orderBy("pos")
    kept = F.row_number().over(w) == 1
    return rows.withColumn("kept", kept if exempt is None else kept | (F.col("line") == exempt))


def dedup_lines(lines: Column, exempt: str = "--") -> Column:
    """The same on an array of lines: no shuffle, one hash pass over each text."""
    # exempt lines get a number of their own for the while, so that the distinct pass keeps them all
    mark = exempt + "\x00"
    numbered = F.transform(lines, lambda x, i: F.when(x == exempt, F.concat(F.lit(mark), i.cast("string"))).otherwise(x))
    return F.transform(F.array_distinct(numbered), lambda x: F.when(x.startswith(mark), F.lit(exempt)).otherwise(x))


def collapse_matches(rows: DataFrame) -> DataFrame:
    """(id, text): runs of more than three matches of one file folded into three and the other places.

    ``rows`` are (id, pos, line); duplicates go first and are counted in a last line.  Rows that stay and rows that go
    are numbered apart in one window, each run becomes one row, and the runs of a text are joined.
    """
    path = F.when(F.col("line").rlike(K.MATCH_PATH), F.regexp_extract("line", K.MATCH_PATH, 1))
    w = Window.partitionBy("id", "kept").orderBy("pos")
    new = F.coalesce(F.col("path").isNull() | ~F.lag("path").over(w).eqNullSafe(F.col("path")), F.lit(True))
    marked = first_occurrences(rows).withColumn("path", path).withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    each = marked.groupBy("id", "kept", "run").agg(F.min("pos").alias("pos"), F.first("path").alias("path"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("all"))
    all_lines = F.transform("all", lambda x: x["line"])
    rest = F.slice(all_lines, F.lit(K.MATCH_RUN_SHOWN + 1), F.size("all"))
    places = F.array_join(F.transform(rest, lambda x: F.regexp_extract(x, K.MATCH_PLACE, 1)), ", ")
    folded = F.concat(F.slice(all_lines, 1, K.MATCH_RUN_SHOWN), F.array(F.concat(F.lit("... "), T.mark(F.size(rest), " more at ", places))))
    long = F.col("path").isNotNull() & (F.size("all") > K.MATCH_RUN_SHOWN)
    runs = each.select("id", "kept", "pos", F.size("all").alias("size"), F.array_join(F.when(long, folded).otherwise(all_lines), "\n").alias("text"))
    shown = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("pos", "text"))))
    gone = F.sum(F.when(F.col("kept"), 0).otherwise(F.col("size")))
    whole = runs.groupBy("id").agg(F.array_join(F.transform(shown, lambda x: x["text"]), "\n").alias("text"), gone.alias("gone"))
    last = F.when(F.col("gone") > 0, F.concat(F.lit("\n... "), T.mark(F.col("gone"), " duplicate match lines omitted"))).otherwise("")
    return whole.select("id", F.concat("text", last).alias("text"))


def with_collapsed_matches(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Adds the same for a text that is a column, without a shuffle; what is used several times is computed once."""
    names = [free_name(df, f"{out}_{k}") for k in ("lines", "kept", "runs")]
    ls, kept, runs = map(F.col, names)
    df = settled(df.withColumn(names[0], T.lines(text)))
    df = settled(df.withColumn(names[1], dedup_lines(ls)))
    items = F.transform(kept, lambda x: F.struct(F.when(x.rlike(K.MATCH_PATH), F.regexp_extract(x, K.MATCH_PATH, 1)).alias("path")))
    df = settled(df.withColumn(names[2], T.run_starts(items, "path")))

    def shown(run: Column) -> Column:
        places = F.transform(F.slice(kept, run["at"] + 1 + K.MATCH_RUN_SHOWN, run["n"] - K.MATCH_RUN_SHOWN), lambda x: F.regexp_extract(x, K.MATCH_PLACE, 1))
        more = F.concat(F.lit("... "), T.mark(F.size(places), " more at ", F.array_join(places, ", ")))
        folded = F.concat(F.slice(kept, run["at"] + 1, F.lit(K.MATCH_RUN_SHOWN)), F.array(more))
        return F.when(run["n"] > K.MATCH_RUN_SHOWN, folded).otherwise(F.slice(kept, run["at"] + 1, run["n"]))

    gone = F.size(ls) - F.size(kept)
    last = F.when(gone > 0, F.concat(F.lit("\n... "), T.mark(gone, " duplicate match lines omitted"))).otherwise("")
    return settled(df.withColumn(out, F.concat(F.array_join(F.flatten(F.transform(runs, shown)), "\n"), last))).drop(*names)


def with_folder_lines(df: DataFrame, names: Column, out: str) -> DataFrame:
    """Adds the lines of ``glob_lines`` for an array of names, without a shuffle."""
    own = [free_name(df, f"{out}_{k}") for k in ("items", "runs")]
    items, runs = map(F.col, own)
    sorted_ = F.array_sort(F.transform(names, lambda x, i: F.struct(T.dirname(x).alias("dir"), i.alias("pos"), T.basename(x).alias("base"))))
    df = settled(df.withColumn(own[0], sorted_))
    df = settled(df.withColumn(own[1], T.run_starts(items, "dir")))

    def line(run: Column) -> Column:
        first, more = F.element_at(items, run["at"] + 1), run["n"] - K.GLOB_SHOWN
        files = F.transform(F.slice(items, run["at"] + 1, F.least(run["n"], F.lit(K.GLOB_SHOWN))), lambda x: x["base"])
        tail = F.when(more > 0, F.concat(F.lit(", ... "), T.mark(more, " more"))).otherwise(F.lit(""))
        return F.struct(first["pos"].alias("pos"), F.concat(first["dir"], F.lit("/ ("), run["n"].cast("string"), F.lit(" files: "), F.array_join(files, ", "), tail, F.lit(")")).alias("line"))

    return settled(df.withColumn(out, F.transform(F.array_sort(F.transform(runs, line)), lambda x: x["line"]))).drop(*own)


def _folders(names: DataFrame) -> DataFrame:
    """(id, pos, line) of each folder, from rows (id, pos, name)."""
    rows = names.select("id", "pos", T.dirname(F.col("name")).alias("dir"), T.basename(F.col("name")).alias("base"))
    files = F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"])
    by_dir = rows.groupBy("id", "dir").agg(F.min("pos").alias("pos"), files.alias("files"))
    more = F.size("files") - K.GLOB_SHOWN
    tail = F.when(more > 0, F.concat(F.lit(", ... "), T.mark(more, " more"))).otherwise(F.lit(""))
    line = F.concat("dir", F.lit("/ ("), F.size("files").cast("string"), F.lit(" files: "), F.array_join(F.slice("files", 1, K.GLOB_SHOWN), ", "), tail, F.lit(")"))
    return by_dir.select("id", "pos", line.alias("line"))


def glob_groups(names: DataFrame) -> DataFrame:
    """(id, text) from rows (id, pos, name): names by directory, in order of first sight."""
    return joined(_folders(names))


def glob_lines(names: DataFrame) -> DataFrame:
    """(id, lines): the same as an array."""
    items = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return _folders(names).groupBy("id").agg(F.transform(items, lambda x: x["line"]).alias("lines"))


def exact_runs(rows: DataFrame) -> DataFrame:
    """(id, run, first_pos, size, line): maximal runs of equal neighbouring lines."""
    w = Window.partitionBy("id").orderBy("pos")
    new = F.coalesce(F.lag("line").over(w) != F.col("line"), F.lit(True))
    return rows.withColumn("run", F.sum(new.cast("int")).over(w)).groupBy("id", "run").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("size"), F.first("line").alias("line"))


def diff_context(rows: DataFrame) -> DataFrame:
    """(id, text): diff lines without metadata, long stretches of context cut to three lines at either end."""
    w = Window.partitionBy("id").orderBy("pos")
    stops = F.col("line").rlike(K.DIFF_LIVE) | F.col("line").rlike(K.DIFF_META)
    # metadata directly inside a stretch of context belongs to it, as in a plain scan
    live = F.col("line").rlike(K.DIFF_LIVE)
    base = rows.withColumn("live", live).withColumn("island", F.sum(live.cast("int")).over(w))
    first_plain = F.min(F.when(~F.col("live") & ~stops, F.col("pos"))).over(Window.partitionBy("id", "island"))
    base = base.withColumn("context", ~F.col("live") & (F.col("pos") >= first_plain))
    inside = Window.partitionBy("id", "island", "context").orderBy("pos")
    base = base.withColumn("nth", F.row_number().over(inside)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("id", "island", "context")))
    long = F.col("context") & (F.col("size") > 2 * K.CONTEXT_SHOWN)
    middle = long & (F.col("nth") > K.CONTEXT_SHOWN) & (F.col("nth") <= F.col("size") - K.CONTEXT_SHOWN)
    marker = F.concat(F.lit("... "), T.mark(F.col("size") - 2 * K.CONTEXT_SHOWN, " unchanged context lines omitted"))
    shown = base.where(F.col("context") | F.col("live")).where(~middle | (F.col("nth") == K.CONTEXT_SHOWN + 1))
    return joined(shown.select("id", "pos", F.when(middle, marker).otherwise(F.col("line")).alias("line")))


def lint_dedup(rows: DataFrame) -> DataFrame:
    """(id, pos, file, rule, line, nth, total): diagnostics with their heading, numbered within (file, rule, message)."""
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("line").rlike(K.LINT_HEADING)
    base = rows.withColumn("heading", heading).withColumn("file", F.coalesce(F.last(F.when(heading, F.col("line")), True).over(w), F.lit("")))
    tsc, stylish, concise = F.col("line").rlike(K.LINT_TSC), F.col("line").rlike(K.LINT_STYLISH), F.col("line").rlike(K.LINT_CONCISE)
    part = lambda p, k: F.regexp_extract("line", p, k)
    named = F.regexp_extract(part(K.LINT_TSC, 4), K.LINT_TSC_RULE, 1)
    rule = F.when(tsc, F.when(named == "", "diagnostic").otherwise(named)).when(stylish, part(K.LINT_STYLISH, 4)).when(concise, part(K.LINT_CONCISE, 4))
    owner = F.when(tsc, part(K.LINT_TSC, 1)).when(stylish, F.col("file")).when(concise, part(K.LINT_CONCISE, 1))
    message = F.when(tsc, part(K.LINT_TSC, 4)).when(stylish, part(K.LINT_STYLISH, 3)).when(concise, part(K.LINT_CONCISE, 5))
    found = base.where(~F.col("heading")).select("id", "pos", "file", "line", rule.alias("rule"), owner.alias("owner"), message.alias("message")).where(F.col("rule").isNotNull())
    key = Window.partitionBy("id", "owner", "rule", "message")
    return found.withColumn("nth", F.row_number().over(key.orderBy("pos"))).withColumn("total", F.count(F.lit(1)).over(key))


def log_subjects(rows: DataFrame) -> DataFrame:
    """(id, pos, hash, subject) of each commit: the next line that is neither author, date nor blank."""
    # without those lines it is the next row: a frame up to the last row would be read again for each
    plain = rows.where((T.bare(F.col("line")) != "") & ~F.col("line").rlike(K.AUTHOR_OR_DATE))
    subject = F.lead(T.bare(F.col("line"))).over(Window.partitionBy("id").orderBy("pos"))
    found = plain.withColumn("subject", subject).where(F.col("line").rlike(K.COMMIT_LINE))
    return found.select("id", "pos", F.regexp_extract("line", K.COMMIT_LINE, 1).alias("hash"), "subject")
