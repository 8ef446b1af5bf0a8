"""Command-aware summaries: (text, rule) structs or null, chosen by first match.

Each summary takes the text and the ``about`` struct of its command (see
functions.commands.described).  All but the two folds are plain expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.config import Config, safe_pattern
from skein.functions import fixed as K
from skein.functions import folds
from skein.functions import text as T

_diff = folds.text_udf(folds.diff_context)
_lint = folds.text_udf(folds.lint_summary)
RESULT = "struct<text: string, rule: string>"


def _result(text: Column, rule: Column | str) -> Column:
    return F.struct(T.chomp(text).alias("text"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"))


def _none() -> Column:
    return F.lit(None).cast(RESULT)


def _is(about: Column, names: list[str]) -> Column:
    return about["binary"].isin(names)


def git_status(text: Column) -> Column:
    """Branch and counts by status code, with all file lines."""
    ls = T.solid_lines(text)
    heads = F.filter(ls, lambda x: x.startswith("## "))
    name = F.substring(F.try_element_at(heads, F.lit(1)), 4, 1 << 20)
    branch = F.when(F.coalesce(name, F.lit("")) == "", F.lit("detached")).otherwise(name)
    files = F.filter(ls, lambda x: x.rlike(K.STATUS_LINE))
    codes = F.flatten(F.transform(files, lambda x: F.filter(F.array_distinct(F.array(F.substring(x, 1, 1), F.substring(x, 2, 1))), lambda c: c != " ")))
    counts = F.transform(F.array_distinct(codes), lambda c: F.concat(F.size(F.filter(codes, lambda x: x == c)).cast("string"), c))
    shown = F.concat(branch, F.lit(" | "), F.array_join(counts, " "), F.lit("\n"), F.array_join(files, "\n"))
    return _result(F.when(F.size(files) == 0, F.concat(branch, F.lit(" | clean"))).otherwise(shown), "gitStatus")


def git_log(text: Column, tokens: Column) -> Column:
    """Hash and subject of each commit; null where the log itself was asked for."""
    ls = T.solid_lines(text)
    asked = F.exists(F.coalesce(tokens, F.array().cast("array<string>")), lambda x: x.rlike(K.LOG_VERBATIM_FLAG)) | F.exists(ls, lambda x: x.rlike(K.ONE_LINE_LOG))
    # a commit's subject is the next of these; a lambda over the array inside another would make it anew for each commit
    plain = F.filter(ls, lambda x: ~x.rlike(K.AUTHOR_OR_DATE))
    paired = F.zip_with(plain, F.slice(plain, F.lit(2), F.lit(1 << 30)), lambda x, after: F.when(x.rlike(K.COMMIT_LINE), F.concat_ws(" ", F.regexp_extract(x, K.COMMIT_LINE, 1), T.bare(after))))
    out = F.array_compact(paired)
    return F.when(~asked & (F.size(out) > 0), _result(F.array_join(out, "\n"), "gitLog"))


def _is_diff(about: Column) -> Column:
    return (about["binary"] == "git") & (about["subcommand"] == "diff")


def is_folded(about: Column) -> Column:
    """Whether a text of the command goes through one of the two folds."""
    return _is_diff(about) | _is(about, K.LINTERS)


def _diff_fold(text: Column, about: Column) -> Column:
    return _diff(F.when(_is_diff(about), text))


def _lint_fold(text: Column, about: Column) -> Column:
    return _lint(F.when(_is(about, K.LINTERS), T.chomp(T.unix_newlines(T.strip_ansi(text)))))  # no text of another tool goes to Python


def fold(text: Column, about: Column) -> Column:
    """What the fold of the command makes of a text; no command has both."""
    return F.coalesce(_diff_fold(text, about), _lint_fold(text, about))


def git_diff(text: Column, asked: Column, out: Column) -> Column:
    """A diff with metadata and long context out (``out``); null unless a tenth is saved."""
    source = T.chomp(T.unix_newlines(text))
    is_diff = text.rlike(r"(?md)^diff --git ")
    return F.when(asked & is_diff & (T.units(out) * 10 < T.units(source) * 9), _result(out, "gitDiff"))


def git(text: Column, about: Column, folded: Column | None = None) -> Column:
    sub = about["subcommand"]
    whole = T.chomp(T.unix_newlines(text))
    pulled = F.when(whole != "", _result(F.concat(F.lit("ok git pull:\n"), whole), "gitOperation"))
    chosen = F.when((sub == "status") & text.rlike(r"(?m)^(?:## |[ MADRCU?!]{2}\s)"), git_status(text)).when(sub == "log", git_log(text, about["tokens"])).when(sub == "diff", git_diff(text, _is_diff(about), _diff_fold(text, about) if folded is None else folded)).when(sub == "pull", pulled)
    return F.when(about["binary"] == "git", chosen)


def _first_places(places: Column) -> Column:
    """First place of each different line, from (line, at) sorted."""
    none = F.transform(F.slice(places, F.lit(1), F.lit(1)), lambda x: F.lit(None).cast("string"))
    last = F.concat(none, F.transform(F.slice(places, F.lit(1), F.greatest(F.size(places) - 1, F.lit(0))), lambda x: x["line"]))
    return F.array_compact(F.zip_with(places, last, lambda a, b: F.when(~a["line"].eqNullSafe(b), a["at"])))


def packages(text: Column, about: Column) -> Column:
    """The last summary line, distinct warnings and counts of what is left out."""
    ls = T.solid_lines(text)
    summary = F.try_element_at(F.filter(ls, lambda x: x.rlike(K.PACKAGE_SUMMARY)), F.lit(-1))
    signals = F.filter(ls, lambda x: x.rlike(K.PACKAGE_SIGNAL))
    distinct = F.array_distinct(signals)
    # sorted, equal lines lie together with their first place in front; runs of several, by first place
    places = F.array_sort(F.transform(signals, lambda x, i: F.struct(x.alias("line"), i.alias("at"))))
    first = F.zip_with(T.run_starts(places, "line"), _first_places(places), lambda r, at: F.struct(at.alias("at"), (r["n"] - 1).alias("extra")))
    extra = F.array_sort(F.filter(first, lambda x: x["extra"] > 0))
    repeats = F.transform(extra, lambda x: F.concat(F.lit("... "), T.mark(x["extra"], " duplicate package warnings omitted")))
    omitted = F.size(ls) - 1 - (F.size(signals) - F.when(summary.rlike(K.PACKAGE_SIGNAL), 1).otherwise(0))
    none = F.array().cast("array<string>")
    last = F.when(omitted > 0, F.array(F.concat(F.lit("... "), T.mark(omitted, " package-manager lines omitted")))).otherwise(none)
    name = F.concat(about["binary"], F.lit(" "), F.when(about["subcommand"] == "", F.lit("command")).otherwise(about["subcommand"]), F.lit(": "), summary)
    out = F.concat(F.array(name), F.array_remove(distinct, summary), repeats, last)
    return F.when(_is(about, K.PACKAGE_MANAGERS) & summary.isNotNull(), _result(F.array_join(out, "\n"), "packageManagerSummary"))


def go_json(text: Column) -> Column:
    """Passed tests and packages of a JSON test log; null if a line isn't JSON or something failed."""
    ls = F.filter(T.lines(text), lambda x: T.bare(x) != "")
    field = lambda x, k: F.get_json_object(x, f"$.{k}")
    sound = F.forall(ls, lambda x: F.try_parse_json(x).isNotNull()) & ~F.exists(ls, lambda x: F.coalesce(field(x, "Action") == "fail", F.lit(False)))
    passed = F.size(F.filter(ls, lambda x: (field(x, "Action") == "pass") & (F.coalesce(field(x, "Test"), F.lit("")) != "")))
    names = F.size(F.array_distinct(F.filter(F.transform(ls, lambda x: field(x, "Package")), lambda x: x.isNotNull() & (x != ""))))
    return F.when(sound, _result(F.concat(F.lit("go test: ok ("), passed.cast("string"), F.lit(" tests, "), names.cast("string"), F.lit(" packages)")), "goTestJson"))


def tests(text: Column, about: Column) -> Column:
    ls = T.solid_lines(text)
    ok = F.filter(ls, lambda x: x.rlike(r"^ok\s+\S+"))
    go = F.when(F.array_contains(about["tokens"], "-json"), go_json(text)).when(F.size(ok) > 0, _result(F.concat(F.lit("go test: "), F.array_join(ok, "\n")), "goTest"))
    kept = F.filter(ls, lambda x: x.rlike(K.RUNNER_SUMMARY))
    other = F.when(F.size(kept) > 0, _result(F.array_join(kept, "\n"), "testRunnerSummary"))
    is_go = (about["binary"] == "go") & (about["subcommand"] == "test")
    return F.when(_is(about, K.TEST_BINARIES), F.when(is_go, go).otherwise(other))


def linters(text: Column, about: Column, folded: Column | None = None) -> Column:
    out = _lint_fold(text, about) if folded is None else folded
    good = F.filter(T.solid_lines(text), lambda x: x.rlike(K.LINT_SUCCESS))
    clean = F.when(F.size(good) > 0, _result(F.array_join(good, "\n"), "linterSummary"))
    return F.when(_is(about, K.LINTERS), F.coalesce(F.when(out.isNotNull(), _result(out, "linterDiagnostics")), clean))


def containers(text: Column, about: Column) -> Column:
    ls = T.solid_lines(text)
    table = F.array_join(F.transform(ls, lambda x: F.regexp_replace(T.bare(x), r"\s{2,}", " | ")), "\n")
    docker = (about["binary"] == "docker") & about["subcommand"].isin("ps", "images")
    kube = (about["binary"] == "kubectl") & (about["subcommand"] == "get")
    return F.when((docker | kube) & (F.size(ls) >= 2), _result(table, F.when(docker, F.lit("dockerTable")).otherwise(F.lit("kubectlTable"))))


def custom(text: Column, command: Column, config: Config) -> tuple[Column, Column]:
    """(result, whether a filter decided): user filters turned into expressions, first match first."""
    result, decided = _none(), F.lit(False)
    for f in reversed(config.filters):
        pattern = safe_pattern(f.match_command)
        if pattern is None:
            continue
        out = F.regexp_replace(text, K.ANSI_ESCAPE, "") if f.strip_ansi else text
        drop = safe_pattern(f.strip_lines_matching) if f.strip_lines_matching else None
        if drop:
            out = _without(out, drop)
        if f.max_lines is not None:
            out = F.array_join(F.slice(T.lines(out), 1, f.max_lines), "\n") if f.max_lines else F.lit("")
        out = T.chomp(out)
        rule = f"custom:{f.name}"
        if f.on_empty == "keep":
            out = F.when(out == "", text).otherwise(out)
        made = F.struct(out.alias("text"), F.lit(rule).alias("rule"))
        if f.on_empty not in ("keep", "drop", "empty"):
            made = F.when(out != "", made)
        hit = command.rlike(pattern)
        result = F.when(hit, made).otherwise(result)
        decided = hit | decided
    return result, decided


def _without(text: Column, pattern: str) -> Column:
    return F.array_join(F.filter(T.lines(text), lambda x: ~x.rlike(pattern)), "\n")


def compress(text: Column, about: Column, command: Column, failed: Column, config: Config = Config(), bad_text: Column | None = None, folded: Column | None = None) -> Column:
    """The first summary that takes the command; null if none does or nothing may be summarised.

    ``bad_text`` says whether the text holds failure records, and ``folded`` is its ``fold``, where that is known already.
    """
    filtered, _ = custom(text, command, config)
    failure = failed | (T.has_failure(text) if bad_text is None else bad_text)
    chosen = F.coalesce(F.when(~failure, F.coalesce(git(text, about, folded), packages(text, about), tests(text, about))), F.when(~failed, linters(text, about, folded)), F.when(~failure, containers(text, about)))
    return F.when(about["binary"].isNotNull(), F.coalesce(filtered, chosen))

