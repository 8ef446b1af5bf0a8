"""Layered settings: defaults, then user file, project file and environment."""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from skein.functions import fixed as K


@dataclass(frozen=True)
class Filter:
    """A declarative filter of the output of matching commands."""

    match_command: str
    name: str = "filter"
    strip_ansi: bool = False
    strip_lines_matching: str | None = None
    max_lines: int | None = None
    on_empty: str = "none"


@dataclass(frozen=True)
class RewriteOptions:
    enabled: bool = True
    exclude: tuple[str, ...] = ()
    docker_build: bool = False


@dataclass(frozen=True)
class TeeOptions:
    enabled: bool = True
    mode: str = "lossy"
    max_files: int = 20
    min_bytes: float = K.TEE_MIN_BYTES


@dataclass(frozen=True)
class Config:
    min_chars: float = K.MIN_CHARS
    disable: tuple[str, ...] = ()
    disable_anywhere: tuple[str, ...] = ()  # of files and environment together
    read_guard_lines: float = K.READ_LINE_LIMIT
    read_default_lines: float = K.READ_LINE_LIMIT
    tee: TeeOptions = field(default_factory=TeeOptions)
    rewrite: RewriteOptions = field(default_factory=RewriteOptions)
    filters: tuple[Filter, ...] = ()
    fold_arrays: bool = False

    def disabled(self, tool: str) -> bool:
        return bool({f.strip().lower() for f in self.disable} & {"all", tool.lower()})

    def rewrites_off(self) -> bool:
        """Rewrites are off where a file or the environment says so, whichever it is."""
        flags = {f.strip().lower() for f in (*self.disable, *self.disable_anywhere)}
        return not self.rewrite.enabled or bool(flags & {"all", "rewrite"})

    def keeps_originals(self) -> bool:
        flags = {f.strip().lower() for f in self.disable_anywhere}
        return self.tee.enabled and self.tee.mode in TEE_MODES[:2] and self.tee.max_files > 0 and not flags & {"all", "tee"}


TEE_MODES = ("lossy", "failures", "never")


def _quantified(source: str, at: int) -> bool:
    """Whether a quantifier that may repeat without end, or often, stands here."""
    return source[at : at + 1] in ("+", "*") or re.match(r"\{\d+,?\d*\}", source[at:]) is not None


def safe_pattern(source: object) -> str | None:
    """A user's pattern if it compiles and can't run away; else None.

    One scan keeps the open groups: a group that holds a quantifier or a choice
    may not be quantified itself, at any depth, and nothing may refer back.
    """
    if not isinstance(source, str) or not 1 <= len(source) <= K.MAX_PATTERN:
        return None
    open_groups = [False]  # by group: whether it holds a quantifier or a choice
    at, in_class = 0, False
    while at < len(source):
        c = source[at]
        if c == "\\":
            if source[at + 1 : at + 2] in tuple("123456789"):
                return None
            at += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            open_groups.append(False)
        elif c == ")" and len(open_groups) > 1:
            risky = open_groups.pop()
            if risky and _quantified(source, at + 1):
                return None
            open_groups[-1] |= risky
        elif c == "|" or _quantified(source, at):
            open_groups[-1] = True
        at += 1
    try:
        re.compile(source)
    except re.error:
        return None
    return source


def _number(x: object) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x) and x >= 0


def _strings(x: object) -> bool:
    return isinstance(x, list) and all(isinstance(y, str) for y in x)


def _filter(raw: object) -> Filter | None:
    if not isinstance(raw, dict) or not isinstance(raw.get("matchCommand"), str):
        return None
    name, lines = raw.get("name"), raw.get("maxLines")
    return Filter(
        raw["matchCommand"],
        name if isinstance(name, str) and re.fullmatch(r"[A-Za-z0-9._-]{1,48}", name) else "filter",
        raw.get("stripAnsi") is True,
        raw.get("stripLinesMatching") if isinstance(raw.get("stripLinesMatching"), str) else None,
        int(lines) if _number(lines) and lines == int(lines) else None,
        raw.get("onEmpty") if raw.get("onEmpty") in ("keep", "drop", "empty") else "none",
    )


def overlay(base: Config, raw: object) -> Config:
    """A layer over a config; fields of the wrong type are left out."""
    if not isinstance(raw, dict):
        return base
    given = {name: raw[key] for key, name in (("minChars", "min_chars"), ("readGuardLines", "read_guard_lines"), ("readDefaultLines", "read_default_lines")) if _number(raw.get(key))}
    if _strings(raw.get("disable")):
        given["disable"] = given["disable_anywhere"] = tuple(raw["disable"])
    if isinstance(t := raw.get("tee"), dict):
        checks = (("enabled", "enabled", isinstance(t.get("enabled"), bool)), ("mode", "mode", t.get("mode") in TEE_MODES), ("maxFiles", "max_files", _number(t.get("maxFiles"))))
        given["tee"] = replace(base.tee, **{name: t[key] for key, name, ok in checks if ok})
    if isinstance(r := raw.get("rewrite"), dict):
        some = {name: r[key] for key, name in (("enabled", "enabled"), ("dockerBuild", "docker_build")) if isinstance(r.get(key), bool)}
        if _strings(r.get("exclude")):
            some["exclude"] = tuple(r["exclude"])
        given["rewrite"] = replace(base.rewrite, **some)
    if isinstance(raw.get("filters"), list):
        given["filters"] = tuple(f for f in map(_filter, raw["filters"][: K.MAX_FILTERS]) if f)
    return replace(base, **given)


def _listed(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def from_environment(base: Config, env: Mapping[str, str]) -> Config:
    """The last layer: SKEIN_MIN_CHARS, _READ_GUARD_LINES, _READ_DEFAULT_LINES, _DISABLE, _REWRITE_ENABLED, _REWRITE_EXCLUDE, _REWRITE_DOCKER_BUILD,
    _TEE_MIN (least bytes of a text worth a recovery copy; what is no number of at least 0 doesn't count).

    _DISABLE stands in place of what the files disable, but rewrites heed both.
    """
    layer: dict = {}
    for key in ("MIN_CHARS", "READ_GUARD_LINES", "READ_DEFAULT_LINES"):
        try:
            value = float(env.get(f"SKEIN_{key}", "nan").strip() or 0)
        except ValueError:
            continue
        first, *rest = key.lower().split("_")
        layer[first + "".join(map(str.capitalize, rest))] = int(value) if math.isfinite(value) and value == int(value) else value
    rewrite: dict = {}
    for key, name in (("ENABLED", "enabled"), ("DOCKER_BUILD", "dockerBuild")):
        if (flag := env.get(f"SKEIN_REWRITE_{key}", "").lower()) in ("true", "false"):
            rewrite[name] = flag == "true"
    if "SKEIN_REWRITE_EXCLUDE" in env:
        rewrite["exclude"] = _listed(env["SKEIN_REWRITE_EXCLUDE"])
    if rewrite:
        layer["rewrite"] = rewrite
    out = overlay(base, layer)
    try:
        least = float(env.get("SKEIN_TEE_MIN", "nan").strip() or 0)
    except ValueError:
        least = math.nan
    if math.isfinite(least) and least >= 0:
        out = replace(out, tee=replace(out.tee, min_bytes=least))
    if "SKEIN_DISABLE" in env:
        flags = tuple(_listed(env["SKEIN_DISABLE"]))
        out = replace(out, disable=flags, disable_anywhere=(*base.disable, *flags))
    return out


def load(*paths: str, env: Mapping[str, str] | None = None) -> tuple[Config, list[str]]:
    """Settings of all layers and what went wrong (oversizedConfig, malformedConfig)."""
    config, notes = Config(), []
    for path in paths:
        if not os.path.exists(path):
            continue
        if os.path.getsize(path) > K.MAX_CONFIG_BYTES:
            notes.append("oversizedConfig")
            continue
        try:
            with open(path, encoding="utf-8") as f:
                config = overlay(config, json.load(f))
        except (ValueError, OSError):
            notes.append("malformedConfig")
    return from_environment(config, os.environ if env is None else env), notes
