"""Column functions over text, dates and sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode letters and digits, with the two signs that tags and terms keep.
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: An RFC 3339 time with its offset.
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def to_utc(text: Column) -> Column:
    """RFC 3339 text as a timestamp in whole seconds; null without an offset or if it is no time."""
    return F.when(text.rlike(RFC3339), F.date_trunc("second", F.try_to_timestamp(F.upper(text))))


def utc_text(text: Column) -> Column:
    return F.date_format(to_utc(text), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def slug(title: Column, limit: int = 48) -> Column:
    """Lower-case letters and digits, other runs as one dash, none at the ends. It ends with the letter that reaches the
    limit; a dash and the letter behind it come together, so it may be one longer."""
    plain = F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), F.lit("-"))
    return F.substring(plain, F.lit(1), F.when(F.substring(plain, limit, 1) == "-", limit + 1).otherwise(limit))


def project_name(git_repo: Column, cwd: Column) -> Column:
    """The remote without scheme and .git, else the last two parts of the folder, else the folder."""
    remote = F.regexp_replace(F.regexp_replace(git_repo, "^https?://", ""), r"\.git$", "")
    parts = F.filter(F.split(cwd, r"[\\/]"), lambda p: p != "")
    tail = F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), "/")
    folder = F.when(F.size(parts) > 0, tail).otherwise(cwd)
    return F.when(F.coalesce(git_repo, F.lit("")) != "", remote).otherwise(folder)


def excerpt(markdown: Column) -> Column:
    """Plain text for a preview: code fences and markers dropped, link texts kept, blanks collapsed."""
    out = F.regexp_replace(markdown, r"```[\s\S]*?(```|\z)", " ")
    out = F.regexp_replace(out, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^\s{0,3}(#{1,6}|>|[-*+]|\d+\.)\s+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[`*_~]", ""), r"\s+", " "))


def without_title(markdown: Column) -> Column:
    return F.regexp_replace(markdown, r"^\s*# [^\n]*\n?", "")


def without_section(markdown: Column, heading: str) -> Column:
    """The text without its first section of this heading, up to the next one."""
    lines = F.split(markdown, "\n")
    start = F.coalesce(F.array_position(F.transform(lines, lambda x: F.trim(x)), f"## {heading}"), F.lit(0))
    later = F.filter(F.transform(lines, lambda x, i: F.when((i + 1 > start) & x.startswith("## "), i + 1)), lambda p: p.isNotNull())
    end = F.coalesce(F.array_min(later), F.size(lines) + 1)
    kept = F.filter(lines, lambda x, i: (i + 1 < start) | (i + 1 >= end))
    return F.when(start == 0, markdown).otherwise(F.array_join(kept, "\n"))


#: Seconds of each unit, the largest first.
UNITS = (("year", 365 * 86400), ("month", 30 * 86400), ("week", 7 * 86400), ("day", 86400), ("hour", 3600), ("minute", 60))


def age(seconds: Column) -> tuple[Column, Column]:
    """Unit and rounded count of an age; under a minute ("now", 0)."""
    unit, count = F.lit("now"), F.lit(0)
    for name, size in reversed(UNITS):
        far = F.abs(seconds) >= size
        unit, count = F.when(far, name).otherwise(unit), F.when(far, F.floor(seconds / size + 0.5)).otherwise(count)
    return unit, count.cast("long")


def first_line(text: Column) -> Column:
    return F.get(F.split(text, "\n"), F.lit(0))


def shell_quoted(path: Column) -> Column:
    """The path as a shell word: as it is if it has safe characters only, else in single quotes."""
    return F.when(path.rlike("^[A-Za-z0-9/._~-]*$"), path).otherwise(F.concat(F.lit("'"), F.replace(path, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def reopen(agent: Column, session: Column, cwd: Column) -> tuple[Column, Column]:
    """Link and command that lead back to a session; null for unknown agents."""
    link = F.when(agent == "codex", F.concat(F.lit("codex://threads/"), session)).when(agent == "claude-code", F.concat(F.lit("claude://resume?session="), session))
    resume = F.concat(F.lit("cd "), shell_quoted(cwd), F.lit(" && claude --resume "), session)
    return link, F.when(agent == "codex", F.concat(F.lit("codex resume "), session)).when(agent == "claude-code", resume)


def detect_agent(turn_id: Column, env_flag: Column, transcript: Column) -> Column:
    """The agent of a hook record: by its turn id, then by the flag, then by the transcript's folder."""
    path = F.replace(transcript, F.lit("\\"), F.lit("/"))
    by_path = F.when(path.contains("/.codex/"), "codex").when(path.contains("/.claude/"), "claude-code")
    return F.when(turn_id.isNotNull(), "codex").when(F.coalesce(env_flag, F.lit(False)), "claude-code").otherwise(by_path)


def source_line(text: Column, prefix: str) -> Column:
    """agent, session, cwd of the first line "<prefix>: <agent> <session> <cwd>"; cwd is the rest of the line."""
    pattern = rf"(?m)^{prefix}: (\S+) (\S+) (.+)$"
    found = text.rlike(pattern)
    return F.when(found, F.struct(*[F.regexp_extract(text, pattern, k).alias(n) for k, n in ((1, "agent"), (2, "session"), (3, "cwd"))]))


def ascii_lower(text: Column) -> Column:
    """Lower case of the ASCII letters only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
