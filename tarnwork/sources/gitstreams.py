"""Change lists from git: parsing its NUL-separated output into paths."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession


#: A status and its path, or both paths of a rename or copy; an entry that is cut off gives the path it has.
CHANGE = re.compile(rb"[RC]\d*\0([^\0]+)\0([^\0]+)(?:\0|$)|[A-Z]\d*\0([^\0]+)(?:\0|$)")
STATE = re.compile(rb"(?:[RC].|.[RC]) ([^\0]+)\0([^\0]+)(?:\0|$)|.. ([^\0]+)(?:\0|$)", re.S)


def _paths(entries: re.Pattern, out: bytes) -> set[str]:
    return {p.decode("utf-8", "surrogateescape") for m in entries.finditer(out) for p in m.groups() if p}


def parse_name_status(out: bytes) -> set[str]:
    """Paths of `git diff --name-status -z`; renames and copies carry two, both count."""
    return _paths(CHANGE, out)


def parse_porcelain(out: bytes) -> set[str]:
    """Paths of `git status --porcelain -z`; a rename's or copy's old name follows as an entry of its own."""
    return _paths(STATE, out)


def below(paths: set[str], prefix: str) -> set[str]:
    """Paths relative to a directory of the repository; those outside it are dropped."""
    head = prefix.strip("/") + "/" if prefix.strip("/") else ""
    return {p[len(head) :] for p in paths if p.startswith(head) and len(p) > len(head)}


def candidates(spark: SparkSession, root: str, anchor: str, prefix: str = "") -> DataFrame | None:
    """path of what changed since the anchor or is uncommitted; None if git can't tell."""

    def git(*args: str) -> bytes:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True, timeout=30).stdout

    try:
        paths = parse_name_status(git("diff", "--name-status", "-z", anchor, "HEAD")) | parse_porcelain(git("status", "--porcelain", "-z"))
    except (OSError, subprocess.SubprocessError):
        return None
    return spark.createDataFrame([(p,) for p in sorted(below(paths, prefix))], "path string")
