"""A code tree as a Spark data source: `spark.read.format("code_tree").option("root", ...)`."""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tarnwork.functions.globs import EXCLUDED_DIRS, LOCK_FILES, SECRET_FILES, compile_rules, ignored

SCHEMA = "path string, bytes bigint, content_hash string, text string, error string"
SNIFF = 8192
MAX_BYTES = 1_048_576


class CodeTree(DataSource):
    """Files below a root with the discovery filters applied while walking.

    One partition per entry directly under the root. Skipped: excluded directories, what an
    ignore file on the way leaves out, secrets, lock files, anything but regular files, files
    above `max_bytes`, files with a NUL byte at their start, symbolic links. A file or directory
    that can't be read is a row with `error` set. Bad UTF-8 is replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CodeTreeReader:
        return CodeTreeReader(dict(self.options))


class CodeTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"]
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.extra = [x for x in options.get("ignore", "").split(",") if x]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in sorted(os.listdir(self.root))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fixed = compile_rules([*SECRET_FILES, *LOCK_FILES, *self.extra])
        yield from self.walk(partition.value, [("", self.rules(""))], fixed)

    def rules(self, folder: str) -> list:
        path = os.path.join(self.root, folder, ".gitignore")
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                return compile_rules(f.read().splitlines())
        except OSError:
            return []

    def hidden(self, rel: str, stack: list, folder: bool = False) -> bool:
        verdict = False
        for base, rules in stack:
            part = rel[len(base) + 1 :] if base else rel
            for pattern, ignores in rules:
                if pattern.match(part) or (folder and pattern.match(part + "/x")):
                    verdict = ignores
        return verdict

    def walk(self, rel: str, stack: list, fixed: list) -> Iterator[tuple]:
        path = os.path.join(self.root, rel)
        try:
            info = os.lstat(path)
            if stat.S_ISDIR(info.st_mode):
                if os.path.basename(rel) in EXCLUDED_DIRS or self.hidden(rel, stack, folder=True) or ignored(rel, fixed):
                    return
                inner = [*stack, (rel, self.rules(rel))]
                for name in sorted(os.listdir(path)):
                    yield from self.walk(f"{rel}/{name}", inner, fixed)
                return
            if not stat.S_ISREG(info.st_mode) or info.st_size > self.max_bytes or self.hidden(rel, stack) or ignored(rel, fixed):
                return
            with open(path, "rb") as f:
                raw = f.read()
        except OSError as e:
            yield (rel, None, None, None, e.strerror or type(e).__name__)
            return
        if b"\x00" not in raw[:SNIFF]:
            yield (rel, len(raw), hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "replace"), None)
