"""Ignore patterns: compiling to regular expressions and matching paths, last match wins."""

from __future__ import annotations

import re

#: Directory names that are never walked.
EXCLUDED_DIRS = [
    ".git", ".hg", ".svn", "node_modules", "dist", "build", "target", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".eggs", ".idea", ".vscode",
]
#: Names of files that hold secrets, as ignore patterns.
SECRET_FILES = [
    ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.jks", "*.keystore", "id_rsa*", "id_ed25519*", "id_ecdsa*", "id_dsa*", "*.ppk", "credentials*", ".netrc", ".npmrc", ".pypirc", "*.tfvars",
    "secrets.*", "*.secret", "**/.aws/**", "**/.ssh/**",
]
#: Lock files that tools write.
LOCK_FILES = [
    "uv.lock", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "Cargo.lock", "poetry.lock", "Pipfile.lock", "go.sum", "composer.lock", "Gemfile.lock",
    "packages.lock.json", "flake.lock",
]


def glob_regex(glob: str) -> str:
    """An anchored expression for a pattern relative to its directory; one without an inner `/` holds at any depth, one that ends in `/` for what lies below."""
    anchored = "/" in glob.rstrip("/")
    g = glob.strip("/") + ("/**" if glob.endswith("/") else "")
    out, i = "", 0
    while i < len(g):
        if g[i] == "\\" and i + 1 < len(g):
            out, i = out + re.escape(g[i + 1]), i + 2
        elif g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif g[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        elif g[i] == "[" and (j := g.find("]", i + 2)) > 0:
            negated = g[i + 1] in "!^"
            out, i = out + "[" + ("^" if negated else "") + g[i + 1 + negated : j].replace("\\", "\\\\") + "]", j + 1
        else:
            out, i = out + re.escape(g[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$"


def compile_rules(lines: list[str]) -> list[tuple[re.Pattern, bool]]:
    """(expression, ignores) of the lines of an ignore file; blank lines and comments are left out, `!` re-includes."""
    rules = []
    for line in lines:
        line = line.rstrip("\r\n")
        line = line if line.endswith("\\ ") else line.rstrip()
        if line and not line.startswith("#"):
            keep = line.startswith("!")
            rules.append((re.compile(glob_regex(line[1:] if keep else line)), not keep))
    return rules


def ignored(path: str, rules: list[tuple[re.Pattern, bool]]) -> bool:
    """Whether the last rule that matches the path, or a directory above it, ignores it.

    What lies below an ignored directory can't be re-included.
    """
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        part = "/".join(parts[:n])
        verdict = False
        for pattern, ignores in rules:
            if pattern.match(part) or (n < len(parts) and pattern.match(part + "/x")):
                verdict = ignores
        if verdict:
            return True
    return False
