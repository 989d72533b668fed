"""Verdicts on mutated files against the languages' own parsers."""

import ast
import json
import random
import re
import subprocess
import tomllib
import warnings

import pyarrow.parquet as pq
import pytest

from tarnwork.llm.syntax import parser


def _python(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ast.parse(text)


def _json(text):
    json.loads(text, parse_constant=lambda _: 1 / 0)


def _bash(text):
    subprocess.run(["bash", "-n"], input=text.encode(), check=True, capture_output=True)


def _toml(text):
    try:
        tomllib.loads(text)
    except ValueError as e:  # a repeated key is no matter of the grammar
        if not re.search(r"overwrite|twice|mutate", str(e)):
            raise


JUDGES = {"python": _python, "json": _json, "toml": _toml, "bash": _bash}
AGREE = {"python": 0.99, "json": 1.0, "toml": 0.98, "bash": 0.97}


def valid(judge, text):
    try:
        judge(text)
        return True
    except (SyntaxError, ValueError, ZeroDivisionError, subprocess.CalledProcessError, RecursionError):
        return False


def mutated(text, r):
    """One small damage: a token or a line gone, repeated or swapped, the end cut off, a sign put in."""
    toks = [m.span() for m in re.finditer(r"\\w+|[^\\w\\s]", text)]
    (a, b), (c, d) = sorted(r.sample(toks, 2))
    lines = text.split("\n")
    n = r.randrange(len(lines))
    return r.choice([
        text[:a] + text[b:], text[:b] + text[a:b] + text[b:], text[:a] + text[c:d] + text[b:c] + text[a:b] + text[d:], text[: r.randrange(len(text))], text[:a] + r.choice("()[]{}:;,.='\"") + text[a:],
        "\n".join(lines[:n] + lines[n + 1 :]), "\n".join(lines[: n + 1] + [lines[n]] + lines[n + 1 :]), text[:a] + "\n<<<<<<< HEAD\n" + text[a:],
    ])


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table("/root/testdata/sf0.1/chunks.parquet", columns=["project_id", "file_path", "file_hash", "start_line", "chunk_id", "language", "text"]).to_pylist()
    files = {}
    for r in rows:
        if r["language"] in JUDGES:
            files.setdefault((r["language"], r["project_id"], r["file_path"], r["file_hash"]), {})[r["chunk_id"]] = (r["start_line"], r["text"])
    out = {}
    for (language, *_), pieces in sorted(files.items()):
        text = "".join(t for _, t in sorted(pieces.values()))
        if min(pieces.values())[0] == 1 and 40 < len(text) < 20_000:
            out.setdefault(language, []).append(text)
    return out


@pytest.mark.parametrize("language", sorted(JUDGES))
def test_mutations(language, texts):
    r = random.Random(11)
    judge, mine = JUDGES[language], parser(language)
    whole = [t for t in texts[language] if valid(judge, t)]
    assert len(whole) > 20 and all(mine.judge(t)[0] for t in whole)
    cases = [mutated(r.choice(whole), r) for _ in range(400)]
    verdicts = [(valid(judge, t), mine.judge(t)[0]) for t in cases]
    same = sum(a == b for a, b in verdicts) / len(cases)
    assert 0.02 < sum(a for a, _ in verdicts) / len(cases) < 0.9 and same >= AGREE[language], same
