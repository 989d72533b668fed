"""Column expressions on text: words, estimates, snippets, languages; words of Arrow batches of texts."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwork.functions.paths import suffix

#: File suffixes and their language.
SUFFIXES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".go": "go", ".rs": "rust",
    ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".sh": "bash", ".bash": "bash", ".html": "html", ".htm": "html", ".css": "css", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".toml": "toml", ".md": "markdown", ".sql": "sql",
}


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits in order; null texts give no words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


#: Ranges of characters whose lower case and kind cut_words knows: no character here has a lower case that is longer or depends on its neighbours (as those of U+0130 and U+03A3).
PLAIN = [(0x0, 0x12F), (0x131, 0x24F), (0x300, 0x377), (0x37A, 0x37F), (0x384, 0x3A1), (0x3A4, 0x52F), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2190, 0x23FF), (0x2500, 0x27BF), (0x3000, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0xFB00, 0xFB06), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF5E), (0x1F300, 0x1FAFF)]


def plain(text: Column) -> Column:
    """Whether a text has characters of PLAIN only, as nearly all have."""
    text = F.coalesce(text, F.lit(""))
    latin, other = ("[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in some) + "]++" for some in (PLAIN[:1], PLAIN[1:]))
    return (F.octet_length(text) == F.char_length(text)) | text.rlike(f"^(?:{latin}|{other})*+\\z")


#: Stands for a character beyond PLAIN.
ODD = 0xFFFFFFFF


@cache
def _lowered() -> np.ndarray:
    """The lower case of each letter and digit of PLAIN, 0 for its other characters, ODD for those beyond, up to the first that is above all of PLAIN."""
    table = np.full(PLAIN[-1][1] + 2, ODD, np.uint32)
    for a, b in PLAIN:
        for c in range(a, b + 1):
            table[c] = ord(chr(c).lower()) if unicodedata.category(chr(c))[0] in "LN" else 0
    return table


def _lower(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts in order: in lower case, 0 if no letter or digit, ODD if beyond PLAIN; and where each text begins. No text may be null."""
    ends = np.append(0, np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_py()
    return np.take(_lowered(), np.frombuffer(joined.encode("utf-32-le"), np.uint32), mode="clip"), ends


def _broken(text: pa.Scalar) -> bool:
    try:
        text.as_py()
    except UnicodeDecodeError:
        return True
    return False


def cut_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all texts in order, as `words` gives them; the texts must be plain, null texts have none."""
    return _cut(*_lower(pc.fill_null(texts, "")))


def cut_plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which texts are left uncut, as they have characters beyond PLAIN or bytes that are no characters, and what cut_words gives with these texts empty. No text may be null."""
    odd = np.zeros(len(texts), bool)
    while True:
        try:
            low, ends = _lower(pc.if_else(pa.array(odd), "", texts) if odd.any() else texts)
        except UnicodeDecodeError:
            odd = np.array([_broken(t) for t in texts])
            continue
        if not (low == ODD).any():
            return odd, *_cut(low, ends)
        odd[np.searchsorted(ends, np.flatnonzero(low == ODD), "right") - 1] = True


def _cut(low: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    inside = low != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    rows = ends[:-1][ends[:-1] < len(low)]
    starts[rows] = inside[rows]
    at = np.flatnonzero(starts)
    kept = low[inside]
    size = 1 + (kept >= 0x80).astype(np.int8) + (kept >= 0x800)
    first = np.cumsum(inside)[at] - 1
    offsets = np.append(np.append(0, np.cumsum(size, dtype=np.int64))[first], size.sum(dtype=np.int64)).astype(np.int32)
    data = kept.astype("<u4").tobytes().decode("utf-32-le").encode()
    return np.diff(np.searchsorted(at, ends)), pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def visible(text: Column) -> Column:
    """Number of characters that are not white space."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""))


def token_estimate(text: Column) -> Column:
    """Tokens a text is budgeted for: a quarter of its visible characters, rounded up."""
    return F.ceil(visible(text) / 4).cast("bigint")


def snippet(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def language_of(path: Column) -> Column:
    """Language by suffix; null for other suffixes and for names that are all suffix."""
    table = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    return F.element_at(table, suffix(path))
