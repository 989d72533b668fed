"""Generated, minified, vendored and data files among source files.

Repositories with attribute files say which of their paths are generated or vendored. For all
others the same kind of rules is mined: what files that are declared, or that their content
gives away, have in common in their paths and in the comment they begin with.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwork.functions.globs import glob_regex
from tarnwork.functions.paths import ancestors, basename
from tarnwork.session import cut

ATTRIBUTES = ".gitattributes"
#: A mined rule: files, projects and the lower bound of the share that is known not to be hand-written.
MIN_SUPPORT, MIN_PROJECTS, MIN_RATE = 6, 3, 0.6
#: Copied code: runs of so many lines, the least of every so many neighbours, known in so many projects, on so much of a file.
RUN_LINES, WINNOW, COPY_PROJECTS, COPY_SHARE = 4, 4, 2, 0.5

COMMENT = re.compile(r"\s*(?://|#(?!\s*(?:include|define|if|ifdef|ifndef|endif|pragma|else|undef|error)\b|!?\[)|--|/\*|\*|;|<!--|\"\"\")")
LONG_LINE = 200
STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
NAME, NUMBER = re.compile(r"[^\W\d]\w*"), re.compile(r"\d[\d.]*")
DATUM = re.compile(r"[-+]?(?:0x[0-9a-fA-F]+|\d+\.?\d*(?:[eE][-+]?\d+)?)\s*(?:,|$)|[\"'][A-Za-z0-9+/=_-]{24,}[\"']", re.M)
SIGNS = re.compile(r"[;{}()=,:?&|]")


#: Lines that files of any origin share: imports, names of imported things, brackets alone.
COMMON = re.compile(r"(?:import|from|use|using|package|require|#\s*include)\b|[\"'][^\"']*[\"'],?$|\W*$")
GRAM_WORD = re.compile(r"[^\W\d_]+")


def grams(line: str) -> list[str]:
    """Three words in a row of a comment line, or all of a shorter one; digits and signs don't count."""
    words = GRAM_WORD.findall(line.lower())
    return [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []


def code_runs(lines: list[str]) -> list[int]:
    """Hashes of runs of RUN_LINES lines, of which the least in every WINNOW neighbours are kept.

    Two files that share RUN_LINES + WINNOW - 1 lines in a row have one of them in common.
    """
    each = [xxhash.xxh64_intdigest("\n".join(lines[i : i + RUN_LINES]).encode("utf-8", "replace")) - (1 << 63) for i in range(len(lines) - RUN_LINES + 1)]
    return sorted({min(each[i : i + WINNOW]) for i in range(max(1, len(each) - WINNOW + 1))}) if each else []


def marks(text: str, first: bool) -> tuple:
    """Of one piece of a file: lines, characters, characters in minified lines and in data,
    lines of a piece with repeating shapes, word triples of the comment a file begins with, hashes of its code."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    chars = sum(map(len, lines))
    tight = 0
    for x in lines:
        if len(x) > LONG_LINE and len(SIGNS.findall(x)) > 0.15 * len(x) and x.count(" ") < 0.1 * len(x):
            tight += len(x)
    data = sum(map(len, DATUM.findall(text))) if chars else 0
    head = 0
    while head < len(lines) and COMMENT.match(lines[head]):
        head += 1
    said = list(dict.fromkeys(g for x in lines[:head] for g in grams(x))) if first else []
    code = lines[head:]
    shaped = 0
    if len(code) >= 8:
        kinds = Counter(x.strip() for x in NUMBER.sub("0", NAME.sub("i", STRING.sub("s", "\n".join(code)))).split("\n"))
        top = sum(n for _, n in kinds.most_common(3)) / len(code)
        if (len(code) >= 10 and top >= 0.62 and len(kinds) <= max(3, 0.15 * len(code))) or (top >= 0.85 and len(kinds) <= max(4, 0.2 * len(code))):
            shaped = len(lines)
    return len(lines), chars, tight, data, shaped, said, code_runs([y for x in code if not COMMON.match(y := x.strip())])


MARKS = "lines bigint, chars bigint, tight bigint, data bigint, shaped bigint, said array<string>, runs array<bigint>, declared string, first_line bigint"


def piece_marks(chunks: DataFrame) -> DataFrame:
    """project_id, path, file_hash and the marks of every piece; `declared` is the text of attribute files.

    Texts are read whole and only here; what goes on from here is a few numbers a piece.
    Null texts count as empty.
    """
    keep = ["project_id", "path", "file_hash", "chunk_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in MARKS.split(", ")]
        for pdf in batches:
            texts = pdf["text"].fillna("")
            rows = [marks(t, f <= 1) for t, f in zip(texts, pdf["start_line"].fillna(1))]
            got = pd.DataFrame(rows, columns=names[:-2], index=pdf.index)
            got["declared"] = [t if isinstance(p, str) and p.rpartition("/")[2] == ATTRIBUTES else None for p, t in zip(pdf["path"], texts)]
            got["first_line"] = pdf["start_line"].fillna(1).astype("int64")
            yield pd.concat([pdf[keep], got], axis=1)

    kinds = dict(chunks.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", " + MARKS
    return chunks.select(*keep, "start_line", "text").mapInPandas(run, schema)


_glob = F.udf(glob_regex, T.StringType())


def declared_texts(files: DataFrame, pieces: DataFrame) -> DataFrame:
    """project_id, path, declared: the whole text of each attribute file, its pieces in the order of their lines.

    `files` gives the content_hash of each path, in any language. Of a listed attribute file only
    the pieces of that content count; of one that is not listed those of one content, the
    highest hash, since contents aren't mixed.
    """
    key = ["project_id", "path"]
    found = pieces.where("declared IS NOT NULL").select(*key, "file_hash", F.struct("first_line", "chunk_id", "declared").alias("piece")).distinct()
    whole = found.groupBy(*key, "file_hash").agg(F.array_join(F.transform(F.sort_array(F.collect_list("piece")), lambda x: x["declared"]), "").alias("declared"))
    hashes = files.where(F.element_at(F.split("path", "/"), -1) == ATTRIBUTES).groupBy(*key).agg(F.max("content_hash").alias("content_hash"), F.lit(True).alias("listed"))
    met = whole.join(hashes, key, "left").where(F.col("listed").isNull() | F.col("file_hash").eqNullSafe(F.col("content_hash")))
    return met.groupBy(*key).agg(F.max_by("declared", F.coalesce("file_hash", F.lit(""))).alias("declared"))


def attribute_rules(declared: DataFrame) -> DataFrame:
    """project_id, folder, and the rules of its attribute file that mark paths as (not) generated or vendored, in their order: expression, value."""
    lines = declared.select("project_id", F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("folder"), F.posexplode(F.split("declared", r"\r?\n")).alias("line", "rule"))
    parts = F.split(F.trim("rule"), r"\s+")
    marked = lines.where(F.col("rule").rlike(r"^\s*[^#\s]\S*\s.*linguist-(?:generated|vendored)"))
    unset = F.col("rule").rlike(r"\s(?:[-!]linguist-(?:generated|vendored)|linguist-(?:generated|vendored)=(?:false|0|off))(?:\s|$)")
    each = marked.select("project_id", "folder", F.struct("line", _glob(parts[0]).alias("expression"), (~unset).alias("value")).alias("rule"))
    return each.groupBy("project_id", "folder").agg(F.transform(F.sort_array(F.collect_list("rule")), lambda r: F.struct(r["expression"], r["value"])).alias("rules"))


@lru_cache(maxsize=10_000)
def _compiled(expression: str) -> re.Pattern:
    return re.compile(expression)


@F.pandas_udf(T.BooleanType())
def _last_match(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The value of the last rule that matches a path below the folder of the rules, null if none does."""
    for paths, rules in batches:
        yield pd.Series([next((r["value"] for r in reversed(rs) if _compiled(r["expression"]).match(p)), None) for p, rs in zip(paths, rules)], dtype=object)


def declared_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """project_id, path, declared: of the attribute files above a path, the deepest with a matching rule and in it the last one hold.

    A path is joined with the rules of the folders above it, which are as few as it is deep.
    """
    above = F.concat(F.array(F.lit("")), ancestors(F.col("path")))
    met = files.select("project_id", "path", F.posexplode(above).alias("depth", "folder")).join(rules, ["project_id", "folder"])
    rest = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    found = met.select("project_id", "path", "depth", _last_match(rest, "rules").alias("value")).where("value IS NOT NULL")
    return found.groupBy("project_id", "path").agg(F.max_by("value", "depth").alias("declared"))


def patterns_of(path: Column, said: Column | None = None) -> Column:
    """What a file can be recognised by: each directory name, the last word of the file name with its suffix, and the word triples of its first comment."""
    folders = F.transform(ancestors(path), lambda a: F.concat(basename(a), F.lit("/")))
    tail = F.regexp_extract(basename(path), r"((?:[._][A-Za-z0-9]+|(?<=[a-z])[A-Z][a-z]+)\.[A-Za-z]+)$", 1)
    named = F.filter(F.concat(folders, F.array(tail)), lambda x: x != "")
    spoken = F.transform(F.coalesce(said, F.array().cast("array<string>")), lambda x: F.concat(F.lit("# "), x)) if said is not None else F.array().cast("array<string>")
    return F.array_distinct(F.concat(named, spoken))


def mined_patterns(evidence: DataFrame, support: int = MIN_SUPPORT, projects: int = MIN_PROJECTS, rate: float = MIN_RATE) -> DataFrame:
    """Patterns whose files are known to be not hand-written: enough files and projects, and a Wilson lower bound of at least `rate`.

    `evidence` needs project_id, pattern, known. Counted on the map side first, so a pattern that
    very many files have is a row a task.
    """
    per = evidence.groupBy("pattern", "project_id").agg(F.count("*").alias("n"), F.count_if("known").alias("k"))
    seen = per.groupBy("pattern").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("p"))
    share, n, z = F.col("k") / F.col("n"), F.col("n"), 1.645
    low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return seen.where((F.col("k") >= support) & (F.col("p") >= projects) & (low >= rate)).select("pattern")


def copied_shares(files: DataFrame, projects: int = COPY_PROJECTS) -> DataFrame:
    """file, copied: of each file's runs of lines, the number that files of at least `projects` projects have.

    `files` needs project_id, file and runs. Runs are shuffled once, by their hash; both the
    count of projects and the way back to the files keep to that.
    """
    each = files.select("project_id", "file", F.explode("runs").alias("run")).repartition("run")
    wide = each.groupBy("run", "project_id").agg(F.lit(1).alias("one")).groupBy("run").agg(F.count("*").alias("p")).where(F.col("p") >= projects).select("run")
    return each.join(wide, "run", "left_semi").groupBy("file").agg(F.count("*").alias("copied"))


def known_files(files: DataFrame, pieces: DataFrame, languages: list[str]) -> DataFrame:
    """project_id, path, `declared` by an attribute file, the `reason` that its content gives, and the `patterns` of every file in the given languages."""
    key = ["project_id", "path"]
    listed = files.where(F.col("language").isin(languages) & F.col("project_id").isNotNull() & F.col("path").isNotNull())
    listed = listed.groupBy(*key).agg(F.max("content_hash").alias("content_hash"))
    numbers = ["lines", "chars", "tight", "data", "shaped"]
    each = pieces.repartition(*key).groupBy(*key, "file_hash", "chunk_id").agg(*[F.max(c).alias(c) for c in (*numbers, "said", "runs")])
    version = each.groupBy(*key, "file_hash").agg(*[F.sum(c).alias(c) for c in numbers], F.flatten(F.collect_list("said")).alias("said"), F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))
    met = listed.join(version, key, "left")
    order = F.struct(F.col("file_hash").eqNullSafe(F.col("content_hash")).alias("c"), F.col("file_hash").alias("h"))
    file = met.groupBy(*key).agg(F.max_by(F.struct(*numbers, "said", "runs"), order).alias("v")).select(*key, F.xxhash64(*key).alias("file"), "v.*")
    declared = declared_paths(listed.select(*key), attribute_rules(declared_texts(files, pieces)))
    lines, chars, all_runs = F.greatest("lines", F.lit(1)), F.greatest("chars", F.lit(1)), F.greatest(F.size("runs"), F.lit(1))
    reason = F.when(F.col("tight") > 0.5 * chars, "minified").when(F.col("data") > 0.5 * chars, "data").when(F.col("shaped") > 0.6 * lines, "shape").when(F.col("copied") > COPY_SHARE * all_runs, "copy")
    return (
        file.join(copied_shares(file), "file", "left").join(declared, key, "left")
        .select(*key, "declared", reason.alias("reason"), patterns_of(F.col("path"), F.col("said")).alias("patterns"))
    )


def rules_of(known: DataFrame) -> DataFrame:
    """The patterns mined from known_files, declared files and those with a reason being the evidence."""
    return mined_patterns(known.select("project_id", F.coalesce("declared", F.col("reason").isNotNull()).alias("known"), F.explode("patterns").alias("pattern")))


def not_hand_written(files: DataFrame, pieces: DataFrame, languages: list[str], rules: DataFrame | None = None) -> DataFrame:
    """project_id, path, reason of files in the given languages that nobody in the project wrote.

    `pieces` is piece_marks, written or checkpointed. Reasons, first that holds: declared (an
    attribute file), mined (a rule mined from declared files and those with evidence), and the
    evidence itself where no rule was mined: minified, data, shape (lines of few shapes, as
    tools write them), copy (code that several projects have). A file declared not generated or
    vendored is never reported and counts as hand-written in mining. `rules` (a column `pattern`)
    takes the place of mining, for a corpus too small for it, with those of a larger one.

    - The pieces of the file's current content count; without any, those of its latest other one.
    - Attribute files count with their current content only and are read whole.
    - Repeated pieces count once. A file without pieces is judged by its path.
    - Rows with a null project or path are left out; a null language is not listed.
    """
    key = ["project_id", "path"]
    known = cut(known_files(files, pieces, languages))  # read for the rules, for their use and for the result
    rules = rules_of(known) if rules is None else rules
    mined = known.select(*key, F.explode("patterns").alias("pattern")).join(rules, "pattern", "left_semi").select(*key).distinct().withColumn("mined", F.lit(True))
    done = known.drop("patterns").join(mined, key, "left")
    final = F.when(F.col("declared"), "declared").when(F.col("declared").isNull(), F.coalesce(F.when(F.col("mined"), "mined"), "reason"))
    return done.select(*key, final.alias("reason")).where("reason IS NOT NULL")
