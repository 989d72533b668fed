"""One consistent form for texts that look the same but consist of different characters."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.session import cut

#: Letters of the three alphabets and the letter they look like, a Latin one where there is one.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
    "α": "a", "ϲ": "c", "ι": "i", "ϳ": "j", "ο": "o", "ρ": "p", "υ": "u", "ν": "v",
    "ɑ": "a", "ɡ": "g", "ı": "i", "П": "Π", "Г": "Γ", "Ф": "Φ", "к": "κ",
}
#: Of two families of rules that disagree on a source the first one holds; any other disagreement is an error.
SETTLED = {("look-alike", "compatibility")}
CACHE_RUNS, LEARNED = 200_000, 200_000
JOINED_EMOJI = regex.compile(r"(?<=\p{Extended_Pictographic}[️\U0001f3fb-\U0001f3ff]*)‍(?=\p{Extended_Pictographic})")
RUN = regex.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")


def roomless(c: str) -> bool:
    """Characters that take no visible room: format characters, variation selectors, fillers."""
    o = ord(c)
    return (unicodedata.category(c) == "Cf" and o not in range(0x600, 0x606) and o not in (0x6DD, 0x70F, 0x8E2)) or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)


def joins(c: str) -> bool:
    """Whether a character belongs to the cluster of the one before it: marks, and the later letters of a Hangul syllable."""
    return unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff"


Rule = tuple[str, str, str]  # what is read, what it becomes, the family it comes from


@lru_cache(maxsize=1)
def single_rules() -> tuple[Rule, ...]:
    """Rules on one code point, from the character database and the look-alikes."""
    rules = [(c, new, "look-alike") for c, new in LOOKALIKES.items()]
    for o in range(0x80, sys.maxunicode + 1):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if roomless(c):
            rules.append((c, "", "no room"))
        elif kind == "Zs":
            rules.append((c, " ", "space"))
        else:
            parts = unicodedata.normalize("NFKD", c)
            new = "".join(LOOKALIKES.get(x, " " if unicodedata.category(x) == "Zs" else x) for x in parts if not roomless(x))
            new = unicodedata.normalize("NFC", new)
            if new != c:
                rules.append((c, new, "look-alike" if parts == c else "compatibility"))
    return tuple(rules)


@lru_cache(maxsize=1)
def cluster_rules() -> tuple[Rule, ...]:
    """Rules on clusters: each spelling of a letter with accents that the database can compose, the letter itself in any of its forms."""
    forms: dict[str, list[str]] = {}
    single = {c: new for c, new, _ in reversed(single_rules())}
    for c, new in single.items():
        if len(new) == 1:
            forms.setdefault(new, []).append(c)
    rules = []
    for o in range(0x80, 0x30000):
        c = chr(o)
        parts = unicodedata.normalize("NFD", c)
        if 2 <= len(parts) <= 4 and not joins(parts[0]) and all(map(joins, parts[1:])) and not 0xAC00 <= o < 0xD7A4:
            base = single.get(parts[0], parts[0])
            new = unicodedata.normalize("NFC", base + "".join(single.get(x, x) for x in parts[1:]))
            rules += [(x + parts[1:], new, "accent") for x in (base, *forms.get(base, ()))]
    return tuple(dict.fromkeys(rules))


def conflicts(rules: Iterable[Rule]) -> list[tuple[Rule, Rule]]:
    """Pairs of rules that read the same and disagree on what it becomes, but for those that SETTLED decides."""
    seen: dict[str, Rule] = {}
    found = []
    for rule in rules:
        first = seen.setdefault(rule[0], rule)
        if first[1] != rule[1] and (first[2], rule[2]) not in SETTLED:
            found.append((first, rule))
    return found


class Transducer:
    """A trie over the rules; a text is rewritten in one pass, by the longest rule that matches at each place.

    Characters without room are passed over inside a match too, so they cannot part a letter
    from its accent. A cluster that goes on behind the longest match, as with two accents in
    either order, is composed once and becomes a rule of its own (up to LEARNED). Rules must
    not disagree, and what they give must stay as it is under the rules. Joiners between
    emoji stay, since they change what is seen. Runs of non-ASCII characters, each with the
    character before it, are remembered up to CACHE_RUNS.
    """

    def __init__(self, rules: Iterable[Rule] | None = None):
        rules = list(rules) if rules is not None else [*single_rules(), *cluster_rules()]
        if bad := conflicts(rules):
            raise ValueError("rules disagree: " + "; ".join(f"{a[0]!a} to {a[1]!a} ({a[2]}) and to {b[1]!a} ({b[2]})" for a, b in bad[:5]))
        self.root: dict = {}
        self.known: dict[str, str] = {}
        self.learned = 0
        self.nothing = {c for c, new, family in rules if family == "no room"}
        self.single: dict[str, str] = {}
        for source, new, _ in rules:
            self.add(source, new)
            if len(source) == 1:
                self.single.setdefault(source, new)
        self.marks = {c for c, new in self.single.items() if new and joins(new[0])}
        for source, new, family in rules:
            if self.rewrite(new) != new:
                raise ValueError(f"what {source!a} becomes ({family}) becomes something else again")

    def add(self, source: str, new: str) -> None:
        """The first rule for a source stays."""
        node = self.root
        for c in source:
            node = node.setdefault(c, {})
        node.setdefault("", new)

    def rewrite(self, s: str) -> str:
        root, nothing, marks = self.root, self.nothing, self.marks
        kept = {m.start() for m in JOINED_EMOJI.finditer(s)} if "‍" in s else ()
        out, at, size = [], 0, len(s)
        while at < size:
            node, i, end, new = root, at, at, None
            while i < size:
                c = s[i]
                if c in nothing:
                    if i in kept:
                        break
                    i += 1
                    if node is root:
                        at = end = i
                    continue
                node = node.get(c)
                if node is None:
                    break
                i += 1
                if "" in node:
                    end, new = i, node[""]
            if at == size:
                break
            if new is None:
                end, new = at + 1, s[at]
            if end < size and (s[end] >= "\x80"):
                stop = end
                while stop < size and stop not in kept and (s[stop] in nothing or s[stop] in marks or joins(s[stop])):
                    stop += 1
                tail = [c for c in s[end:stop] if c not in nothing]
                if tail:
                    source = "".join(c for c in s[at:stop] if c not in nothing)
                    new = unicodedata.normalize("NFC", "".join(self.single.get(c, c) for c in source))
                    if self.learned < LEARNED:
                        self.learned += 1
                        self.add(source, new)
                    end = stop
            out.append(new)
            at = end
        return "".join(out)

    def run(self, m) -> str:
        s = m[0]
        new = self.known.get(s)
        if new is None:
            if len(self.known) > CACHE_RUNS:
                self.known.clear()
            new = self.rewrite(s)
            if len(s) <= 64:
                self.known[s] = new
        return new

    def apply(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        return RUN.sub(self.run, text)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    return Transducer()


def consistent(text: Column) -> Column:
    """The consistent form. Null stays null, empty stays empty, ASCII texts stay as they are."""

    @F.pandas_udf("string")
    def form(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer()
        for s in batches:
            yield pd.Series([t.apply(x) for x in s], index=s.index, dtype=object)

    wide = text.rlike(r"[^\x00-\x7F]")
    return F.when(wide, form.asNondeterministic()(F.when(wide, text))).otherwise(text)


def keyed_forms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, `form_hash` of the consistent form and `text_hash` of the text; null and blank texts are left out."""
    form = docs.select(F.col(key).alias("id"), consistent(F.col(text)).alias("form"), F.sha2(F.col(text), 256).alias("text_hash"))
    shown = form.where(F.col("form").isNotNull() & F.col("form").rlike(r"[^\s\p{Cc}]"))
    return shown.select("id", F.unhex(F.sha2("form", 256)).alias("form_hash"), F.unhex("text_hash").alias("text_hash"))


def alike_pairs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_a < doc_b with equal forms and different texts.

    Only classes (distinct texts) are paired with each other; a class is then expanded to its
    documents, so a text with very many exact copies is never compared with itself. Each pair
    comes once; repeated ids give no pair with themselves.
    """
    forms = cut(keyed_forms(docs, key, text))
    mixed = forms.groupBy("form_hash").agg(F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi")).where("lo <> hi").select("form_hash")
    rows = forms.join(mixed, "form_hash", "left_semi")
    classes = rows.select("form_hash", "text_hash").distinct()
    other = classes.withColumnRenamed("text_hash", "other_hash")
    pairs = classes.join(other, "form_hash").where("text_hash < other_hash").select("text_hash", "other_hash")
    left = rows.select("text_hash", F.col("id").alias("a"))
    right = rows.select(F.col("text_hash").alias("other_hash"), F.col("id").alias("b"))
    met = pairs.join(left, "text_hash").join(right, "other_hash").where("a <> b")
    return met.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))


def alike_classes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Membership: key, `class_id` (the smallest key of the same form), `texts` (distinct texts of the form) and `docs` of each class with more than one text.

    Grows with the documents however large a class is; the pairs of a class follow from it.
    Repeated keys count once.
    """
    forms = keyed_forms(docs, key, text).distinct()
    sizes = forms.groupBy("form_hash").agg(F.min("id").alias("class_id"), F.count("*").alias("docs"), F.min("text_hash").alias("lo"), F.max("text_hash").alias("hi"), F.approx_count_distinct("text_hash").alias("texts"))
    return forms.join(sizes.where("lo <> hi"), "form_hash").select(F.col("id").alias(key), "class_id", "docs", F.greatest("texts", F.lit(2)).alias("texts"))
