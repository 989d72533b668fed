"""Credentials embedded in source code and configuration.

Every string-like run of a text is measured first, in characters per subword of a public
vocabulary. Only runs that are unnatural by that measure are looked at further; context then
says how unnatural a value must be to count: a string that nothing explains more than one under
the name of a secret, and that one more than one under the name of a password.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.tokens import WORDS, load_ranks, vocabulary

#: Characters per subword below which a value may be a credential, by what its context says. Random
#: strings lie below 1.9, code between 2 and 4, single words above 6.
UNNATURAL = {"unnamed": 1.9, "secret": 2.7, "password": 6.0}
MASK = "x"
KNOWN_RUNS = 300_000

#: A string-like run: what neither white space, quotes, brackets nor the signs around a value end.
RUN = re.compile(r"[^\s\"'`,;(){}\[\]<>|=:@/\\]{4,}")
#: Letters beside digits or signs, or digits alone: what a password has and a name in code has not.
MIXED = re.compile(r"(?=.*[^\W\d_])(?=.*[^A-Za-z_.\-])|\d{6,}$|.*-\d+$")

#: How tokens of public services begin.
ISSUED = r"(?:gh[pousr]_|github_pat_|glpat-|npm_|pypi-|xox[abeprs]-|[sr]k_(?:live|test)_|whsec_|shpat_|hvs\.|dop_v1_|AIza|SG\.|ya29\.)"
PASSWORD = {"password", "passwd", "pwd", "pass", "passphrase", "pw", "passcode"}
SECRET = {"secret", "token", "credential", "credentials", "auth", "authorization", "apikey", "key", "signing", "bearer", "jwt", "cookie", "session"}
#: A last word that makes the name one of a place, a form field or a measure rather than of a secret.
ABOUT = {"url", "uri", "ref", "field", "header", "name", "names", "path", "file", "env", "var", "ttl", "length", "len", "count", "type", "policy", "prompt", "label", "hint", "regex", "pattern", "endpoint", "host", "expiry", "min", "max", "id", "ids", "reference", "alias", "column", "param", "prefix", "placeholder", "rule", "rules", "message", "error", "source", "store", "provider", "scheme", "algorithm"}
HARMLESS = {"public", "sha", "sha1", "sha256", "sha512", "md5", "checksum", "commit", "revision", "integrity", "digest", "hash", "etag", "fingerprint", "uuid", "guid", "cert", "certificate", "primary", "foreign", "sort", "cache", "partition"}

NAME = r"[A-Za-z_][\w.\-]{0,50}"
QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
JOIN = r"\s*(?:(?:\+|\.\.?|\\)\s*)?(?://[^\n]*\s*)?"
#: The first piece of a literal; MORE are those that follow, however many.
FIRST = rf"(?:{QUOTED})"
MORE = re.compile(rf"(?:{JOIN}(?:{QUOTED}))*")
#: Where the value of a name may open on a later line than the name.
OPENS = re.compile(r"\s*(?:\w+\(?|\()?[\"'`][^\n]*")
ASSIGNED = re.compile(rf"(?P<name>{NAME})(?:[\"'`]?\]?)[ \t]*(?::[ \t]*[&\w<>?\[\]' |]{{1,30}}=|:=|=>|==?|:)[ \t]*(?:\(?\s*)(?:\w*\(?(?=[\"'`]))?(?P<value>{FIRST})")
PAIRED = re.compile(rf"(?P<q>[\"'`])(?P<name>{NAME})(?P=q)[ \t]*,[ \t]*(?P<value>{FIRST})")
DEFINED = re.compile(rf"(?:#define|IDENTIFIED BY|PASSWORD|(?<=\s)--?[a-z-]*(?:password|passwd|token|secret|key)[a-z-]*)[ \t=]+(?:(?P<name>\w+)[ \t]+)?(?P<value>{FIRST})", re.I)
BARE = re.compile(rf"(?P<name>{NAME})[\"'`]?(?:[ \t]*[:=][ \t]*|[ \t]+is[ \t]+)(?P<value>[^\s\"'`,;(){{}}\[\]<>|]{{4,}})")
FLAG = re.compile(r"--?(?P<name>[a-z-]*(?:password|passwd|token|secret|api-key|apikey|pass))(?:=|[ \t]+)(?P<value>[^\s\"'`$,;(){}\[\]<>|-][^\s\"'`,;(){}\[\]<>|]{5,})")
CALLED = re.compile(
    r"(?:mysql\w*|mariadb\w*|sshpass)\b[^\n]*?\s-p[ \t]*(?P<q>[\"']?)(?P<value>[^\s\"'$-][^\s\"']{3,})(?P=q)|redis-cli\b[^\n]*?\s-a[ \t]+[\"']?(?P<redis>[^\s\"'$-][^\s\"']{3,})"
    r"|curl\b[^\n]*?\s(?:-u|--user)[ \t]+[\"']?[\w.@-]+:(?P<user>[^\s\"'$][^\s\"']{3,})|\s(?:-H|--header)[ \t]+[\"'](?P<name>[\w-]*(?:auth|key|token|secret|pass)[\w-]*)[ \t]*:[ \t]*(?P<header>[^\s\"']{4,})[\"']",
    re.I,
)
BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"-----END [A-Z0-9 ]+-----")
STARTS = re.compile(rf"(?<![A-Za-z0-9_])(?:{ISSUED}[A-Za-z0-9_\-.]*|(?:AKIA|ASIA)[A-Z0-9]*|eyJ[A-Za-z0-9_\-]{{6,}}[A-Za-z0-9_\-.]*)")
SCHEME = re.compile(r"\b(?P<how>Basic|Bearer|basic|bearer|BASIC|BEARER)[ \t]+(?P<value>[A-Za-z0-9+/_\-.~]{8,}={0,2})")
LOGIN = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://(?P<user>[^\s/@:\"'`<>]*):(?P<value>[^\s/@\"'`]+)@[^\s\"'`]*")
QUERY = re.compile(r"\bhttps?://[^\s\"'`<>?]*\?(?:[^\s\"'`<>&]*&)*?(?P<name>key|sig|signature|auth|access_token|auth_token|token|api_?key|secret|client_secret|password|passwd|pwd|code|sas|credential)=(?P<value>[^\s\"'`<>&]{6,})[^\s\"'`<>]*", re.I)
HOOK = re.compile(r"\bhttps?://(?:[^\s\"'`/]*hooks?\.[^\s\"'`/]*/|[^\s\"'`]*/(?:web)?hooks?/)[^\s\"'`]*?(?P<value>[A-Za-z0-9_\-]{16,})(?=[\s\"'`/?]|$)")
PIECE = re.compile(QUOTED)
NEXT = re.compile(rf"[\"'`]{JOIN}(?P<quote>[\"'`])(?P<more>[A-Za-z0-9_\-.+/=]+)")

#: Pieces that a call puts together are set off by commas.
LISTED = re.compile(r"(?:concat\w*!?|join|strcat|format)\s*\([^)]*$|\[\s*[\"'`]$")
NEXT_LISTED = re.compile(r"[\"'`]\s*[,+]?\s*(?P<quote>[\"'`])(?P<more>[A-Za-z0-9_\-.+/=]+)")
SAID = re.compile(r"\b(?P<name>password|passwd|passphrase|pwd|PIN)[ \t]+(?:is[ \t]+|:[ \t]*)?[\"'`]?(?P<value>[^\s\"'`,;(){}\[\]<>|]{5,})", re.I)

PLACEHOLDER = re.compile(
    r"^(?:\$|%\(|%s|<|\{|\*+$|[xX]{4,}|\.{3,}|#\{|@|(?:ENC|enc|AES|age|sops|kms|crypt)[\[(:]|\{cipher\}|[a-z][a-z0-9+\-]*://(?![^\s/]*:[^\s/]*@)"
    r"|(?:todo|fixme|tbd|n/?a|none|null|nil|true|false|undefined|changeme|dummy|fake|foo|bar|redacted|hidden|masked|secret|password|passwd|token|string|required|optional|unset|empty|default)$"
    r"|(?:change|replace|insert|enter|set|add|put|fill)[-_ ]?(?:me|this|it|in|here|your|with|a|the)\b|your[-_ ]|my[-_]?(?:secret|password|token|key)|example|placeholder|sample[-_]?(?:key|token|secret|password)$|test[-_]?(?:key|token|secret|password)$)"
    r"|EXAMPLE|\$\{|\{\{|<[a-z_-]+>|x{6,}|\*{4,}|0{8,}|_HERE$|-here\W*$",
    re.I,
)
FORM = re.compile(r"^(?:[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Z][a-z]+(?:-[A-Z][a-z]+)+|X(?:-[A-Za-z]+)+|[a-z]+(?:[./:][a-z]+)+|[a-z]+(?:_[a-z]+)*|[a-z]+(?:-[a-z]+)*|[a-z]+(?:[A-Z][a-z]+)+|[A-Z][a-z]*(?:[A-Z][a-z]+)*|[-\d.]+[a-z%]{0,2})$")
UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
HEX = re.compile(r"^(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{32,}$|^(?=[A-F]*\d)(?=\d*[A-F])[0-9A-F]{32,}$")
CODE = {".py", ".js", ".ts", ".go", ".java", ".rs", ".c", ".h", ".sql", ".jsx", ".tsx", ".mjs"}
COMMENT = re.compile(r"(?://|#|--|/\*|<!--|^\s*\*)")


def words_of(name: str) -> list[str]:
    return [w.lower() for w in NAME_WORDS.findall(name)]


def kind_of(name: str) -> str | None:
    """password, secret or None, by the words of a name."""
    words = [w for w in words_of(name) if not w.isdigit()]
    if not words or words[-1] in ABOUT or HARMLESS.intersection(words) or any(a + b in HARMLESS for a, b in zip(words, words[1:])):
        return None
    if PASSWORD.intersection(words):
        return "password"
    if SECRET.intersection(words) or any(w.endswith(("password", "passwd", "secret", "token", "apikey")) for w in words):
        return "password" if any(w.endswith(("password", "passwd")) for w in words) else "secret"
    return None


#: What a line must hold for a name on it to be one of a password or secret.
TELLING = ("pass", "pwd", "secret", "token", "cred", "auth", "key", "signing", "pw", "jwt", "cookie", "session", "bearer", "identified by")
BEGINNINGS = ("gh", "glpat-", "npm_", "pypi-", "xox", "k_live_", "k_test_", "whsec_", "shpat_", "hvs.", "dop_v1_", "aiza", "sg.", "ya29.", "akia", "asia", "eyj")
TOOLS = ("mysql", "mariadb", "sshpass", "redis-cli", "curl", " -h", "\t-h", "--header")
#: A literal that looks random whatever it is called: no base64 of full lines, no hexadecimal digits alone.
RANDOM = re.compile(r"(?P<q>[\"'`])(?P<value>(?=[^\"'`\n]*[a-z])(?=[^\"'`\n]*[A-Z])(?=[^\"'`\n]*\d)[A-Za-z0-9_+/\-.~!#$%^&*]{20,64}={0,2})(?P=q)")
EXPLAINED = re.compile(r"sha\d|md5|hash|digest|checksum|integrity|commit|revision|etag|fingerprint|uuid|guid|cert|public|oid\b|base64|data:|nonce|cursor|thumb|pixel|glyph|icon|image|font", re.I)


@lru_cache(maxsize=2)
def subwords(path: str) -> tiktoken.Encoding:
    """The public vocabulary as an encoder, once per Python worker."""
    return tiktoken.Encoding("public", pat_str=WORDS, mergeable_ranks=load_ranks(path), special_tokens={})


class Runs(dict):
    """run -> whether it may be (part of) a credential, by its characters per subword; worked out once per distinct run."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, run: str) -> bool:
        if len(self) > KNOWN_RUNS:
            self.clear()
        rate = len(run) / len(self.encode(run))
        odd = self[run] = rate < UNNATURAL["secret"] or (rate < UNNATURAL["password"] and MIXED.match(run) is not None)
        return odd


class Finder:
    """Credentials in one text, by characters per subword first and context second."""

    def __init__(self, path: str):
        self.encode = subwords(path).encode_ordinary
        self.runs = Runs(self.encode)

    def per_token(self, value: str) -> float:
        return len(value) / max(1, len(self.encode(value)))

    def odd(self, value: str, context: str = "secret") -> bool:
        """Few characters per subword, or a long run of hexadecimal digits, which happen to pair up in some vocabularies."""
        return self.per_token(value) < UNNATURAL[context] or HEX.match(value) is not None

    def secret(self, value: str, kind: str) -> bool:
        """Whether a value under a name of this kind is a live secret."""
        if PLACEHOLDER.search(value) or UUID.match(value) or any(c.isspace() for c in value) or not self.odd(value, kind):
            return False
        if kind == "password":
            return len(value) >= 4 and (not FORM.match(value) or (value.isdigit() and len(value) >= 6))
        return len(value) >= 12 and not FORM.match(value) and len(set(value)) >= 6

    def odd_lines(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of the lines that hold an unnatural run and of the last line with content before each, in order."""
        runs, end = self.runs, 0
        for m in RUN.finditer(text):
            if m.start() >= end and runs[m[0]]:
                start = text.rfind("\n", 0, m.start()) + 1
                if start > end:
                    before = len(text[end:start].rstrip()) + end
                    if before > end:
                        yield text.rfind("\n", 0, before) + 1, text.index("\n", before) + 1
                end = text.find("\n", m.end())
                end = len(text) if end < 0 else end + 1
                yield start, end

    def spans(self, text: str, suffix: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the credentials, ordered; overlapping finds are one."""
        return [(s, e, k) for s, e, k, _ in self.finds(text, suffix)]

    def finds(self, text: str, suffix: str) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
        """As spans, each with the pieces of text that make it up, which are what a mask must cover."""
        found: list[tuple[int, int, str, list[tuple[int, int]]]] = []
        if "PRIVATE KEY" in text:
            self.blocks(text, found)
        code = suffix in CODE
        for start, end in self.odd_lines(text):
            line = text[start:end].lower()
            if any(map(line.__contains__, BEGINNINGS)):
                self.issued(text, start, end, found)
            if "://" in line:
                self.urls(text, start, end, found)
            if "basic" in line or "bearer" in line:
                self.schemes(text, start, end, found)
            if any(map(line.__contains__, TOOLS)):
                self.called(text, start, end, found)
            quoted = '"' in line or "'" in line or "`" in line
            if any(map(line.__contains__, TELLING)):
                if quoted or OPENS.match(text, end):
                    self.assigned(text, start, end, found)
                if not code or quoted or COMMENT.search(text, start, end):
                    self.bare(text, start, end, code, found)
            if quoted:
                self.unnamed(text, start, end, found)
        found.sort()
        merged: list[tuple[int, int, str, list[tuple[int, int]]]] = []
        for s, e, k, parts in found:
            if merged and s < merged[-1][1]:
                s0, e0, k0, parts0 = merged[-1]
                merged[-1] = (s0, max(e, e0), k0, parts0 if k0 == "private_key" else parts0 + parts)
            else:
                merged.append((s, e, k, parts))
        return merged

    def blocks(self, text: str, found: list) -> None:
        """Private keys of any length, from BEGIN to END or to the end of the text; a block in which another begins is none."""
        for m in BEGIN.finditer(text):
            other = text.find("-----BEGIN", m.end())
            end = END.search(text, m.end(), len(text) if other < 0 else other + 5)
            if end is None and other >= 0:
                continue
            whole = text[m.end() : end.start() if end else len(text)]
            body = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", whole)
            if len(body) >= 40 and not PLACEHOLDER.search(whole[:200]) and self.odd(body[:200]):
                stop = end.end() if end else len(text)
                found.append((m.start(), stop, "private_key", [(m.start(), stop)]))

    def issued(self, text: str, at: int, stop: int, found: list) -> None:
        """Tokens that begin as a service issues them, also when the literal is put together from pieces."""
        for m in STARTS.finditer(text, at, stop):
            end, parts, spans, dots = m.end(), [m[0]], [m.span()], m[0].rstrip(".").count(".")
            listed = LISTED.search(text, at, m.start())
            while n := (NEXT_LISTED if listed else NEXT).match(text, end):
                if m[0].startswith("eyJ"):  # a JWT has two dots; what follows in the list is none of its pieces
                    if listed and dots == 2 and (n["more"].startswith("eyJ") or "." in n["more"].rstrip(".")):
                        break
                    dots += n["more"].count(".")
                parts.append(n["more"])
                spans.append(n.span("more"))
                end = n.end()
            value = "".join(parts).rstrip(".")
            if value.startswith(("AKIA", "ASIA")):
                good = len(value) >= 16 and value.isupper() and any(c.isdigit() for c in value)
            elif value.startswith("eyJ"):
                good = value.count(".") == 2 and len(value) >= 40
            else:
                rest = re.sub(rf"^{ISSUED}", "", value)
                good = len(rest) >= 12 and len(set(rest)) >= 6 and self.odd(rest)
            if good and not PLACEHOLDER.search(value):
                found.append((m.start(), end, "token", spans))

    def urls(self, text: str, at: int, stop: int, found: list) -> None:
        for m in LOGIN.finditer(text, at, stop):
            if not PLACEHOLDER.search(m["value"]) and not PLACEHOLDER.search(m["user"]) and "{" not in m["value"] and self.odd(m["value"], "password"):
                found.append((*m.span("value"), "url_login", [m.span("value")]))
        for pattern, kind in ((QUERY, "url_token"), (HOOK, "url_path")):
            for m in pattern.finditer(text, at, stop):
                if not PLACEHOLDER.search(m["value"]) and not FORM.match(m["value"]) and self.odd(m["value"]):
                    found.append((*m.span("value"), kind, [m.span("value")]))

    def schemes(self, text: str, at: int, stop: int, found: list) -> None:
        for m in SCHEME.finditer(text, at, stop):
            value = m["value"]
            if PLACEHOLDER.search(value) or not self.odd(value):
                continue
            if m["how"].lower() == "basic":
                try:
                    plain = base64.b64decode(value, validate=True)
                    good = b":" in plain and all(32 <= b < 127 for b in plain)
                except (binascii.Error, ValueError):
                    good = False
            else:
                good = len(value) >= 12 and not FORM.match(value)
            if good:
                found.append((*m.span("value"), "authorization", [m.span("value")]))

    def called(self, text: str, at: int, stop: int, found: list) -> None:
        """Passwords and header values in the arguments of command-line tools."""
        for m in CALLED.finditer(text, at, stop):
            group = next(g for g in ("value", "redis", "user", "header") if m[g])
            if self.secret(m[group], "password"):
                found.append((*m.span(group), "password", [m.span(group)]))

    def literals(self, pattern: re.Pattern, text: str, at: int, stop: int) -> Iterator[tuple[re.Match, int]]:
        """Matches that begin before stop, and where the literal ends whose first piece they hold."""
        opens = OPENS.match(text, stop)
        limit = opens.end() if opens else stop
        while at < stop and (m := pattern.search(text, at, limit)) and m.start() < stop:
            at = MORE.match(text, m.end()).end()
            yield m, at

    def assigned(self, text: str, at: int, stop: int, found: list) -> None:
        """Quoted values, also in pieces, under a name or after a keyword."""
        for pattern in (ASSIGNED, PAIRED, DEFINED):
            for m, end in self.literals(pattern, text, at, stop):
                kind = kind_of(m["name"]) if m["name"] else "password" if re.match(r"(?i)identified|password", m[0]) else "secret"
                if kind is None:
                    continue
                pieces = [p for p in PIECE.finditer(text, m.start("value"), end) if len(p[0]) > 2]
                value = "".join(p[0][1:-1] for p in pieces)
                if self.secret(value, kind):
                    found.append((pieces[0].start() + 1, pieces[-1].end() - 1, kind, [(p.start() + 1, p.end() - 1) for p in pieces]))

    def bare(self, text: str, at: int, stop: int, code: bool, found: list) -> None:
        """Values without quotes: configuration, shell, prose, comments and text inside a literal."""
        for pattern in (BARE, FLAG, SAID):
            for m in pattern.finditer(text, at, stop):
                kind = kind_of(m["name"])
                if kind is None:
                    continue
                value = m["value"].rstrip(".:")
                if not self.secret(value, kind) or (kind == "password" and value.isalpha()):
                    continue
                if code:
                    line = text[at : m.start()]
                    if not COMMENT.search(line) and line.count('"') % 2 == 0 and line.count("'") % 2 == 0 and line.count("`") % 2 == 0:
                        continue
                if re.match(r"[A-Za-z_][\w.]*\(", text[m.start("value") : m.end("value") + 1]):
                    continue
                at_value = (m.start("value"), m.start("value") + len(value))
                found.append((*at_value, kind, [at_value]))

    def unnamed(self, text: str, at: int, stop: int, found: list) -> None:
        """Literals that are random by their subwords alone, unless the line explains them or they are lines of a block of data."""
        near = [m for m in RANDOM.finditer(text, at, stop) if self.odd(m["value"], "unnamed") and not UUID.match(m["value"]) and not PLACEHOLDER.search(m["value"])]
        if not near or len(near) > 2 or EXPLAINED.search(text, at, stop):
            return
        for side in (text[text.rfind("\n", 0, max(0, at - 1)) + 1 : at], text[stop : (text.find("\n", stop) + 1 or len(text))]):
            if any(len(r) >= 20 and self.odd(r, "unnamed") for r in RUN.findall(side)):
                return
        for m in near:
            found.append((*m.span("value"), "unnamed", [m.span("value")]))

    def masked(self, text: str, finds: list[tuple[int, int, str, list[tuple[int, int]]]]) -> str:
        """The text with the pieces of the finds masked, quotes inside them too; length, lines, escapes and what joins the pieces stay."""
        out, at = [], 0
        for _, _, kind, parts in finds:
            for s, e in sorted(parts):
                if e <= at:
                    continue
                s = max(s, at)
                out.append(text[at:s])
                part = text[s:e]
                if kind == "private_key":
                    part = re.sub(r"(-----[A-Z0-9 ]+-----)|(\\.)|([\"'`]\s*[+.,]?\s*[\"'`])|[A-Za-z0-9+/=]", lambda m: m[0] if m[1] or m[2] or m[3] else MASK, part)
                else:
                    part = re.sub(r"(\\[\s\S])|\S", lambda m: m[0] if m[1] else MASK, part)
                out.append(part)
                at = e
        return "".join(out) + text[at:]


def _suffix(path: str | None) -> str:
    name = (path or "").replace("\\", "/").rpartition("/")[2]
    return "." + name.rpartition(".")[2].lower() if "." in name[1:] else ""


def find_credentials(chunks: DataFrame, vocab: str | None = None) -> DataFrame:
    """chunk_id, line_no, kind, start, length: one row per credential and chunk.

    `chunks` needs chunk_id, file_path, start_line, text. Each task scans its own rows, only
    finds are shuffled to count repeated chunk rows once. Whole texts are scanned; null and
    empty texts have no finds, a null start_line counts as 1.
    """
    vocab = vocab or vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(vocab)
        for pdf in batches:
            rows = []
            for cid, path, line, text in zip(pdf["chunk_id"], pdf["file_path"], pdf["start_line"].fillna(1), pdf["text"]):
                if text:
                    for s, e, kind in finder.spans(text, _suffix(path)):
                        rows.append((cid, int(line) + text.count("\n", 0, s), kind, s, e - s))
            yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "kind", "start", "length"])

    got = chunks.select("chunk_id", "file_path", "start_line", "text").mapInPandas(run, "chunk_id string, line_no bigint, kind string, start bigint, length bigint")
    return got.dropDuplicates(["chunk_id", "start"])


def redact(chunks: DataFrame, vocab: str | None = None) -> DataFrame:
    """The rows of chunks with their text masked; all other columns and rows are as they came."""
    vocab = vocab or vocabulary()

    @F.pandas_udf("string")
    def mask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        finder = Finder(vocab)
        for paths, texts in batches:
            yield pd.Series([finder.masked(t, finder.finds(t, _suffix(p))) if t else t for p, t in zip(paths, texts)], index=texts.index, dtype=object)

    return chunks.withColumn("text", mask("file_path", "text"))
