"""Dense, lexical and hybrid top-k search of a query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwork.functions.text import cut_plain, plain, words
from tarnwork.session import written

BLOCK, QUERY_BATCH = 50_000, 256
#: Postings of a group of rows. Terms held by more than a share of a block's rows are kept as full lines, up to so many bytes. Bytes of the scores that are made at once.
POSTINGS, LINE_SHARE, LINES_BYTES, SCORES_BYTES = 3_000_000, 0.03, 96 << 20, 64 << 20
#: Rows and queries whose scores are made at once, so that they stay near the processor. Columns of pieces whose rows are scored anew at once.
TILE, TOGETHER, OPEN = 6250, 384, 4096
#: Sorts of rows in a block at most, rows a sort at least, and rows drawn from it to tell them apart. Postings beside the lines that are added at once.
SORTS, SORTED, DRAWN, RARE = 16, 4096, 4096, 1 << 19
#: Pieces of a block's scores whose maxima give a floor. Two scores may be rounded to the same 6 places and differ by less than this. Share by which a rounding to single precision is off, doubled.
PIECES, ROUNDING, SINGLE = 32, 2e-6, 2**-23
K1, B = 1.2, 0.75
RRF_K = 60


def top(rows: DataFrame, by: list[str], score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group with their rank from 1; equal scores by the tie column."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def dense(queries: DataFrame, rows: DataFrame, k: int, filters: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """query_id, id, score, rank: the k nearest rows by cosine similarity.

    `queries` has query_id, vector and the filter columns, `rows` has id, vector and the same.
    Rows are dealt to groups of about `block`, each group gets all queries, so rows are shuffled
    once and the query set once a group; a task holds one group and streams the queries past
    it, and only the k best of each query and group go on. No vector comes to the driver.
    Scores are rounded to 6 places, ties go to the smaller id. Null vectors match nothing;
    with `filters` a row counts only for queries whose filter values equal its own (null equals null).
    """
    filters = filters or []
    data = rows.where(F.col("vector").isNotNull())
    groups = max(rows.sparkSession.sparkContext.defaultParallelism, -(-data.count() // block))
    kinds, asked_kinds = dict(rows.dtypes), dict(queries.dtypes)
    none = lambda t: F.lit(None).cast(t)
    held = data.select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("_g"), F.lit(0).alias("_side"), "id", none(asked_kinds["query_id"]).alias("query_id"), "vector", *filters)
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("_g")
    asked = queries.where(F.col("vector").isNotNull()).select(each, F.lit(1).alias("_side"), none(kinds["id"]).alias("id"), "query_id", F.col("vector").cast(kinds["vector"]).alias("vector"), *filters)
    both = held.unionByName(asked).repartition("_g").sortWithinPartitions("_g", "_side")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, parts, matrix, mine = None, [], None, None
        for pdf in batches:
            for g, part in pdf.groupby("_g", sort=False):
                if g != group:
                    group, parts, matrix = g, [], None
                here = part[part["_side"] == 0]
                if len(here):
                    parts.append(here.drop(columns=["_g", "_side", "query_id"]))
                q = part[part["_side"] == 1]
                if q.empty or not parts:
                    continue
                if matrix is None:
                    mine = pd.concat(parts).sort_values("id", kind="stable")
                    matrix = _unit(mine["vector"])
                for at in range(0, len(q), QUERY_BATCH):
                    some = q.iloc[at : at + QUERY_BATCH]
                    score = np.round(_unit(some["vector"]) @ matrix.T, 6) + 0.0
                    for f in filters:
                        a, b = some[f].to_numpy(dtype=object)[:, None], mine[f].to_numpy(dtype=object)[None, :]
                        score[~((a == b) | (pd.isna(a) & pd.isna(b)))] = -np.inf
                    near = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    value = np.take_along_axis(score, near, 1)
                    keep = np.nonzero(np.isfinite(value))
                    yield pd.DataFrame({"query_id": some["query_id"].to_numpy()[keep[0]], "id": mine["id"].to_numpy()[near[keep]], "score": value[keep]})

    found = both.mapInPandas(best, f"query_id {asked_kinds['query_id']}, id {kinds['id']}, score double")
    return top(found, ["query_id"], "score", "id", k)


def ivf_index(rows: DataFrame, lists: int, sample: int = 10_000, rounds: int = 8, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """Every row with the number of its nearest of `lists` centres.

    The centres are fitted on at most `sample` rows, the first in an order drawn by hash; the
    index holds every row.
    """
    drawn = rows.where(F.col("vector").isNotNull()).orderBy(F.xxhash64(F.lit(seed), F.col("id"))).limit(sample).select("vector").toPandas()
    m = _unit(drawn["vector"]) if len(drawn) else np.zeros((1, 1))
    centres = m[: max(1, min(lists, len(m)))].copy()
    for _ in range(rounds):
        near = np.argmax(m @ centres.T, axis=1)
        for c in range(len(centres)):
            if (mine := m[near == c]).size:
                v = mine.mean(axis=0)
                centres[c] = v / (np.linalg.norm(v) or 1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(list_no=np.argmax(_unit(pdf["vector"]) @ centres.T, axis=1) if len(pdf) else [])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", list_no int"
    return rows.where(F.col("vector").isNotNull()).mapInPandas(assign, schema), centres


def ivf_search(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """As dense, over the `probes` nearest lists of each query: joined by list, scored in the JVM."""
    from tarnwork.functions.vectors import cosine

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = np.argsort(-(_unit(pdf["vector"]) @ centres.T), axis=1)[:, :probes] if len(pdf) else np.empty((0, probes), dtype=int)
            at = np.repeat(np.arange(len(pdf)), near.shape[1])
            yield pdf.iloc[at].assign(list_no=near.ravel())

    schema = f"query_id {dict(queries.dtypes)['query_id']}, vector {dict(queries.dtypes)['vector']}, list_no int"
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector").mapInPandas(probe, schema)
    met = asked.withColumnRenamed("vector", "_q").join(index, "list_no")
    scored = met.select("query_id", "id", F.round(cosine(F.col("_q"), F.col("vector")), 6).alias("score")).where("score IS NOT NULL")
    return top(scored, ["query_id"], "score", "id", k)


def _text(terms: str, kinds: dict[str, str]) -> Column:
    """The terms of a row as one text, parted by spaces, which no word has."""
    return F.col(terms) if kinds[terms] == "string" else F.array_join(terms, " ")


def _schema(kinds: dict[str, str], columns: list[str]) -> str:
    return ", ".join(f"`{c}` {kinds[c]}" for c in columns)


def _counted(texts: DataFrame, held: list[str], joined: bool) -> DataFrame:
    """The rows of postings, of held, _t (texts) or _w (words, of texts that are cut already) or both; if joined their terms as one text, parted by spaces, and their tfs as one value, 4 bytes each, which need no steps per term outside of Python.

    A text in _t that cut_plain leaves uncut comes out as it is: doc_len is -1, terms the text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = pc.fill_null(b.column("_t"), "") if "_t" in b.schema.names else pa.array([""] * b.num_rows, pa.string())
            listed = b.column("_w") if "_w" in b.schema.names else pa.nulls(b.num_rows, pa.list_(pa.string()))
            hard = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            odd, lengths, found = cut_plain(pc.if_else(pc.is_null(listed), whole, ""))
            of = np.concatenate([np.repeat(np.arange(b.num_rows), x) for x in (lengths, hard)])
            coded = pa.concat_arrays([found, pc.cast(listed.flatten(), pa.string())]).dictionary_encode()
            size = max(1, len(coded.dictionary))
            pairs, tf = np.unique(of * size + coded.indices.to_numpy(), return_counts=True)
            length = np.where(odd, -1, lengths + hard)
            ends = pa.array(np.searchsorted(pairs // size, np.arange(b.num_rows + 1)), pa.int32())
            terms = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(pairs % size)))
            if joined:
                terms, tfs = pc.binary_join(terms, " "), _packed(ends.to_numpy(), tf.astype("<i4"))
                terms = pc.if_else(pa.array(odd), whole, terms) if odd.any() else terms
            else:
                tfs = pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))
            yield pa.RecordBatch.from_arrays([*map(b.column, held), pa.array(length, pa.int32()), terms, tfs], [*held, "doc_len", "terms", "tfs"]).filter(pa.array(length != 0))

    return texts.mapInArrow(count, _schema(dict(texts.dtypes), held) + f", doc_len int, terms {'string' if joined else 'array<string>'}, tfs {'binary' if joined else 'array<int>'}")


def postings(rows: DataFrame, key: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """The key, the columns to keep, doc_len (words), terms (distinct words) and tfs (how often each); a row a text, none for texts without words.

    Words are counted in the task that reads the text, so nothing is shuffled. The key has to be unique.
    """
    held = [key, *(keep or [])]
    return _counted(rows.select(*held, F.col(text).alias("_t"), F.when(~plain(F.col(text)), words(F.col(text))).alias("_w")), held, False)


def corpus_stats(post: DataFrame) -> DataFrame:
    """df per term, beside the number of rows with words and their mean length."""
    docs = post.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))
    return post.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(docs), F.lit(True))


def _flat(post: DataFrame) -> DataFrame:
    """Postings with flat: what a term frequency is held against, by the length of the text."""
    docs = post.agg(F.avg("doc_len").alias("avg_len"))
    return post.join(F.broadcast(docs), F.lit(True)).withColumn("flat", K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))


def bm25_weights(post: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """The key, the columns to keep, terms and weights: the saturated term frequencies, which idf multiplies."""
    return _flat(post).select(key, *(keep or []), "terms", F.transform("tfs", lambda tf: tf * (K1 + 1) / (tf + F.col("flat"))).alias("weights"))


def idfs(post: DataFrame) -> DataFrame:
    """term, df and idf, from postings or weights."""
    docs = post.agg(F.count("*").alias("n_docs"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            often = pc.value_counts(pc.split_pattern(b.column("terms"), " ").flatten())
            yield pa.RecordBatch.from_arrays([often.field("values"), often.field("counts")], ["term", "n"])

    if dict(post.dtypes)["terms"] == "string":
        each = post.select("terms").mapInArrow(count, "term string, n bigint")
    else:
        each = post.select(F.explode("terms").alias("term"), F.lit(1).alias("n"))
    df = each.groupBy("term").agg(F.sum("n").alias("df"))
    return df.join(F.broadcast(docs), F.lit(True)).select("term", "df", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def lexical_index(rows: DataFrame, key: str, text: str, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings that are written once, with the terms of a row as one text, parted by spaces, and flat, from which sparse works out the weights; and idfs, written too.

    The few texts that cut_plain leaves uncut are cut by words afterwards, so that no text is searched for their characters in the JVM.
    """
    held = [key, *(keep or [])]
    post = written(_counted(rows.select(*held, F.col(text).alias("_t")), held, True))
    odd = post.where("doc_len < 0")
    if not odd.isEmpty():
        late = written(_counted(odd.select(*held, words(F.col("terms")).alias("_w")), held, True))
        post = post.where("doc_len > 0").unionByName(late)
    return _flat(post).select(*held, "terms", "tfs", "flat"), written(idfs(post))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of each range in turn."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _packed(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    """A binary value for each range of values; an array makes mapInArrow go value by value in the JVM, also where it is null."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype("<i4")), pa.py_buffer(values)])


def _unpacked(packed: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), packed), b"")[0].as_py(), kind)


class _Block:
    """Some rows of a group with their postings, held in memory to score queries against them.

    Terms that many rows hold are kept as full lines of weights: many queries are multiplied with
    all lines at once. Rows that hold the same terms (those of a language, say) stand together in
    tiles, and a tile has lines of the terms that many of its rows hold; what is beside the lines
    is added posting by posting. These scores have single precision, so they only choose the rows
    that may be among the best; those are scored anew in double precision.
    """

    def __init__(self, ends: np.ndarray, codes: np.ndarray, weights: np.ndarray, line_of: np.ndarray):
        """Of row i the codes and weights at ends[i] up to ends[i + 1]. line_of has room for each code."""
        self.n, self.ends, self.codes, self.weights = len(ends) - 1, ends, codes, weights
        mine, lengths, starts = slice(ends[0], ends[-1]), np.diff(ends), ends[:-1] - ends[0]
        self.terms, often = np.unique(codes[mine], return_counts=True)
        sorts = max(1, min(SORTS, self.n // SORTED))
        lined = np.flatnonzero(often > LINE_SHARE * self.n / (1 if sorts == 1 else 4))
        lined = lined[np.argsort(-often[lined], kind="stable")][: LINES_BYTES // (4 * self.n)]
        self.line = np.full(len(self.terms), -1, np.int32)
        self.line[lined] = np.arange(len(lined))
        line_of[self.terms] = self.line
        line, weights = line_of[codes[mine]], weights[mine].astype(np.float32)

        def lines(rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """The lines that more than so many of some rows hold, and their weights in these rows; the other postings and whose they are."""
            where, row = _ranges(starts[rows], lengths[rows]), np.repeat(np.arange(len(rows), dtype=np.int32), lengths[rows])
            at = line[where]
            held = np.bincount(at + 1, minlength=len(lined) + 1)[1:] > least
            new = np.append(np.where(held, np.cumsum(held) - 1, -1), -1)[at]
            common = new >= 0
            made = np.zeros((np.count_nonzero(held), len(rows)), np.float32)
            made[new[common], row[common]] = weights[where[common]]
            return np.flatnonzero(held), made, where[~common], row[~common]

        own = np.zeros(self.n, np.int8)
        self.centres = np.zeros((len(lined), sorts), np.float32)
        if len(lined) and sorts > 1:
            held, drawn, *_ = lines(np.linspace(0, self.n - 1, min(self.n, DRAWN)).astype(int), 0)
            drawn /= np.maximum(np.linalg.norm(drawn, axis=0), 1e-9)
            centres = drawn[:, np.linspace(0, drawn.shape[1] - 1, sorts).astype(int)]
            for _ in range(4):
                near = np.argmax(centres.T @ drawn, axis=0)
                for c in np.unique(near):
                    v = drawn[:, near == c].mean(axis=1)
                    centres[:, c] = v / max(np.linalg.norm(v), 1e-9)
            self.centres[held] = centres
            for i in range(0, self.n, TILE):
                held, made, *_ = lines(np.arange(i, min(i + TILE, self.n)), 0)
                own[i : i + TILE] = np.argmax(self.centres[held].T @ made, axis=0)
        #: The rows in the order of the tiles, as their numbers, by which equal scores go.
        self.places = np.argsort(own, kind="stable")
        bounds = np.searchsorted(own[self.places], np.arange(sorts + 1))
        self.tiles, rare, rows = [], [], []
        for a, b in zip(bounds, bounds[1:]):
            for i in range(a, b, TILE):
                j = min(i + TILE, b)
                held, made, where, row = lines(self.places[i:j], LINE_SHARE * (j - i))
                self.tiles.append((i, j, held, made))
                rare.append(where)
                rows.append(row + np.int32(i))
        rare, rows = np.concatenate(rare), np.concatenate(rows)
        order = np.argsort(codes[mine][rare], kind="stable")
        self.rows, self.held = rows[order], weights[rare[order]]
        self.first = np.searchsorted(codes[mine][rare[order]], np.append(self.terms, np.iinfo(codes.dtype).max))

    def factors(self, asked: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The factor of each line for each query (codes, idf); the queries, terms and idf of all that may have postings beside the lines."""
        of = np.repeat(np.arange(len(asked)), [len(codes) for codes, _ in asked])
        codes, idf = (np.concatenate(x) for x in zip(*asked))
        at = np.minimum(np.searchsorted(self.terms, codes), len(self.terms) - 1)
        known = self.terms[at] == codes
        of, at, idf = of[known], at[known], idf[known].astype(np.float32)
        line, made = self.line[at], np.zeros((len(asked), len(self.centres)), np.float32)
        made[of[line >= 0], line[line >= 0]] = idf[line >= 0]
        rare = self.first[at + 1] > self.first[at]
        return made, of[rare], at[rare], idf[rare]

    def alike(self, asked: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The queries in the order of the tiles that are most like them."""
        if self.centres.shape[1] == 1:
            return np.arange(len(asked))
        return np.argsort(np.concatenate([np.argmax(self.factors(asked[i : i + TOGETHER])[0] @ self.centres, axis=1) for i in range(0, len(asked), TOGETHER)]), kind="stable")

    def near(self, asked: list[tuple[np.ndarray, np.ndarray]], room: np.ndarray) -> np.ndarray:
        """The scores of each row, in the order of the tiles, for each query, in single precision, held in room."""
        factors, of, at, idf = self.factors(asked)
        scores, used = room[: len(asked) * self.n].reshape(len(asked), self.n), factors.any(axis=0)
        for a, b, held, lines in self.tiles:
            mine = used[held]
            if np.count_nonzero(mine) < 0.6 * len(held):  # with more of them the copy costs more than it saves
                held, lines = held[mine], lines[mine]
            np.matmul(factors[:, held], lines, out=scores[:, a:b])
        often = self.first[at + 1] - self.first[at]
        parts = np.flatnonzero(np.diff(np.cumsum(often) // RARE)) + 1
        for i, j in zip([0, *parts], [*parts, len(at)]):
            where = _ranges(self.first[at[i:j]], often[i:j])
            np.add.at(scores.reshape(-1), np.repeat(of[i:j] * self.n, often[i:j]) + self.rows[where], self.held[where] * np.repeat(idf[i:j], often[i:j]))
        return scores

    def best(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int, idf_of: np.ndarray, room: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Query by query the numbers of the queries, the places and rounded scores of their k best rows above 0, and how many query words each has; equal rounded scores by place. idf_of has a 0 for each code."""
        scores = self.near(asked, room)
        width = self.n // PIECES if self.n // PIECES >= k else 0
        cut = width * PIECES
        floor, many = np.zeros(len(asked)), np.full(len(asked), -(-self.n // PIECES))
        if width:  # k pieces have a score that high, so the k-th score is no lower
            pieces = scores[:, :cut].reshape(len(asked), PIECES, width)
            most = pieces.max(axis=1)
            low = np.partition(most, width - k, axis=1)[:, width - k].astype(float)
            words = np.array([len(codes) for codes, _ in asked])
            floor = np.maximum(low * (1 - 3 * (words + 8) * SINGLE) - ROUNDING, 0)  # a sum of n numbers above 0 is off by a share of n roundings at most
            held = (most >= floor[:, None]) & (most > 0)
            many = held.sum(axis=1)
        parts = np.flatnonzero(np.diff(np.cumsum(many) // OPEN)) + 1
        for a, b in zip([0, *parts], [*parts, len(asked)]):
            q, at = np.nonzero(scores[a:b, cut:] >= floor[a:b, None])
            at = at + cut
            if width:
                of, column = np.nonzero(held[a:b])
                which, piece = np.nonzero(pieces[a:b][of, :, column] >= floor[a:b][of, None])
                q, at = np.concatenate([q, of[which]]), np.concatenate([at, piece * width + column[which]])
            above = scores[a + q, at] > 0
            q, at = q[above], self.places[at[above]]
            if not len(at):
                continue
            order = np.argsort(q, kind="stable")
            q, at = q[order], at[order]
            lengths = self.ends[at + 1] - self.ends[at]
            where, starts = _ranges(self.ends[at], lengths), np.cumsum(lengths) - lengths
            codes, factor = self.codes[where], np.empty(len(where))
            first = np.searchsorted(q, np.arange(b - a + 1))
            ends = np.append(starts, len(where))[first]
            for (mine, idf), i, j in zip(asked[a:b], ends, ends[1:]):
                if i < j:
                    idf_of[mine] = idf
                    factor[i:j] = idf_of[codes[i:j]]
                    idf_of[mine] = 0
            value = np.round(np.add.reduceat(self.weights[where] * factor, starts), 6)
            order = np.lexsort((at, -value, q))
            order = order[np.arange(len(q)) - first[q] < k]
            yield a + q[order], at[order], value[order], np.add.reduceat(factor > 0, starts, dtype=int)[order]


class _Group:
    """The rows of a group, in a block for each value of the filters, which is made when a query first has it."""

    def __init__(self, parts: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(parts)
        rows = rows.take(pc.sort_indices(rows.select(["_kind", "id"]), sort_keys=[("_kind", "ascending"), ("id", "ascending")])).combine_chunks()
        column = lambda c: pa.concat_arrays(rows[c].chunks)
        self.ids, terms = column("id"), pc.split_pattern(column("terms"), " ")
        coded = terms.flatten().dictionary_encode()
        self.words, self.codes = coded.dictionary, coded.indices.to_numpy()
        self.idf_of, self.line_of = np.zeros(len(self.words)), np.empty(len(self.words), np.int32)
        length = pc.list_value_length(terms).to_numpy().astype(np.int64)
        self.ends = np.append(0, np.cumsum(length))
        if "tfs" in rows.column_names:
            tf = _unpacked(column("tfs"), "<i4")
            self.weights = tf * (K1 + 1) / (tf + np.repeat(column("flat").to_numpy(), length))
        else:
            self.weights = column("weights").flatten().to_numpy()
        kinds = column("_kind").dictionary_encode()
        first = np.searchsorted(kinds.indices.to_numpy(), np.arange(len(kinds.dictionary) + 1))
        self.spans = {kind: (first[i], first[i + 1]) for i, kind in enumerate(kinds.dictionary.to_pylist())}
        self.blocks: dict[str, _Block] = {}

    def block(self, kind: str) -> _Block:
        if kind not in self.blocks:
            a, b = self.spans[kind]
            self.blocks[kind] = _Block(self.ends[a : b + 1], self.codes, self.weights, self.line_of)
        return self.blocks[kind]

    def answer(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        """query_id, id, score, shared: the k best rows of the group for each query."""
        terms = pc.split_pattern(asked.column("terms"), " ")
        codes = pc.fill_null(pc.index_in(terms.flatten(), value_set=self.words), -1).to_numpy(zero_copy_only=False)
        idf = asked.column("weights")
        idf = _unpacked(idf, "<f8") if pa.types.is_binary(idf.type) else idf.flatten().to_numpy()
        ends = np.append(0, np.cumsum(pc.list_value_length(terms).to_numpy()))
        of: dict[str, list[int]] = {}
        for q, kind in enumerate(asked.column("_kind").to_pylist()):
            if kind in self.spans:
                of.setdefault(kind, []).append(q)
        who, places, values, shared, room = [], [], [], [], np.empty(0, np.float32)
        for kind, all_queries in of.items():
            block = self.block(kind)
            words = []
            for q in all_queries:
                mine = codes[ends[q] : ends[q + 1]]
                words.append((mine[mine >= 0], idf[ends[q] : ends[q + 1]][mine >= 0]))
            order = block.alike(words)
            together = min(len(order), TOGETHER, max(1, SCORES_BYTES // (4 * block.n)))
            if len(room) < together * block.n:
                room = np.empty(together * block.n, np.float32)
            for i in range(0, len(order), together):
                some = order[i : i + together]
                for q, at, value, common in block.best([words[q] for q in some], k, self.idf_of, room):
                    who.append(np.array(all_queries)[some[q]])
                    places.append(at + self.spans[kind][0])
                    values.append(value)
                    shared.append(common)
        joined = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        return pa.RecordBatch.from_arrays([asked.column("query_id").take(pa.array(joined(who, int))), self.ids.take(pa.array(joined(places, int))), pa.array(joined(values, float)), pa.array(joined(shared, int), pa.int32())], ["query_id", "id", "score", "shared"])


def sparse(queries: DataFrame, weights: DataFrame, k: int, filters: list[str] | None = None, idf: DataFrame | None = None, block: int = POSTINGS, shared: bool = False) -> DataFrame:
    """query_id, id, score, rank of the k best rows by BM25; rows without a query word are absent.

    With `shared` also how many distinct words of the query the row has.

    `queries` has query_id, text and the filter columns; `weights` has id, terms, weights and the
    same, or is that of lexical_index; `idf` is idfs of it. With `filters` a row counts only for queries whose values equal
    its own (null equals null). Scores are rounded to 6 places, ties go to the smaller id.

    As in dense, rows are dealt to groups, here of `block` postings at most, the same number for each core, and each group gets
    all queries: rows are shuffled once, the query set once a group. A task holds one group and
    scores every row of it that a query may find, so the result is exact, and only the k best
    of each query and group go on. No pair of query word and posting becomes a row. The terms of
    a row are shuffled as one text, parted by spaces, which no word has.
    """
    filters = filters or []
    kinds, asked_kinds = dict(weights.dtypes), dict(queries.dtypes)

    def kind() -> Column:
        """One text for the filter values, equal where all of them are."""
        same = [F.col(f).cast(kinds[f]) for f in filters]
        same = [c + F.lit(0).cast(kinds[f]) if kinds[f] in ("float", "double") else c for c, f in zip(same, filters)]  # -0.0 equals 0.0
        return (F.to_json(F.array(*[c.cast("string") for c in same])) if filters else F.lit("")).alias("_kind")

    idf = idfs(weights) if idf is None else idf
    count = idf.agg(F.sum("df")).first()[0] or 0
    cores = weights.sparkSession.sparkContext.defaultParallelism
    groups = cores * max(1, -(-count // (block * cores)))  # no core waits for a last group
    none = lambda t: F.lit(None).cast(t)
    counted = ["tfs", "flat"] if "tfs" in kinds else []  # or weights
    held = weights.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("_g"), F.lit(0).alias("_side"), "id", none(asked_kinds["query_id"]).alias("query_id"), kind(), _text("terms", kinds).alias("terms"), *counted, none("binary").alias("weights") if counted else "weights")
    each = queries.select("query_id", kind(), F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    each = each.join(idf.select("term", "idf"), "term").groupBy("query_id", "_kind").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("_words"))
    each = each.select("query_id", "_kind", F.array_join("_words.term", " ").alias("terms"), F.col("_words.idf").alias("weights"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            idf = b.column("weights")
            ends = np.append(0, np.cumsum(pc.list_value_length(idf).to_numpy()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _packed(ends, idf.flatten().to_numpy())], b.schema.names)

    if counted:
        each = each.mapInArrow(pack, f"query_id {asked_kinds['query_id']}, _kind string, terms string, weights binary")
    asked = each.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"), F.lit(1).alias("_side"), none(kinds["id"]).alias("id"), "query_id", "_kind", "terms", *[none(kinds[c]).alias(c) for c in counted], "weights")
    both = held.unionByName(asked).repartitionById(groups, "_g").sortWithinPartitions("_side")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, group = [], None
        for b in batches:
            mine = pc.sum(pc.equal(b.column("_side"), 0)).as_py() or 0
            if mine:
                parts.append(b.slice(0, mine))
            if mine < b.num_rows and parts:
                group = group or _Group(parts)
                yield group.answer(b.slice(mine), k)

    found = both.mapInArrow(best, f"query_id {asked_kinds['query_id']}, id {kinds['id']}, score double, shared int")
    return top(found if shared else found.drop("shared"), ["query_id"], "score", "id", k)


def fuse(ranked: list[DataFrame], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: query_id, id, score, rank."""
    union = ranked[0].select("query_id", "id", "rank")
    for r in ranked[1:]:
        union = union.unionByName(r.select("query_id", "id", "rank"))
    fused = union.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 8).alias("score"))
    return top(fused, ["query_id"], "score", "id", k)


def hybrid(queries: DataFrame, rows: DataFrame, weights: DataFrame, k: int, prefetch: int = 50, filters: list[str] | None = None, idf: DataFrame | None = None) -> DataFrame:
    """Fusion of the dense and the lexical channel, each to depth max(prefetch, k), each with the filters."""
    depth = max(prefetch, k)
    return fuse([dense(queries, rows, depth, filters), sparse(queries, weights, depth, filters, idf)], k)


CHANNELS = ("hybrid", "dense", "sparse")


def search(queries: DataFrame, rows: DataFrame, weights: DataFrame | None, channel: str = "hybrid", top_k: int = 10, candidates: int = 50, filters: list[str] | None = None, reranked: bool = False, score: Column | None = None, idf: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank (and rerank_score): one entry for all channels.

    Filters hold inside each channel, before fusion and ranks. A reranked search asks the channel
    for max(candidates, top_k) rows and gives the top_k of the second score. Unknown channels,
    and numbers below 1, raise ValueError before anything runs.
    """
    if channel not in CHANNELS:
        raise ValueError(f"channel must be one of {', '.join(CHANNELS)}")
    if top_k < 1 or candidates < 1:
        raise ValueError("top_k and candidates must be at least 1")
    for f in filters or []:
        if f not in queries.columns or f not in rows.columns or (weights is not None and channel != "dense" and f not in weights.columns):
            raise ValueError(f"no column {f} to filter by")
    depth = max(candidates, top_k) if reranked else top_k
    if channel == "dense":
        hits = dense(queries, rows, depth, filters)
    elif channel == "sparse":
        hits = sparse(queries, weights, depth, filters, idf, shared=reranked and score is None)
    else:
        hits = hybrid(queries, rows, weights, depth, candidates, filters, idf)
    if not reranked:
        return hits
    return rerank(hits, queries, rows if score is not None or weights is None else weights, top_k, score)


def rerank(hits: DataFrame, queries: DataFrame, rows: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """hits in the order of a second score over query and row text, by default their word overlap.

    `queries` has query_id, text; `rows` has id, text. For word overlap `rows` may have the terms
    of postings instead, where texts without words have no row, and isn't read at all if the
    hits tell how many words they share with their query. Ties keep the order of the hits; a
    score that isn't a number comes last and is null. A score of one's own is an expression over
    `_q` and `_t`, the texts.
    """
    distinct = F.array_distinct(words(F.col("text")))
    if score is not None:
        met = hits.join(queries.select("query_id", F.col("text").alias("_q")), "query_id").join(rows.select("id", F.col("text").alias("_t")), "id").withColumn("_s", score)
        s = F.when(~F.isnan("_s") & (F.abs("_s") < F.lit(float("inf"))), F.col("_s"))
    else:
        asked = queries.select("query_id", distinct.alias("_w")).select("query_id", F.size("_w").alias("_n"), F.array_join("_w", " ").alias("_q"))
        if "shared" in hits.columns:
            met, shared = hits.join(asked.drop("_q"), "query_id"), F.col("shared")
        else:  # each text is cut into words once, not once a pair, and its words are shuffled as one text
            held = "terms" in rows.columns
            met = hits.join(asked, "query_id").join(rows.select("id", (_text("terms", dict(rows.dtypes)) if held else F.array_join(distinct, " ")).alias("_t")), "id", "left" if held else "inner")
            shared = F.size(F.array_intersect(F.split("_q", " "), F.split(F.coalesce("_t", F.lit("")), " ")))
        s = F.when(F.col("_n") > 0, shared / F.col("_n")).otherwise(0.0)
    met = met.withColumn("rerank_score", s)
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), F.col("rank"))
    return met.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).select("query_id", "id", "score", "rerank_score", F.col("new_rank").alias("rank"))
