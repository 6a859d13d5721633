"""Lexical retrieval over the stored index: web-search queries with cover-density ranks, BM25 that skips posting blocks, section lookup by key ranges.

A batch holds a bounded number of queries; the words and sections that they expand to are tables, which are broadcast where they are small and joined by a shuffle where they are not.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from brightloom.functions.stem import stem
from brightloom.functions.text import normal_citation, normal_section
from brightloom.operators.batches import CELLS, Allowed, Best, in_parts
from brightloom.operators.held import BROADCAST_ROWS, batch, bounded, hold, small, values
from brightloom.operators.index import STOP_WORDS, TILE, Index, document_frequencies, index, lexemes, read_index, row_of, section_keys, tokens, write_fields, write_index

__all__ = ["batch", "bm25", "bm25_allowed", "bounded", "exact_sections", "index", "lexemes", "read_index", "tokens", "top_k", "websearch", "write_fields", "write_index"]

#: BM25's term saturation and length weight.
K1, B = 1.2, 0.75
#: Distinct words, and ranges of section keys, of a batch up to which they filter the scan one by one.
FILTERED, RANGES = 2000, 200
#: Values of one list that a scan compares one by one (it reads a longer list as the range of its values), and values up to which there are such lists: many make a condition that the JVM no longer compiles.
LISTED, LISTS = 10, 100
#: Tiles of a group that a task scores at once, at most.
GROUP = 64


def parse_websearch(query: str) -> list[list[tuple[bool, list[str]]]]:
    """A web-search query as alternatives of terms that must all hold: (wanted, words), several words being a phrase.

    Words are joined by and, ``or`` between them starts an alternative, quotation marks make a phrase, a leading - negates.
    """
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)"([^"]*)"|(\S+)', query):
        if word.lower() == "or" and out[-1]:
            out.append([])
            continue
        wanted = not (minus or word.startswith("-"))
        words = re.findall(r"\w+", (phrase or word).lower())
        if words:
            out[-1].append((wanted, words))
    return [a for a in out if a]


def cover_density(line: list[tuple[int, str]], wanted: set[str], weight: float = 0.1) -> float:
    """Sum over the shortest covers of all ``wanted`` words of weight by the noise words inside; then r / (r + 1). ``line``: their places and words, in order."""
    last: dict[str, int] = {}
    start, total = 0, 0.0
    for place, word in line:
        last[word] = place
        first = min(last.values())
        if len(last) == len(wanted) and first > start:  # a cover that starts later than the one before is a new shortest one
            start = first
            total += weight / max(1, place - first + 2 - len(wanted))
    return total / (total + 1)


def _one_of(column: str, known: list[str]) -> Column:
    """Whether a column is one of sorted values, as lists so short that a scan skips what holds none of them; of many values some are on every page, so they are looked up in one set."""
    if len(known) > LISTS:
        return F.col(column).isin(known)
    lists = [F.col(column).isin(known[i : i + LISTED]) for i in range(0, len(known), LISTED)]
    while len(lists) > 1:  # in pairs, as a long chain nests deeply
        lists = [reduce(lambda a, b: a | b, lists[i : i + 2]) for i in range(0, len(lists), 2)]
    return lists[0] if lists else F.lit(False)


def _for_scan(stored: DataFrame, column: str = "lexeme") -> tuple[DataFrame, Column]:
    """A stored batch for a join, broadcast if it is small, and a condition that the scan of a table sorted by ``column`` can use: its values, if there are few, else their range."""
    known = values(stored, column)
    if known is not None and len(set(known)) <= FILTERED:
        return F.broadcast(stored), _one_of(column, sorted(set(known)))
    low, high = stored.agg(F.min(column), F.max(column)).first()
    return (stored if known is None else F.broadcast(stored)), F.col(column).between(low, high)


def websearch(made: Index, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id and rank (cover density, the best alternative's) of every chunk that matches a web-search query (query_id, query).

    Words of an alternative must all be there, phrases in a row, negated ones absent; alternatives of negated words only match nothing. Matching reads the
    batch's postings alone; what is gathered for a chunk are the places of one query's words.
    """
    english = made.english

    @F.pandas_udf("array<array<struct<wanted:boolean,words:array<string>>>>")
    def parse(texts: pd.Series) -> pd.Series:
        spelt = lambda words: [stem(w) for w in words if w not in STOP_WORDS] if english else words
        return texts.map(lambda t: [[{"wanted": w, "words": spelt(words)} for w, words in a if spelt(words)] for a in parse_websearch(t or "")])

    parts = queries.select("query_id", F.posexplode(parse("query")).alias("alternative", "terms")).where(F.exists("terms", lambda t: t["wanted"]))
    terms = hold(parts.withColumn("lexeme", F.explode(F.array_distinct(F.flatten(F.transform("terms", lambda t: t["words"]))))), "terms")
    terms, among = _for_scan(terms)
    places = made.places(among).join(terms, "lexeme")
    gathered = places.groupBy("query_id", "alternative", "segment", "row").agg(F.first("terms").alias("terms"), F.collect_list(F.struct("lexeme", "positions")).alias("at"))
    at = F.map_from_entries("at")
    holds = lambda words: F.aggregate(  # noqa: E731  places where all words so far stand in a row
        F.slice(words, F.lit(2), F.size(words)),
        F.coalesce(F.element_at(at, F.element_at(words, 1)), F.array().cast("array<int>")),
        lambda ends, w: F.filter(F.transform(ends, lambda p: p + 1), lambda p: F.array_contains(F.coalesce(F.element_at(at, w), F.array().cast("array<int>")), p)),
        lambda ends: F.size(ends) > 0,
    )
    matched = gathered.where(F.forall("terms", lambda t: holds(t["words"]) == t["wanted"]))
    wanted = F.array_distinct(F.flatten(F.transform(F.filter("terms", lambda t: t["wanted"]), lambda t: t["words"])))

    @F.pandas_udf("double")
    def rank(given: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for of, need in zip(given, words, strict=True):
            need = set(need)
            line = sorted((int(p), x["lexeme"]) for x in of if x["lexeme"] in need for p in x["positions"])
            out.append(cover_density(line, need))
        return pd.Series(out, dtype="float64")

    best = matched.select("query_id", "segment", "row", rank("at", wanted).alias("rank")).groupBy("query_id", "segment", "row").agg(F.max("rank").alias("rank"))
    return made.named(small(hold(best, "matched"))).select("query_id", "chunk_id", "rank")


class _Pruned:
    """The search for the k best chunks of each query by ``bounds`` (query_id, segment, tile, bound, blocks) of tiles and ``scores`` of the chunks of chosen tiles."""

    made: Index
    small: Callable[[DataFrame], DataFrame]

    def scores(self, tiles: DataFrame | None) -> DataFrame:
        """query_id, segment, row and score of the chunks of ``tiles`` (query_id, segment, tile), or of all, that hold a word of their query."""
        raise NotImplementedError

    def best(self, k: int, tiles: DataFrame) -> DataFrame:
        """Of the scores of ``tiles`` those that reach their query's k-th."""
        return self.scores(tiles).withColumn("place", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("place") <= k).drop("place")

    def needed(self, k: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The tiles that may hold one of a query's k best: those whose bound reaches the k-th score of the k tiles with the greatest bounds; with the number of their blocks."""
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "tile")
        first = small(hold(self.bounds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k), "first"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        scored = self.scores(first)
        floors = (scored if keep is None else keep(self.made.named(scored))).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).where(F.col("place") == k).select("query_id", F.col("score").alias("floor"))
        return self.bounds.join(self.small(floors), "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor")))

    def top(self, k: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """query_id, chunk_id, score and rank of the k best of each query, ties to the smaller chunk_id; ids are looked up for what the scores leave."""
        tiles = small(hold(self.needed(k, keep), "tiles"))
        found = self.made.named(small(hold(self.best(k, tiles), "best"))) if keep is None else keep(self.made.named(self.scores(tiles)))
        return top_k(found.select("query_id", "chunk_id", "score"), k, "score")


class _Bm25(_Pruned):
    """A batch's words with their weights, the bounds of the tiles that hold them, and scores of the chunks of chosen tiles."""

    def __init__(self, made: Index, queries: DataFrame):
        self.made, self.mean = made, made.words / made.n if made.words else 1.0
        idf = F.log(1 + (F.lit(float(made.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = queries.select("query_id", F.explode(F.array_distinct(lexemes(F.col("query"), made.english))).alias("lexeme")).where("lexeme <> ''")
        rows = asked.limit(BROADCAST_ROWS + 1).collect()
        self.small = F.broadcast if len(rows) <= BROADCAST_ROWS else lambda df: df  # a batch has no more floors and weights than words
        asked = queries.sparkSession.createDataFrame(rows, asked.schema) if len(rows) <= BROADCAST_ROWS else hold(asked, "terms")
        words = sorted({r["lexeme"] for r in rows})
        low, high = (words[0], words[-1]) if self.small is F.broadcast and words else asked.agg(F.min("lexeme"), F.max("lexeme")).first()
        self.among = _one_of("lexeme", words) if self.small is F.broadcast and len(words) <= FILTERED else F.col("lexeme").between(low, high)
        weights = document_frequencies(made, asked, self.among).join(self.small(asked), "lexeme").select("query_id", "lexeme", idf.alias("idf"))
        #: Of a batch of no more words than a broadcast may have: query_id, lexeme and idf.
        self.known = weights.collect() if self.small is F.broadcast else None
        self.terms = F.broadcast(queries.sparkSession.createDataFrame(self.known, weights.schema)) if self.small is F.broadcast else hold(weights, "weights")

    @cached_property
    def bounds(self) -> DataFrame:
        return hold(self.blocks().groupBy("query_id", "segment", "tile").agg((F.sum(self.weight("most", "least")) * (1 + 1e-9)).alias("bound"), F.count("*").alias("blocks")), "bounds")

    def blocks(self) -> DataFrame:
        return self.made.postings.where(self.among).select("segment", "lexeme", "tile", "most", "least").join(self.terms, "lexeme")

    def weight(self, tf: str, dl: str) -> Column:
        return F.col("idf") * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / self.mean))

    def scores(self, tiles: DataFrame | None) -> DataFrame:
        """As above. Weights are summed in the order of the words, so that equal chunks tie. Positions are not read."""
        entries = F.arrays_zip(F.col("entries.slot"), F.col("entries.tf"), F.col("entries.dl")).alias("entries")
        found = self.made.postings.where(self.among).select("segment", "lexeme", "tile", entries).join(self.terms, "lexeme")
        found = found if tiles is None else found.join(tiles.select("query_id", "segment", "tile"), ["query_id", "segment", "tile"], "left_semi")
        rows = self.made.live(found.select("query_id", "segment", "lexeme", "idf", "tile", F.inline("entries")).withColumn("row", row_of()))
        parts = rows.groupBy("query_id", "segment", "row").agg(F.array_sort(F.collect_list(F.struct("lexeme", self.weight("tf", "dl").alias("w")))).alias("parts"))
        return parts.select("query_id", "segment", "row", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["w"]).alias("score"))


class _Fields(_Pruned):
    """BM25 in several indexes that number chunks alike, weighted as ``multi_match`` does; no weight or ``tie`` is negative, so greatest scores of the fields bound the score of them all."""

    def __init__(self, made: dict[str, Index], queries: DataFrame, weights: dict[str, float], tie: float):
        self.plans, self.score = {f: _Bm25(x, queries) for f, x in made.items()}, multi_match(weights, tie)
        first = next(iter(self.plans.values()))
        self.made, self.small = first.made, first.small
        bounds = self._together({f: p.bounds.withColumnRenamed("bound", f) for f, p in self.plans.items()}, "tile", F.sum("blocks").alias("blocks"))
        self.bounds = hold(bounds.select("query_id", "segment", "tile", (self.score * (1 + 1e-9)).alias("bound"), "blocks"), "bounds")

    def _together(self, parts: dict[str, DataFrame], of: str, *more: Column) -> DataFrame:
        """Tables with a column for each field as one: a row for each query and tile or chunk."""
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts.values())
        return rows.groupBy("query_id", "segment", of).agg(*(F.max(f).alias(f) for f in parts), *more)

    def scores(self, tiles: DataFrame | None) -> DataFrame:
        """As above."""
        found = self._together({f: p.scores(tiles).withColumnRenamed("score", f) for f, p in self.plans.items()}, "row")
        return found.select("query_id", "segment", "row", self.score.alias("score"))


def bm25(made: Index, queries: DataFrame, k: int = 50, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, chunk_id, score and rank of each query's (query_id, query) k best chunks; ties to the smaller chunk_id.

    ``keep`` drops scored rows (query_id, chunk_id, score and what the index carries) that a query's filters don't allow; it acts before k counts. The tiles with the greatest bounds are scored
    first; their k-th score is the floor, and only tiles whose bound reaches it are scored in full. A bound adds up what the largest tf and the smallest dl of a tile would give for each
    word, so no tile that matters is skipped.
    """
    return _Bm25(made, queries).top(k, keep)


class _Grouped:
    """The scores of a whole batch, a group of tiles at a time: blocks of its words and the classes of the chunks are packed where they are read, and brought together by group. What a task holds of the batch is its words and filters."""

    def __init__(self, plan: _Bm25, given: list, kinds: np.ndarray, fits: np.ndarray, k: int):
        number = {r["query_id"]: i for i, r in enumerate(given)}
        self.words = sorted({r["lexeme"] for r in plan.known})
        at = {w: i for i, w in enumerate(self.words)}
        self.idf, asking = np.zeros(len(at)), [[] for _ in at]
        for r in plan.known:
            self.idf[at[r["lexeme"]]] = r["idf"]
            asking[at[r["lexeme"]]].append(number[r["query_id"]])
        self.asking = [np.array(sorted(x)) for x in asking]
        self.kinds, self.fits, self.k, self.mean = kinds, fits, k, plan.mean
        self.chunks = TILE * max(1, min(GROUP, CELLS // (TILE * max(1, len(given)))))

    def _packed(self, segment: np.ndarray, row: np.ndarray, *values: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each group of rows: the places of its rows and their values as one run of bytes."""
        group = row // self.chunks
        order = np.lexsort((group, segment))
        new = np.flatnonzero((np.diff(segment[order], prepend=-1) != 0) | (np.diff(group[order], prepend=-1) != 0))
        data = [np.stack([(row % self.chunks)[some], *(v[some] for v in values)]).astype(np.int32).tobytes() for some in np.split(order, new[1:])]
        first = order[new]
        yield pa.RecordBatch.from_arrays([pa.array(segment[first], pa.int32()), pa.array(group[first], pa.int64()), pa.array([len(values) == 1] * len(first)), pa.array(data, pa.binary())], names=["segment", "group", "classes", "data"])

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of blocks (segment, word, tile, slot, tf, dl)."""
        for b in batches:
            if b.num_rows:
                segment, word, tile = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                slot, tf, dl = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(3, 6))
                n = np.diff(b.column(3).offsets.to_numpy())
                yield from self._packed(np.repeat(segment, n), np.repeat(tile, n) * TILE + slot, np.repeat(word, n), tf, dl)

    def classes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of chunks (segment, row, _class)."""
        for b in batches:
            if b.num_rows:
                yield from self._packed(*(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)))

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """q, segment, row and score of the chunks that reach a query's k-th score in this task, of packed rows sorted by group."""
        best, at, held = Best(len(self.kinds), self.k), None, []
        for b in batches:
            for segment, group, classes, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != (segment, group):
                    self._add(best, at, held)
                    at, held = (segment, group), []
                held.append((classes, np.frombuffer(data, np.int32).reshape(2 if classes else 4, -1)))
        self._add(best, at, held)
        if found := best.cut():
            q, score, segment, row = found
            yield from in_parts(pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(segment, pa.int32()), pa.array(row, pa.int64()), pa.array(score)], names=["q", "segment", "row", "score"]))

    def _add(self, best: Best, at: tuple[int, int] | None, held: list[tuple[bool, np.ndarray]]) -> None:
        parts = [x for classes, x in held if not classes]
        if not parts:
            return
        kind = np.full(self.chunks, -1)
        for classes, x in held:
            if classes:
                kind[x[0]] = x[1]
        place, word, tf, dl = np.concatenate(parts, axis=1)
        order = np.argsort(word, kind="stable")
        place, word, tf, dl = place[order], word[order], tf[order], dl[order]
        weight = self.idf[word] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / self.mean))
        scores = np.zeros((len(self.kinds), self.chunks))
        new = np.flatnonzero(np.diff(word, prepend=-1))
        for a, b in zip(new, [*new[1:], len(word)], strict=True):  # in the order of the words, so that equal chunks tie
            scores[self.asking[word[a]][:, None], place[None, a:b]] += weight[a:b]
        some = (scores > 0) & (scores >= best.floor[:, None]) & self.fits[:, kind][self.kinds]
        q, place = np.nonzero(some)
        best.add(q, scores[q, place], np.full(len(q), at[0]), at[1] * self.chunks + place)


def bm25_allowed(made: Index, queries: DataFrame, k: int, filters: Allowed) -> DataFrame | None:
    """As ``bm25`` for a batch of queries of which each has a filter, over what the index carries: every block of the batch's words is read once, weights are added up for groups of tiles, and of a group only what reaches
    a query's k-th score so far leaves its task. None if the batch has more words than a task may hold."""
    spark, given = queries.sparkSession, queries.select("query_id").collect()  # as many as a batch may have
    plan = _Bm25(made, queries)
    if plan.known is None:
        return None
    grouped = _Grouped(plan, given, filters.of(given), filters.fits, k)
    words = spark.createDataFrame(list(zip(grouped.words, range(len(grouped.words)), strict=True)), "lexeme string, word int")
    packed = "segment int, group long, classes boolean, data binary"
    blocks = made.postings.where(plan.among).join(F.broadcast(words), "lexeme")  # at most as many as the terms, which are counted
    blocks = blocks.select("segment", "word", "tile", *(F.col(f"entries.{c}").alias(c) for c in ("slot", "tf", "dl"))).mapInArrow(grouped.blocks, packed)
    # What no longer holds has no class, and no filter allows it.
    classes = filters.numbered(made.live(made.chunks.select("segment", "row", *filters.columns))).select("segment", "row", "_class").mapInArrow(grouped.classes, packed)
    found = blocks.unionByName(classes).repartition("segment", "group").sortWithinPartitions("segment", "group").mapInArrow(grouped.best, "q int, segment int, row long, score double")
    best = found.withColumn("place", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("place") <= k).drop("place")
    numbers = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(given)], StructType([StructField("q", IntegerType()), queries.schema["query_id"]]))
    best = made.named(small(hold(best, "best"))).join(F.broadcast(numbers), "q")  # a batch of queries
    return top_k(best.select("query_id", "chunk_id", "score"), k, "score")


def bm25_blocks(made: Index, queries: DataFrame, k: int = 50) -> DataFrame:
    """query_id, blocks (posting blocks of its words) and read (of these, those that ``bm25`` scores)."""
    plan = _Bm25(made, queries)
    read = plan.needed(k).groupBy("query_id").agg(F.sum("blocks").alias("read"))
    return plan.bounds.groupBy("query_id").agg(F.sum("blocks").alias("blocks")).join(read, "query_id", "left").na.fill(0, ["read"])


def bm25_scores(made: Index, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id and score of every chunk that holds a word of a query (query_id, query)."""
    return made.named(_Bm25(made, queries).scores(None)).select("query_id", "chunk_id", "score")


def top_k(scores: DataFrame, k: int | None, score: str, group: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The k largest of each group (all, if None) with their rank, ties to the smaller id; each task keeps k before the shuffle."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie)))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _ranges(starts: list[str]) -> Column:
    """Whether a ref begins with one of ``starts``, as ranges from each to what follows all its continuations, which the scan of the sorted keys can use."""
    ranges = [(F.col("ref") >= s) & (F.col("ref") < s[:-1] + chr(ord(s[-1]) + 1)) for s in sorted(starts) if not any(s != t and s.startswith(t) for t in starts)]
    return reduce(lambda a, b: a | b, ranges, F.lit(False))


def exact_sections(keys: DataFrame, queries: DataFrame, limit: int = 10, pair: Column | None = None) -> DataFrame:
    """Chunks whose section or subsection is or starts with one of a query's sections (query_id, section), in document order, ``limit`` a section, score 1.

    Sections are brought to their number first ('318(2)' to '318'), and case does not count. ``keys`` is an index's table of section keys (ref, chunk_id, chunk_index and what was carried), or chunks, of which
    keys are made. The batch's sections are ranges of the sorted keys, which the scan reads alone; what is in them is looked up by each of its beginnings. ``pair`` is a condition over the columns of both
    that holds before the limit.
    """
    keys = keys if "ref" in keys.columns else section_keys(keys)
    asked = hold(queries.withColumn("_start", F.lower(normal_section(F.col("section")))).where("_start <> ''"), "sections")
    starts = values(asked, "_start")
    inside = keys if starts is None or len(set(starts)) > RANGES else keys.where(_ranges(sorted(set(starts))))
    asked = asked if starts is None else F.broadcast(asked)
    begins = F.transform(F.sequence(F.lit(1), F.length("ref")), lambda n: F.substring(F.col("ref"), F.lit(1), n))
    pairs = inside.withColumn("_start", F.explode(begins)).join(asked, "_start")
    pairs = pairs if pair is None else pairs.where(pair)
    # A chunk may be hit by its section and its subsection; it counts once.
    once = pairs.groupBy("query_id", "section", "chunk_id").agg(F.min("chunk_index").alias("chunk_index"))
    order = Window.partitionBy("query_id", "section").orderBy("chunk_index", "chunk_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "section", "rank", "chunk_id", F.lit(1.0).alias("score"))


def find_by_section(chunks: DataFrame, documents: DataFrame, queries: DataFrame, limit: int = 3, keys: DataFrame | None = None) -> DataFrame:
    """The first ``limit`` chunks for each query (query_id, section and laws, null for all) whose section is the one given or whose subsection starts with it, with their documents' columns.

    ``keys`` is the index's table of section keys; without it they are made of ``chunks``.
    """
    lawful = (F.coalesce(F.size("laws"), F.lit(0)) <= 0) | F.array_contains("laws", F.col("law"))
    hit = (F.col("section_ref") == F.col("section")) | F.startswith(F.lower("subsection_ref"), F.lower("section"))
    known = documents.select("document_id", "source_url", "law", "year", "court", "citation")
    keys = (section_keys(chunks) if keys is None else keys).drop("law", "court", "year").join(known.select("document_id", "law"), "document_id")
    rows = exact_sections(keys, queries, limit, pair=F.coalesce(hit, F.lit(False)) & F.coalesce(lawful, F.lit(False)))
    return rows.drop("score").join(chunks.drop("law"), "chunk_id").join(known, "document_id")


def find_by_citation(documents: DataFrame, chunks: DataFrame, queries: DataFrame, limit: int = 2) -> DataFrame:
    """The first ``limit`` documents for each query (query_id, citation) with that citation, spelt the same after normalisation, and their final orders (null without one)."""
    orders = chunks.where("chunk_type = 'final_order'").select("document_id", "chunk_id", "content", "page_number")
    asked = bounded(queries.select("query_id", normal_citation(F.col("citation")).alias("_cite")))
    found = documents.withColumn("_cite", normal_citation(F.col("citation"))).join(asked, "_cite").join(orders, "document_id", "left")
    order = Window.partitionBy("query_id").orderBy("document_id", "chunk_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("_cite")


def section_snippet(chunks: DataFrame, length: int = 150) -> DataFrame:
    """document_id, section_ref and snippet: the beginning of the first chunk of each section of a document."""
    first = chunks.where("section_ref is not null").groupBy("document_id", "section_ref").agg(F.min_by("content", F.struct("chunk_index", "chunk_id")).alias("content"))
    return first.select("document_id", "section_ref", F.left("content", F.lit(length)).alias("snippet"))


def multi_match(fields: dict[str, float], tie: float = 0.3) -> Column:
    """Best field's weighted score plus ``tie`` times the others'."""
    parts = [F.coalesce(F.col(f), F.lit(0.0)) * w for f, w in fields.items()]
    best, total = (F.greatest(*parts) if len(parts) > 1 else parts[0]), sum(parts[1:], parts[0])
    return best + tie * (total - best)


def multi_field(made: dict[str, Index], queries: DataFrame, weights: dict[str, float], k: int = 50, tie: float = 0.3) -> DataFrame:
    """query_id, chunk_id, score and rank by BM25 in several fields' indexes, weighted: the best field and ``tie`` times the others.

    Indexes that number chunks alike (``index.write_fields``) are searched tile by tile, and only tiles that may hold one of the k best are scored; others are joined by the ids of all chunks with a word of a query.
    """
    if len({x.numbering for x in made.values()}) == 1 and tie >= 0 and min(weights.values()) >= 0 and set(weights) == set(made):
        return _Fields(made, queries, weights, tie).top(k)
    fields = [bm25_scores(x, queries).select("query_id", "chunk_id", F.col("score").alias(f)) for f, x in made.items()]
    scores = reduce(lambda a, b: a.join(b, ["query_id", "chunk_id"], "outer"), fields)
    return top_k(scores.select("query_id", "chunk_id", multi_match(weights, tie).alias("score")), k, "score")
