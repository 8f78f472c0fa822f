"""Source divergence audit: how far the word frequencies of the sources of a language lie apart.

Single-pass in-memory indexing, then corrections of a base value per pair of sources:

* Every task reads its documents once and keeps the postings (language, term, source: occurrences, documents) of its
  block in memory. When ``BLOCK`` of them are there, they leave as a run sorted by term.
* Runs are dealt out by a hash of language and term. Spark's sort merges a shard's runs (it spills sorted runs and
  merges them by a heap), and a task sums what follows one another: one posting per term and source, for terms in
  enough documents.
* A pair's value is a sum over all terms, but nearly all terms are absent from one or both sources. So a pair starts
  from the value of absence everywhere; what a source alone changes follows from its histogram of counts; and only the
  terms that both have are streamed, to correct the pair. A task holds sums by pair, not postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import rows_of, settled, slices, split_words

#: Postings that a task's block holds before it is written as a run; sums by pair that a task holds; pairs worked on
#: at once.
BLOCK, SUMS, AT_ONCE = 1_000_000, 1_000_000, 2_000_000

#: Frequencies count in billionths.
UNIT = 1_000_000_000

#: Bytes that are part of a term (letters and all of non-ASCII), A-Z lower-cased; others separate terms.
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

RUN = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()),
                 ("docs", pa.int64())])


def lettered(texts: pa.Array) -> pa.Array:
    """``texts``, null as empty, with A-Z in lower case and blanks for all that separates terms."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = data.slice(ends[0], ends[-1] - ends[0]).to_pybytes() if data is not None else b""
    return pa.Array.from_buffers(pa.string(), len(texts),
                                 [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(data.translate(LETTERS))])


def postings(part: pa.RecordBatch) -> pa.Table:
    """Postings of a slice of documents; a term '' counts the documents of each language and source."""
    lang, source = (pc.fill_null(part.column(c), "").dictionary_encode() for c in ("lang", "source"))
    width = len(source.dictionary)
    group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
    codes, offsets, vocab = split_words(lettered(part.column("text")))
    v = len(vocab) + 1  # the last one stands for ''
    once, n = np.unique(rows_of(offsets) * v + codes, return_counts=True)
    once = np.concatenate((once, np.arange(part.num_rows) * v + v - 1))
    n = np.concatenate((n, np.zeros(part.num_rows, np.int64)))
    key = group[once // v] * v + once % v
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    heads = np.flatnonzero(np.diff(key, prepend=-1) != 0)
    terms = pa.concat_arrays([vocab.cast(pa.string()), pa.array([""])])
    own = key[heads] // v
    return pa.table([lang.dictionary.take(pa.array(own // width)), terms.take(pa.array(key[heads] % v)),
                     source.dictionary.take(pa.array(own % width)), pa.array(np.add.reduceat(n, heads)),
                     pa.array(np.diff(np.append(heads, len(key))))], schema=RUN)


def summed(parts: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(parts).group_by(["lang", "term", "source"]).aggregate([("n", "sum"), ("docs", "sum")])
    return out.rename_columns(["lang", "term", "source", "n", "docs"]).select(RUN.names).combine_chunks()


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the postings of a task's documents."""
    block, held = [], 0
    for batch in batches:
        for part in slices(batch):
            block.append(postings(part))
            held += block[-1].num_rows
            if held > BLOCK:
                block = [summed(block)]
                held = block[0].num_rows
                if held > BLOCK // 2:
                    yield from sorted_run(block)
                    block, held = [], 0
    if block:
        yield from sorted_run([summed(block)])


def sorted_run(block: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    order = [(c, "ascending") for c in ("lang", "term", "source")]
    return iter(block[0].sort_by(order).to_batches(max_chunksize=1 << 16))


def changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Places where a row differs from the one before in any of ``columns``, and the first place."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in columns:
        x = table.column(c).combine_chunks()
        new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def by_term(batches: Iterator[pa.RecordBatch], shorten=lambda t: t) -> Iterator[pa.Table]:
    """Rows sorted by language and term, as tables that hold terms whole. ``shorten`` may sum up rows of a term that
    goes on."""
    held: list[pa.Table] = []
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if not now.num_rows:
            continue
        now = pa.concat_tables([*held, now])
        heads = changes(now, ["lang", "term"])
        if heads[-1]:
            yield now.slice(0, heads[-1])
        held = [shorten(now.slice(heads[-1]))]
    if held:
        yield held[0]


def merged(least_docs: int):
    """Function that turns a shard's sorted postings into one per term and source, of terms in ``least_docs`` documents
    of the language; ``first`` marks one posting of each term."""
    def sum_up(t: pa.Table) -> pa.Table:
        heads = changes(t, ["lang", "term", "source"])
        return pa.table([*(t.column(c).take(pa.array(heads)) for c in ("lang", "term", "source")),
                         *(pa.array(np.add.reduceat(t.column(c).to_numpy(), heads)) for c in ("n", "docs"))],
                        schema=t.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_term(batches, sum_up):
            t = sum_up(t)
            heads = changes(t, ["lang", "term"])
            size = np.diff(np.append(heads, t.num_rows))
            empty = pc.equal(t.column("term"), "").to_numpy()
            kept = np.repeat(np.add.reduceat(t.column("docs").to_numpy(), heads) >= least_docs, size) | empty
            first = np.zeros(t.num_rows, np.int64)
            first[heads] = 1
            first[empty] = 0
            t = t.drop_columns(["docs"]).append_column("first", pa.array(first))
            yield from t.filter(pa.array(kept)).combine_chunks().to_batches()
    return run


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT (count + 2) / whole)`` without overflow for wholes up to 9e14, by long division."""
    first = (count + 2) * 100_000
    return 1 + first // whole * 10_000 + first % whole * 10_000 // whole


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def share_sql(count: str, whole: str) -> Column:
    return F.expr(f"1L + (({count} + 2) * 100000L div {whole}) * 10000L + (({count} + 2) * 100000L % {whole}) * 10000L "
                  f"div {whole}")


def distance_sql(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


FOUND = "part string, lang string, a string, b string, value long"


def corrections(top: int):
    """Function over postings sorted by language and term (``n``; ``whole`` and ``lang_whole`` as divisors of the source
    and the language): per pair of sources (``a`` < ``b``) the sum of what their common terms change, in part sums; and
    per source the terms (``b``) that stand out most, at least the first ``top``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, int] = {}
        keys, sums, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        best = pa.table({"group": pa.array([], pa.int64()), "term": pa.array([], pa.string()),
                         "value": pa.array([], pa.int64())})

        def added() -> tuple[np.ndarray, np.ndarray]:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, np.concatenate(sums))
            return key, total

        def pairs(key: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            names = list(groups)
            a, b = (key >> 31).tolist(), (key & (1 << 31) - 1).tolist()
            return pa.RecordBatch.from_arrays(
                [pa.array(["pair"] * len(key), pa.string()), pa.array([names[x][0] for x in a], pa.string()),
                 pa.array([names[x][1] for x in a], pa.string()), pa.array([names[x][1] for x in b], pa.string()),
                 pa.array(total)], ["part", "lang", "a", "b", "value"])

        for t in by_term(batches):
            n, whole, lang_whole = (t.column(c).to_numpy() for c in ("n", "whole", "lang_whole"))
            lang, source = (t.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
            both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            seen, group = np.unique(both, return_inverse=True)
            ids = [groups.setdefault((lang.dictionary[x // len(source.dictionary)].as_py(),
                                      source.dictionary[x % len(source.dictionary)].as_py()), len(groups))
                   for x in seen.tolist()]
            group = np.array(ids, np.int64)[group]
            heads = changes(t, ["lang", "term"])
            size = np.diff(np.append(heads, len(n)))
            p, none = share(n, whole), share(np.zeros_like(n), whole)
            q = share(np.repeat(np.add.reduceat(n, heads), size), lang_whole)

            out = p > q
            now = pa.table({"group": pa.array(group[out]), "term": t.column("term").filter(pa.array(out)),
                            "value": pa.array(distance(p, q)[out])})
            best = pa.concat_tables([best, now]).sort_by([("group", "ascending"), ("value", "descending"),
                                                          ("term", "ascending")])
            of = best.column("group").to_numpy()
            place = np.arange(len(of)) - np.searchsorted(of, of)
            best = best.filter(pa.array(place < top)).combine_chunks()

            later = np.repeat(size, size) - 1 - (np.arange(len(n)) - np.repeat(heads, size))
            ends = np.cumsum(later)
            start = 0
            while start < len(n):
                done = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + AT_ONCE, side="right")))
                k = later[start:stop]
                x = np.repeat(np.arange(start, stop), k)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(k) - k, k)
                change = (distance(p[x], p[y]) - distance(p[x], none[y]) - distance(none[x], p[y])
                          + distance(none[x], none[y]))
                key, at = np.unique(group[x] << 31 | group[y], return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, at, change)
                keys.append(key)
                sums.append(total)
                held += len(key)
                start = stop
                if held > SUMS:
                    key, total = added()
                    keys, sums, held = [key], [total], len(key)
                    if held > SUMS // 2:
                        yield pairs(key, total)
                        keys, sums, held = [key[:0]], [total[:0]], 0
        yield pairs(*added())
        names = list(groups)
        of = [names[g] for g in best.column("group").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(["term"] * len(of), pa.string()), pa.array([x[0] for x in of], pa.string()),
             pa.array([x[1] for x in of], pa.string()), best.column("term").combine_chunks().cast(pa.string()),
             best.column("value").combine_chunks()], ["part", "lang", "a", "b", "value"])
    return run


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """Rows ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``. Part ``pair``: the distance of a source to
    each other source (``item``) of its language over all kept terms. Part ``term``: the ``top`` terms that the source
    uses more often than its language does, by distance. Kept are a language's terms in ``least_docs`` of its documents.

    A term is a run of ASCII letters and non-ASCII characters, A-Z in lower case. Null text, language or source counts
    as ''. A source without text or kept terms has its pairs all the same; a language without kept terms gives pairs of
    value 0 and no terms; a language with one source gives no pairs. Ties are ranked by item in UTF-8 order. Each row is
    a document of its own, ``doc_id`` and other columns are not read. An empty table gives no rows. Results for pairs
    grow with the square of a language's sources, as asked; texts may be of any length.
    """
    found = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"),
                        F.coalesce("source", F.lit("")).alias("source"))
    index = settled(found.mapInArrow(runs, "lang string, term string, source string, n long, docs long")
                    .repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
                    .mapInArrow(merged(least_docs), "lang string, term string, source string, n long, first long"))
    sizes = settled(index.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first")))
    langs = sizes.groupBy("lang").agg(F.sum("first").alias("terms"),
                                      F.greatest(F.lit(1), F.sum("n") + 2 * F.sum("first")).alias("lang_whole"))
    groups = settled(sizes.select("lang", "source", "n").join(langs, "lang")
                     .withColumn("whole", F.greatest(F.lit(1), F.col("n") + 2 * F.col("terms"))).drop("n")
                     .withColumn("none", share_sql("0L", "whole")))
    index = index.filter("term <> ''").drop("first")
    streamed = (index.join(groups, ["lang", "source"]).select("lang", "term", "source", "n", "whole", "lang_whole")
                .repartition("lang", "term").sortWithinPartitions("lang", "term", "source"))
    found = settled(streamed.mapInArrow(corrections(top), FOUND))

    a = groups.select("lang", F.col("source").alias("a"), "terms", F.col("none").alias("none_a"))
    b = groups.select("lang", F.col("source").alias("b"), F.col("none").alias("none_b"))
    base = (a.join(b, "lang").filter("a <> b")
            .select("lang", "a", "b", (F.col("terms") * distance_sql("none_a", "none_b")).alias("value")))
    counts = (index.groupBy("lang", "source", "n").agg(F.count("*").alias("often"))
              .join(groups, ["lang", "source"])
              .select("lang", F.col("source").alias("a"), "often", share_sql("n", "whole").alias("p"),
                      F.col("none").alias("none_a")))
    alone = (counts.join(b, "lang").filter("a <> b").groupBy("lang", "a", "b")
             .agg(F.sum(F.col("often") * (distance_sql("p", "none_b") - distance_sql("none_a", "none_b")))
                  .alias("value")))
    common = found.filter("part = 'pair'").select("lang", "a", "b", "value")
    turned = [x.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value") for x in (alone, common)]
    pairs = (base.unionByName(alone).unionByName(common).unionByName(turned[0]).unionByName(turned[1])
             .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair")))
    place = F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b"))
    terms = (found.filter("part = 'term'").withColumn("rank", place).filter(F.col("rank") <= top))
    return (pairs.withColumn("rank", place).unionByName(terms)
            .select("lang", F.col("a").alias("source"), "part", F.col("b").alias("item"), "value", "rank"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT lang, source, r, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
           LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total + 2 * v)::HUGEINT AS p
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)::HUGEINT)
                              // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang))::HUGEINT
                             AS q FROM p GROUP BY lang, term),
x AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
      FROM g JOIN g AS h ON g.lang = h.lang AND g.source <> h.source
           LEFT JOIN (SELECT a.lang, a.source AS a, b.source AS b,
                             sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
                      FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
                      GROUP BY a.lang, a.source, b.source) AS s
           ON s.lang = g.lang AND s.a = g.source AND s.b = h.source
      UNION ALL
      SELECT p.lang, source, 'term', term, ((p - q) * (p - q)) // (p + q)
      FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM y WHERE part = 'pair' OR rank <= 10
"""
