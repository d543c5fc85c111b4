"""Source divergence audit: how far the term shares of a source lie from those of the other sources of its language.

A document's group is its (lang, source); null lang, source and text count as ''. Terms are runs of ASCII letters and of characters
beyond ASCII, with A-Z lower-cased. A language keeps the V terms that ``min_docs`` of its documents hold. With N, the occurrences
of kept terms in a group (or language), a term's share is p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), and two shares differ by
f = floor((p - q)^2 / (p + q)). A pair of sources differs by the sum of f over all kept terms.

Heavy-light split: a term that more than ``light`` groups hold is heavy. Heavy terms are dealt into tiles, and a task computes a
dense block of shares (terms x groups) and adds up f for the pairs of two blocks of groups. Both kinds start from the sum
that all terms would have if no group held them, which is known in closed form. Dense tiles add the difference to it; each posting of a light term corrects the pairs
of its group with all others (summed up by share, as only the share matters), and two postings of one term correct their own pair. All sums are integers.

The text is read once, and only (lang, source, term, count, documents) leaves a task. Tiles and blocks are bounded, and so are the
postings of a light term, so no task holds a language, a source or a frequent term. The result of ``pair_values`` has a row for each two sources of
a language, as asked.

Defined cases: documents without terms count as members of their group only; a language that keeps no term has value 0 for its pairs and no
term rows; a source alone in its language has no pairs; an empty table gives an empty result. Repeated rows and rows with null ids are
documents of their own; ids and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytehash import LOWER
from .common import discard, join_texts_lower, materialise, text_groups

#: Bytes of text that are counted at one time, terms of a dense tile, groups of a block.
GROUP_BYTES = 4 << 20
TILE_TERMS = 512
BLOCK_GROUPS = 64
#: Rows of light terms that a task turns into arrays at one time.
BATCH = 1 << 16

IN_TERM = np.zeros(256, bool)
IN_TERM[0x80:] = True
IN_TERM[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True

COUNTED = "lang string, source string, term string, n long, docs long"


# ---------------------------------------------------------------- counting


def term_slices(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """(dictionary-encoded terms of all texts in order, number of the text of each)."""
    data, ends = join_texts_lower(texts)
    inside = IN_TERM[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, end = edge[0::2], edge[1::2]
    offsets = np.zeros(len(start) + 1, np.int32 if len(data) < 2**31 else np.int64)
    np.cumsum(end - start, out=offsets[1:])
    kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
    terms = pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return terms.dictionary_encode(), np.searchsorted(ends, start, side="right")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_groups(batches, limit=GROUP_BYTES):
        terms, doc = term_slices(texts)
        words, codes = terms.dictionary, terms.indices.to_numpy().astype(np.int64)
        groups = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], names=["lang", "source"])
        names, group = np.unique([f"{len(r['lang'])}:{r['lang']}{r['source']}" for r in groups.to_pylist()], return_inverse=True)
        first = np.full(len(names), part.num_rows)
        np.minimum.at(first, group, np.arange(part.num_rows))
        held, n = np.unique(doc * max(1, len(words)) + codes, return_counts=True)  # one for each document and term
        of = group[held // max(1, len(words))] * max(1, len(words)) + held % max(1, len(words))
        keys, at = np.unique(of, return_inverse=True)
        count = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)
        docs = np.bincount(at, minlength=len(keys)).astype(np.int64)
        who = first[keys // max(1, len(words))]
        term = words.take(pa.array(keys % max(1, len(words)))).cast(pa.string() if words.type == pa.binary() else pa.large_string()).cast(pa.string())
        # each group once without a term, for groups that have none
        who, none = np.concatenate([who, first]), len(first)
        term = pa.concat_arrays([term, pa.nulls(none, pa.string())])
        zero = np.zeros(none, np.int64)
        yield pa.RecordBatch.from_arrays(
            [part.column("lang").take(pa.array(who)), part.column("source").take(pa.array(who)), term, pa.array(np.concatenate([count, zero])), pa.array(np.concatenate([docs, zero]))],
            names=["lang", "source", "term", "n", "docs"],
        )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs); one row with a null term for each group."""
    rows = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    return rows.mapInArrow(_count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- shares and values


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / total) by long division in three digits of base 1000, so that no product overflows; 1 where total is 0."""
    rest, out = count + 2, F.lit(1).cast("long")
    for unit in (1_000_000, 1000, 1):
        out = out + F.call_function("div", rest * 1000, total) * unit
        rest = (rest * 1000) % total
    return F.when(total > 0, out).otherwise(F.lit(1).cast("long"))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _dense(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """For all pairs of two blocks of groups: how much the terms of one tile add to what they would give if no group held them."""
    t = pa.Table.from_batches(list(batches))
    if not t.num_rows:
        return
    lang = t.column("lang")[0]
    g, p, zero = (t.column(c).to_numpy() for c in ("g", "p", "zero"))
    terms = t.column("term").combine_chunks().dictionary_encode()
    lacks = t.column("term").is_null().to_numpy()
    codes = terms.indices.fill_null(0).to_numpy()
    groups, at = np.unique(g, return_inverse=True)
    base = np.ones(len(groups), np.int64)
    base[at] = zero
    shares = np.repeat(base[:, None], len(terms.dictionary), 1)
    shares[at[~lacks], codes[~lacks]] = p[~lacks]
    low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
    left, right = np.flatnonzero(groups // size == low), np.flatnonzero(groups // size == high)
    seen = shares.shape[1]  # terms of the tile that these groups lack change nothing
    out = [(groups[i], groups[j], gaps(shares[i], shares[j]).sum() - seen * gaps(base[i], base[j])) for i in left for j in right if i < j]
    if out:
        a, b, v = (np.array(x, np.int64) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(a), pa.string()), *map(pa.array, (a, b, v))], names=["lang", "a", "b", "v"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of the pairs that hold the same light term, added up for each pair of a batch."""
    for whole in batches:
        for lo in range(0, whole.num_rows, BATCH):
            batch = whole.slice(lo, BATCH)
            lists = batch.column("held")
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            g, p, zero = (flat.field(c).to_numpy() for c in ("g", "p", "zero"))
            langs = batch.column("lang").dictionary_encode()
            own = np.repeat(langs.indices.to_numpy(), size)
            begin = np.cumsum(size) - size
            found = []
            for step in range(1, int(size.max(initial=0))):  # each posting with the one that stands `step` after it in its list
                i = np.flatnonzero(np.arange(len(g)) - np.repeat(begin, size) + step < np.repeat(size, size))
                j = i + step
                found.append((own[i], g[i], g[j], gaps(p[i], p[j]) - gaps(p[i], zero[j]) - gaps(zero[i], p[j]) + gaps(zero[i], zero[j])))
            if not found:
                continue
            l, a, b, v = (np.concatenate(x) for x in zip(*found, strict=True))
            keys, at = np.unique(np.stack([l, a, b]), axis=1, return_inverse=True)
            sums = np.zeros(keys.shape[1], np.int64)
            np.add.at(sums, at.ravel(), v)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys[0])), pa.array(keys[1]), pa.array(keys[2]), pa.array(sums)], names=["lang", "a", "b", "v"])


class Audit:
    """The counted tables of one corpus. ``close`` deletes what was written for them."""

    def __init__(self, docs: DataFrame, *, min_docs: int = 10, light: int = 8):
        self.counts = materialise(term_counts(docs), "termcounts")
        held = self.counts.where("term is not null")
        terms = held.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"), F.count("*").alias("groups")).where(F.col("docs") >= min_docs)
        terms = self.terms = materialise(terms.select("lang", "term", "all", (F.col("groups") > light).alias("heavy")), "terms")
        langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.col("heavy").cast("long")).alias("n_heavy"), F.sum("all").alias("n_lang"))
        kept = held.select("lang", "source", "term", "n").join(terms, ["lang", "term"])
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
        groups = self.counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
        # numbers of groups inside a language, by source
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
        groups = groups.withColumns({"total": F.col("n_group") + 2 * F.col("v"), "lang_total": F.col("n_lang") + 2 * F.col("v"), "g": number})
        self.groups = materialise(groups.withColumn("zero", share(F.lit(0).cast("long"), F.col("total"))), "groups")
        rows = kept.join(self.groups.select("lang", "source", "g", "total", "lang_total", "zero"), ["lang", "source"])
        rows = rows.select("lang", "source", "g", "term", "heavy", "zero", share(F.col("n"), F.col("total")).alias("p"), share(F.col("all"), F.col("lang_total")).alias("q"))
        self.rows = materialise(rows, "shares")

    def close(self) -> None:
        for t in (self.counts, self.terms, self.groups, self.rows):
            discard(t)

    def _heavy(self) -> DataFrame:
        """(lang, a, b, v) of the heavy terms, a < b."""
        size = BLOCK_GROUPS
        groups = self.groups.where("n_heavy > 0").withColumns({"tiles": F.ceil(F.col("n_heavy") / TILE_TERMS).cast("long"), "blocks": F.expr(f"(count(*) over (partition by lang) - 1) div {size}")})
        about = groups.select("lang", "tiles", "blocks").distinct()
        cells = self.rows.where("heavy").join(about, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile"), "blocks", "g", "term", "p", "zero")
        # every group is known to every tile, with its share of absent terms
        none = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("tile"), "blocks", "g", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), "zero")
        rows = cells.unionByName(none).withColumn("block", F.expr(f"g div {size}"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks"))))
        rows = rows.select("lang", "tile", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "g", "term", "p", "zero")
        return rows.groupBy("lang", "tile", "low", "high").applyInArrow(lambda t: pa.Table.from_batches(list(_dense(iter(t.to_batches()), size)), schema=pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("v", pa.int64())])), "lang string, a long, b long, v long")

    def _light(self) -> DataFrame:
        """(lang, a, b, v): corrections for two postings of one light term, and of each posting against all other groups."""
        light = self.rows.where("not heavy")
        lists = light.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("g", "p", "zero"))).alias("held")).where(F.size("held") > 1)
        both = lists.select("lang", "held").mapInArrow(_postings, "lang string, a long, b long, v long")
        alike = light.groupBy("lang", "g", "p", "zero").agg(F.count("*").alias("n"))
        others = self.groups.select("lang", F.col("g").alias("h"), F.col("zero").alias("other"))
        alone = alike.join(others, "lang").where("g <> h")
        alone = alone.select("lang", F.least("g", "h").alias("a"), F.greatest("g", "h").alias("b"), (F.col("n") * (gap(F.col("p"), F.col("other")) - gap(F.col("zero"), F.col("other")))).alias("v"))
        return both.unionByName(alone)

    def pair_values(self) -> DataFrame:
        """(lang, source, item, value) of every ordered pair of sources of a language."""
        sums = self._heavy().unionByName(self._light()).groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))
        one = self.groups.select("lang", F.col("g").alias("a"), F.col("source").alias("sa"), F.col("zero").alias("za"), F.col("v").alias("terms"))
        two = self.groups.select("lang", F.col("g").alias("b"), F.col("source").alias("sb"), F.col("zero").alias("zb"))
        pairs = one.join(two, "lang").where("a < b").join(sums.withColumnRenamed("v", "more"), ["lang", "a", "b"], "left")
        value = F.coalesce("more", F.lit(0)) + F.col("terms") * gap(F.col("za"), F.col("zb"))
        pairs = pairs.withColumn("value", value)
        ends = F.explode(F.array(F.struct(F.col("sa").alias("source"), F.col("sb").alias("item")), F.struct(F.col("sb").alias("source"), F.col("sa").alias("item")))).alias("e")
        return pairs.select("lang", ends, "value").select("lang", "e.source", "e.item", "value")

    def term_values(self) -> DataFrame:
        """(lang, source, item, value) of the terms that a group holds more often than its language does."""
        return self.rows.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))

    def ranked(self, terms: int = 10) -> DataFrame:
        """(lang, source, part, item, value, rank): all pairs, and the ``terms`` highest terms of each group."""
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        place = F.row_number().over(order)
        pairs = self.pair_values().select("lang", "source", F.lit("pair").alias("part"), "item", "value", place.alias("rank"))
        top = self.term_values().withColumn("rank", place).where(F.col("rank") <= terms)
        return pairs.unionByName(top.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def audit(docs: DataFrame, *, min_docs: int = 10, light: int = 8, terms: int = 10) -> DataFrame:
    return Audit(docs, min_docs=min_docs, light=light).ranked(terms)


SQL = """
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as t from documents),
words as (select r, lang, source, unnest(t) as term from docs),
kept as (select lang, term, count(*) as n from words group by all having count(distinct r) >= 10),
langs as (select lang, count(*) as v, sum(n)::bigint as n from kept group by 1),
counts as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
groups as (select d.lang, d.source, coalesce(l.v, 0) as v, coalesce(l.n, 0) as nl, coalesce(sum(c.n), 0)::bigint as n from (select distinct lang, source from docs) d left join langs l using (lang) left join counts c using (lang, source) group by all),
shares as materialized (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.n + 2 * g.v))::bigint as p, (1 + 1000000000 * (k.n + 2) // (g.nl + 2 * g.v))::bigint as q
  from groups g join kept k using (lang) left join counts c using (lang, source, term)),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
found as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from shares where n > 0 and p > q)
select lang, source, part, item, value, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from found qualify part = 'pair' or rank <= 10
"""
