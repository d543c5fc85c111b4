"""Line dedup with a log-template tree, in DataFrame operations only.

Tree of fixed depth: a line's tokens (split at blanks) first choose a branch by their number, then by the
two leading tokens; this is the leaf. Tokens with a digit are variable fields and are written ``<*>`` throughout, so
numbers, dates, addresses and ids don't tell lines apart. Other fields are found inside the leaf: a line has as pieces its
``LEADING`` leading tokens and ``SEGMENTS`` equal segments of the rest, and belongs to one template for each piece that may vary, which is all
but that piece (a leading token that varies makes the leaf one level shorter). At least ``LITERALS`` other tokens must stay. So lines that
differ in one field are one template, though none of them is found twice, and a leaf holds any number of templates.

A template recurs if it is in at least ``min_docs`` classes of documents; all lines of recurring templates are dropped. Near copies share a
class, so that copies of a document don't empty each other: they are left to near-duplicate detection. Equal texts are one
document. A document's sketch is the minima of its lines' hashes under ``BANDS * ROWS`` orders (segments of long lines count on
their own); documents with ``ROWS`` equal minima of one band are near. Two rounds carry the smallest label over near documents,
which makes one class of a group although few of its pairs share a band. Nothing depends on the lines next to a
line, so whole blocks go, and other copies elsewhere hide nothing. Documents that consist mostly of the same shared lines are near copies.

Counts are pre-aggregated by (template, class), joins on templates are salted, and the places that go are
collected for one document at most. Lines of templates in fewer classes stay.

Defined cases: null text stays null with no lines; empty lines are kept and never counted; repeated rows
(equal id and text) count as one document and lose the same lines; null ids are fine; a very long line
or text is one line or text like others; an empty table gives no rows. Other columns pass through
``drop_lines`` unchanged but for ``n_chars``, which follows the text; their names may be any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, packed

BLANK = r" \t\r\f\x0B"
#: A token with a digit, from its start on; possessive, so that other tokens cost one pass.
FIELD = rf"(?<![^{BLANK}\n])[^{BLANK}\n0-9]*+[0-9][^{BLANK}\n]*+"
LEADING = 2
SEGMENTS = 4
MIN_DOCS = 8
#: Near-copy classes: documents that agree in all ROWS minima of one of BANDS bands belong together.
BANDS = 8
ROWS = 4
#: From this many tokens on, a line's segments count on their own in a document's minima.
SKETCH_TOKENS = 14
#: A template with a varying piece keeps at least so many other tokens.
LITERALS = 3
SALTS = 8
#: Multiplier of the orders: the i-th is by exclusive or with i times this, cut to 60 bits.
ORDER = 0x9E3779B97F4A7C15
PIECES = [f"t{j}" for j in range(LEADING)] + [f"s{j}" for j in range(SEGMENTS)]


def hash60(text: Column) -> Column:
    """The first 60 bits of a text's MD5: the same number in any SQL engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def orders() -> list[int]:
    return [(i + 1) * ORDER % (1 << 60) for i in range(BANDS * ROWS)]


def line_table(docs: DataFrame) -> DataFrame:
    """(key, label, pos, n, template, t0.., s0..) of every line with a token; t are hashes of its leading tokens, s of its segments."""
    # every text is looked through once: a filter on the lists of tokens would build them a second time, and a single blank needs no pattern
    rows = docs.where("text is not null")
    one = F.when(F.col("text").rlike(r"[\t\r\f\x0B]"), F.translate("text", "\t\r\f\x0b", "    ")).otherwise(F.col("text"))
    lists = F.transform(F.split(F.regexp_replace(one, FIELD, "<*>"), "\n"), lambda line: F.array_remove(F.split(line, " "), ""))
    rows = rows.select(F.xxhash64("doc_id", "text").alias("key"), hash60(F.col("text")).alias("label"), F.posexplode(lists).alias("pos", "t")).where(F.size("t") > 0)
    edge = [F.expr(f"greatest(size(t) - {LEADING}, 0) * {j} div {SEGMENTS}").cast("int") for j in range(SEGMENTS + 1)]
    piece = [F.array_join(F.slice("t", edge[j] + LEADING + 1, edge[j + 1] - edge[j]), " ") for j in range(SEGMENTS)]
    # segments are only compared between lines of equal length; those of short lines are in no sketch, so any hash does
    cuts = [F.when(F.size("t") >= SKETCH_TOKENS, hash60(x)).otherwise(F.xxhash64(x)).alias(f"s{j}") for j, x in enumerate(piece)]
    heads = [F.xxhash64(F.get("t", F.lit(j))).alias(f"t{j}") for j in range(LEADING)]
    return rows.select("key", "label", "pos", F.size("t").alias("n"), hash60(F.array_join("t", " ")).alias("template"), *heads, *cuts)


def patterns_of() -> Column:
    """The line's template, and one for each piece that may vary: everything but that piece, and its place."""
    sizes = [F.when(F.col("n") > j, 1).otherwise(0) for j in range(LEADING)] + [F.expr(f"greatest(n - {LEADING}, 0) * {j + 1} div {SEGMENTS} - greatest(n - {LEADING}, 0) * {j} div {SEGMENTS}").cast("int") for j in range(SEGMENTS)]
    loose = [F.when((size > 0) & (F.col("n") - size >= LITERALS), F.xxhash64(F.lit(j), "n", *(x for x in PIECES if x != PIECES[j]))) for j, size in enumerate(sizes)]
    return F.array_compact(F.array("template", *loose))


def document_classes(lines: DataFrame) -> DataFrame:
    """(label, class): near copies share a class; documents that are near no other are left out."""
    long = F.col("n") >= SKETCH_TOKENS
    low = lambda c: F.least(F.col("template").bitwiseXOR(c), *(F.when(long, F.col(f"s{j}").bitwiseXOR(c)) for j in range(SEGMENTS)))
    sketch = lines.groupBy("label").agg(*(F.min(low(F.lit(c))).alias(f"m{i}") for i, c in enumerate(orders())))
    bands = [F.xxhash64(F.lit(b), *(f"m{b * ROWS + r}" for r in range(ROWS))) for b in range(BANDS)]
    member = materialise(sketch.select("label", F.explode(F.array(*bands)).alias("band")), "bands")
    shared = member.groupBy("band").agg(F.count("*").alias("c"), F.min("label").alias("low")).where("c > 1").select("band", "low")
    first = materialise(_salted(member, "label").join(_spread(shared), ["band", "salt"]).select("label", "band", "low"), "shared-bands")
    once = first.groupBy("label").agg(F.min("low").alias("class"))
    spread = first.join(once, "label").groupBy("band").agg(F.min("class").alias("low"))
    classes = _salted(first.select("label", "band"), "label").join(_spread(spread), ["band", "salt"]).groupBy("label").agg(F.min("low").alias("class"))
    out = materialise(classes, "classes")
    discard(member)
    discard(first)
    return out


def _salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))


def _spread(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, drop): places of the lines of which a template is in at least ``min_docs`` classes of documents."""
    lines = materialise(line_table(docs), "lines")
    classes = document_classes(lines)
    held = lines.join(classes, "label", "left").select(F.explode(patterns_of()).alias("pattern"), F.coalesce("class", "label").alias("class")).distinct()
    often = materialise(held.groupBy("pattern").agg(F.count("*").alias("classes")).where(F.col("classes") >= min_docs).select("pattern"), "templates")
    found = lines.select("key", "pos", F.explode(patterns_of()).alias("pattern"))
    return _salted(found, "key").join(_spread(often), ["pattern", "salt"]).groupBy("key").agg(F.collect_set("pos").alias("drop"))


def _judged(docs: DataFrame, min_docs: int) -> DataFrame:
    """(row, drop, lines, kept): the packed row, places that go, all lines, and the lines that stay."""
    gone = dropped_lines(docs.select("doc_id", "text"), min_docs)
    rows = docs.select(packed(docs), F.xxhash64("doc_id", "text").alias("key")).join(gone, "key", "left")
    rows = rows.withColumn("lines", F.split("row.text", "\n"))
    stay = F.sort_array(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")))
    return rows.withColumn("kept", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.get(F.col("lines"), i))))


def line_report(docs: DataFrame, *, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row; no lines and no hash for null text."""
    rows = _judged(docs.select("doc_id", "text"), min_docs)
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    kept = F.array_join("kept", "\n")
    return rows.select("row.doc_id", size("lines").alias("n_lines"), (size("lines") - size("kept")).alias("n_dropped"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``; every row stays."""
    rows = _judged(docs, min_docs)
    text = F.when(F.col("drop").isNull(), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("drop").isNull(), F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def _sql() -> str:
    """The same rule in DuckDB SQL; templates are compared as token lists."""
    m = f"greatest(n - {LEADING}, 0)"
    cut = [f"({m} * {j} // {SEGMENTS})" for j in range(SEGMENTS + 1)]
    hash60_ = lambda x: f"('0x' || substr(md5({x}), 1, 15))::bigint"
    spans = [(str(j), str(j + 1), f"(n > {j})::int") for j in range(LEADING)] + [(f"{LEADING} + {cut[j]}", f"{LEADING} + {cut[j + 1]}", f"{cut[j + 1]} - {cut[j]}") for j in range(SEGMENTS)]
    loose = [f"case when {size} > 0 and n - ({size}) >= {LITERALS} then {{'j': {j}, 't': list_concat(list_append(t[1 : {lo}], ''), t[{hi} + 1 : n])}} end" for j, (lo, hi, size) in enumerate(spans)]
    segments = ", ".join(hash60_(f"array_to_string(t[{lo} + 1 : {hi}], ' ')") for lo, hi, _ in spans[LEADING:])
    return rf"""
with base as (select distinct doc_id, text from documents where text is not null),
masked as (select row_number() over () as key, doc_id, text, {hash60_("text")} as label, string_split(regexp_replace(text, '[^{BLANK}
]*[0-9][^{BLANK}
]*', '<*>', 'g'), chr(10)) as ls from base),
lists as (select key, label, list_transform(ls, lambda l: list_filter(string_split_regex(l, '[{BLANK}]+'), lambda t: t <> '')) as lines from masked),
lines as (select key, label, i - 1 as pos, lines[i] as t, len(lines[i]) as n from (select key, label, lines, unnest(range(1, len(lines) + 1)) as i from lists) where len(lines[i]) > 0),
hashes as (select distinct label, unnest(list_concat([{hash60_("array_to_string(t, ' ')")}], case when n >= {SKETCH_TOKENS} then [{segments}] else [] end)) as h from lines),
minima as (select label, i, min(xor(h, c)) as m from hashes, (select unnest(range({BANDS * ROWS})) as i, unnest({[int(c) for c in orders()]}) as c) group by all),
member as (select label, i // {ROWS} as b, list(m order by i) as band from minima group by all),
shared as (select b, band, min(label) as low from member group by all having count(*) > 1),
once as (select label, min(low) as class from member join shared using (b, band) group by label),
spread as (select b, band, min(class) as low from member join shared using (b, band) join once using (label) group by all),
classes as (select label, min(low) as class from member join spread using (b, band) group by label),
patterns as (select key, label, pos, unnest(list_filter([{{'j': -1, 't': t}}, {", ".join(loose)}], lambda x: x is not null)) as p, n from lines),
often as (select p, n from patterns left join classes using (label) group by all having count(distinct coalesce(class, label)) >= {MIN_DOCS}),
gone as (select distinct key, pos from patterns join often using (p, n)),
kept as (select m.doc_id, m.text, count(*) as n_lines, count(g.pos) as n_dropped, coalesce(string_agg(x.l, chr(10) order by x.i) filter (g.pos is null), '') as body
  from masked m join (select key, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as i from masked) x using (key) left join gone g on g.key = x.key and g.pos = x.i group by m.key, m.doc_id, m.text)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_dropped, 0)::bigint as n_dropped, sha256(k.body) as kept_sha256
from documents d left join kept k on k.doc_id is not distinct from d.doc_id and k.text = d.text
"""


SQL = _sql()
