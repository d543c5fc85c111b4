"""Registered queries of the variant-graph engine over derived data, each with SQL that states the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import abbreviated, file_name, haplotype_name
from ..operators import graph as g
from ..operators import incidence, matching, paths, regions, segments, walk
from ..sources import datasource, readers
from . import derived, founder_sql
from .graph import Graph

BLOCK_BUBBLES = 200
FOUNDERS = 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_ACGT = "substr('ACGT', (1 + (7 * p + 3 * chrom + p // 5) % 4)::int, 1)"
_CTE = f"""
v as (select o_orderkey as vid, o_orderkey % 5 as chrom, 3 * (o_orderkey // 5) + (o_orderkey // 5) % 2 as pos, (1 + o_custkey % 8)::bigint as ref_len, (1 + o_custkey % 3)::int as n_alt, o_orderpriority as prio from orders),
vr as (select *, array_to_string(list_transform(range(pos, pos + ref_len), lambda p: {_ACGT}), '') as ref from v),
alts as (select vid, chrom, pos, ref_len, i::int as i, case when prio = '5-LOW' and i = n_alt then '<DEL>' else repeat(substr('ACGT', (1 + (vid + i) % 4)::int, 1), (1 + (vid + 3 * i) % 5)::int) end as alt
  from (select *, unnest(range(1, n_alt + 1)) as i from v)),
lens as (select chrom, max(pos + ref_len) + 8 as n from v group by chrom),
gts as (select v.chrom, v.vid, (l_suppkey % 10)::int as sample_idx, (l_linenumber % 2)::int as copy_idx, min((1 + l_partkey % v.n_alt)::int) as allele from lineitem join v on v.vid = l_orderkey group by 1, 2, 3, 4),
places as (select chrom, pos as p from v union select chrom, pos + ref_len from v union select chrom, 0 from lens union select chrom, n from lens),
nodes as (select chrom, p as ref_pos, row_number() over (partition by chrom order by p) - 1 as node, p - coalesce(lag(p) over (partition by chrom order by p), 0) as ref_delta from places),
numbered as (select *, case when alt = '<DEL>' then '' else alt end as label, row_number() over (partition by chrom order by vid, i) - 1 as edge from alts),
edges as (select e.chrom, e.edge, s.node as src, d.node as dst, e.pos as src_pos, e.pos + e.ref_len as tgt_pos, e.label, e.vid as variant_idx, e.i as alt_idx
  from numbered e join nodes s on s.chrom = e.chrom and s.ref_pos = e.pos join nodes d on d.chrom = e.chrom and d.ref_pos = e.pos + e.ref_len),
reach as (select chrom, src as node, max(dst) as reach from edges group by 1, 2),
far as (select n.*, coalesce(max(reach) over (partition by n.chrom order by n.node rows between unbounded preceding and 1 preceding) <= n.node, true) as is_bridge from nodes n left join reach r on r.chrom = n.chrom and r.node = n.node),
marked as (select *, coalesce(sum(is_bridge::int) over (partition by chrom order by node rows between unbounded preceding and 1 preceding), 0)::bigint as bubble from far),
carried as (select g.chrom, (g.sample_idx * 2 + g.copy_idx) as copy, e.edge, e.src, e.dst, e.src_pos, e.tgt_pos, g.vid as variant_idx, g.allele from gts g join edges e on e.chrom = g.chrom and e.variant_idx = g.vid and e.alt_idx = g.allele),
copies as (select chrom, c as copy, c // 2 as sample_idx, 'S' || (c // 2) as name, c % 2 as copy_idx from lens, range(20) t(c))
"""
_ALIGNED = """
inner_ as (select m.*, min(node) over (partition by chrom, bubble) - 1 as base from marked m where node > 0),
ins as (select e.chrom, e.dst as node, list({'s': e.src - i.base, 'l': length(e.label)}) as ins from edges e join inner_ i on i.chrom = e.chrom and i.node = e.dst group by 1, 2),
steps as (select i.chrom, i.bubble, i.base, i.node - i.base as k, i.ref_delta, ins.ins from inner_ i left join ins on ins.chrom = i.chrom and ins.node = i.node),
fold as (select distinct chrom, bubble, base, 0::bigint as k, [0::bigint] as vals from steps union all
  select f.chrom, f.bubble, f.base, s.k, list_append(f.vals, greatest(f.vals[-1] + s.ref_delta, coalesce(list_max(list_transform(s.ins, lambda x: f.vals[x.s + 1] + x.l)), 0)))
  from fold f join steps s on s.chrom = f.chrom and s.bubble = f.bubble and s.k = f.k + 1),
ends as (select chrom, bubble, base, arg_max(vals, k) as vals from fold group by 1, 2, 3),
befores as (select *, coalesce(sum(vals[-1]) over (partition by chrom order by bubble rows between unbounded preceding and 1 preceding), 0)::bigint as before from ends),
aln as (select chrom, base + k as node, before + vals[k + 1] as aln_pos from (select *, unnest(range(1, len(vals))) as k from befores) union all select chrom, 0, 0 from lens),
aligned as (select m.*, a.aln_pos from marked m join aln a on a.chrom = m.chrom and a.node = m.node)
"""
_TAKEN = """
opens as (select *, coalesce(max(dst) over (partition by chrom, copy order by edge rows between unbounded preceding and 1 preceding) <= src, true)::int as o from carried),
islands as (select *, sum(o) over (partition by chrom, copy order by edge) as island from opens),
ranked as (select *, row_number() over (partition by chrom, copy, island order by edge) as k from islands),
walked as (select chrom, copy, island, k, edge, dst as stop, true as taken from ranked where k = 1 union all
  select r.chrom, r.copy, r.island, r.k, r.edge, case when r.src >= w.stop then r.dst else w.stop end, r.src >= w.stop from walked w join ranked r on r.chrom = w.chrom and r.copy = w.copy and r.island = w.island and r.k = w.k + 1),
taken as (select chrom, copy, edge from walked where taken)
"""
_PIECES = f"""
pieces as (select a.chrom, (a.bubble - 1) // {walk.BUBBLES} as chunk_no, a.node, b.aln_pos as aln, a.aln_pos - b.aln_pos as width,
  array_to_string(list_transform(range(b.ref_pos, a.ref_pos), lambda p: substr('ACGT', (1 + (7 * p + 3 * a.chrom + p // 5) % 4)::int, 1)), '') as text
  from aligned a join aligned b on b.chrom = a.chrom and b.node = a.node - 1),
own as (select t.chrom, t.copy, e.src, e.dst, e.label, s.aln_pos as aln, d.aln_pos - s.aln_pos as width, (d.bubble - 1) // {walk.BUBBLES} as chunk_no
  from taken t join edges e on e.chrom = t.chrom and e.edge = t.edge join aligned s on s.chrom = e.chrom and s.node = e.src join aligned d on d.chrom = e.chrom and d.node = e.dst),
covered as (select distinct chrom, copy, unnest(range(src + 1, dst + 1)) as node from own),
parts as (select p.chrom, c.copy, p.chunk_no, p.aln, p.width, p.text from pieces p join copies c on c.chrom = p.chrom anti join covered v on v.chrom = p.chrom and v.copy = c.copy and v.node = p.node
  union all select chrom, copy, chunk_no, aln, width, label from own)
"""
_BLOCKS = f"""
blocks as (select e.*, (m.bubble - 1) // {BLOCK_BUBBLES} as block from edges e join marked m on m.chrom = e.chrom and m.node = e.dst),
sigs as (select c.chrom, b.block, c.copy, list_sort(list(distinct c.edge), 'DESC') as sig from carried c join blocks b on b.chrom = c.chrom and b.edge = c.edge group by 1, 2, 3),
grid as (select g.chrom, g.block, c.copy, coalesce(s.sig, []::bigint[]) as sig from (select distinct chrom, (bubble - 1) // {BLOCK_BUBBLES} as block from marked where node > 0) g
  join copies c on c.chrom = g.chrom left join sigs s on s.chrom = g.chrom and s.block = g.block and s.copy = c.copy),
classes as (select *, dense_rank() over (partition by chrom, block order by sig) - 1 as cls from grid)
"""


def query(sql: str | None = None, *parts: str):
    """Register a query; ``parts`` name the common table expressions that its SQL needs."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = "with recursive " + ",".join((_CTE, *parts)) + sql
        return f

    return keep


def _blocks(graph) -> DataFrame:
    at = graph.nodes.select("chrom", F.col("node").alias("dst"), F.expr(f"(bubble - 1) div {BLOCK_BUBBLES}").alias("block"))
    return graph.edges.join(at, ["chrom", "dst"]).select("chrom", "edge", "block")


def _spans(graph) -> DataFrame:
    return graph.nodes.where("node > 0").select("chrom", F.expr(f"(bubble - 1) div {BLOCK_BUBBLES}").alias("block")).distinct()


def _classes(graph) -> DataFrame:
    return segments.colex_ranks(segments.block_signatures(graph.carried, _blocks(graph)), graph.copies).select("chrom", "block", "copy", "cls")


@query("select chrom, vid as variant_idx, pos, ref, n_alt::bigint as n_alt from vr")
def variants_scan(spark, sf):
    return derived.variants(spark, sf).select("chrom", "variant_idx", "pos", "ref", F.size("alts").cast("long").alias("n_alt"))


_FILE = """
lined as (select v.*, chrom::varchar as name, 2 + row_number() over (order by chrom, pos, vid) as lineno, n_alt + (vid % 7 = 0)::int as listed from vr v)
"""


@query("select name as chrom, lineno, pos, 'v' || vid as id, ref, listed::bigint as n_alt from lined", _FILE)
def vcf_records(spark, sf):
    """Records as the reader finds them in a VCF file."""
    rows = readers.read_vcf(spark, derived.vcf_file(spark, sf))[0]
    return rows.select("chrom", "lineno", "pos", F.array_join("ids", ";").alias("id"), "ref", F.size("alts").cast("long").alias("n_alt"))


@query("select l.name as chrom, l.lineno, g.sample_idx, g.copy_idx, g.allele from gts g join lined l using (vid) where l.name = '2'", _FILE)
def vcf_genotypes(spark, sf):
    """Carried alleles that the reader finds on one chromosome of the file."""
    rows = readers.read_vcf(spark, derived.vcf_file(spark, sf), "2")[1].where("allele > 0")
    return rows.select("chrom", F.col("variant_idx").alias("lineno"), "sample_idx", "copy_idx", "allele")


@query("select name as chrom, lineno, pos, 'v' || vid as id, ref, listed::bigint as n_alt from lined where name = '3'", _FILE)
def vcf_source(spark, sf):
    """One chromosome of a VCF file through the data source, in ranges of 64 kB; the choice is pushed down."""
    rows = datasource.vcf_records(spark, derived.vcf_file(spark, sf), "3", split=1 << 16)
    return rows.select("chrom", "lineno", "pos", F.array_join("ids", ";").alias("id"), "ref", F.size("alts").cast("long").alias("n_alt"))


@query(f"select 'c' || chrom as chrom, (p // {derived.CHUNK})::int as chunk_no, count(*) as n_chars, md5(string_agg({_ACGT}, '' order by p)) as text_md5 from (select chrom, unnest(range(n)) as p from lens) group by 1, 2")
def fasta_source(spark, sf):
    """Every record of a FASTA file through the data source, in ranges of 64 kB."""
    rows = datasource.fasta_reference(spark, derived.fasta_file(spark, sf), chunk=derived.CHUNK, split=1 << 16)
    return _digest(rows.withColumnRenamed("bases", "text"), "chrom", "chunk_no")


@query("select c.name as chrom, count(*) filter (v.chrom = c.chrom) as handled, count(*) filter (v.chrom <> c.chrom) as mismatches from v, (select distinct chrom, chrom::varchar as name from v) c group by 1")
def chrom_filter_stats(spark, sf):
    """What a choice of each chromosome of the file handles and passes over."""
    return readers.record_counts(spark, derived.vcf_file(spark, sf)).withColumnsRenamed({"records": "handled", "others": "mismatches"})


@query("select '2' as chrom, count(*) filter (chrom = 2) as handled, count(*) filter (chrom <> 2) as chrom_mismatches, 0::bigint as ref_mismatches from v")
def build_stats(spark, sf):
    """The numbers of a graph built from files of FASTA, VCF and samples."""
    built = Graph.from_files(spark, derived.fasta_file(spark, sf), derived.vcf_file(spark, sf), "2", record="c2", chunk=derived.CHUNK)
    return spark.createDataFrame([("2", *(built.stats[k] for k in ("handled", "chrom_mismatches", "ref_mismatches")))], "chrom string, handled long, chrom_mismatches long, ref_mismatches long")


@query(f"select chrom::varchar as chrom, (p // {derived.CHUNK})::int as chunk_no, count(*) as n_chars, md5(string_agg({_ACGT}, '' order by p)) as text_md5 from (select chrom, unnest(range(n)) as p from lens) group by 1, 2")
def fasta_reference(spark, sf):
    """Every record of a FASTA file with several."""
    path = derived.fasta_file(spark, sf)
    parts = [readers.read_fasta(spark, path, str(c), record=f"c{c}", chunk=derived.CHUNK) for c in range(5)]
    rows = functools.reduce(DataFrame.unionByName, parts)
    return _digest(rows.withColumnRenamed("bases", "text"), "chrom", "chunk_no")


@query("select l.name as chrom, l.lineno, a.i as alt_idx, case when alt = '<DEL>' then '' else alt end as label from alts a join lined l using (vid)", _FILE)
def alt_kind_filter(spark, sf):
    """Alternatives that become edges, by the kinds that the reader gives them."""
    rows = g.handled_alts(readers.read_vcf(spark, derived.vcf_file(spark, sf))[0])
    return rows.select("chrom", F.col("variant_idx").alias("lineno"), "alt_idx", "label")


@query("select chrom, vid as variant_idx, pos, 'N' || substr(ref, 2) as ref, ref as expected from vr where vid % 97 = 3")
def ref_mismatch_check(spark, sf):
    rows = derived.variants(spark, sf)
    spoilt = rows.withColumn("ref", F.when(F.col("variant_idx") % 97 == 3, F.concat(F.lit("N"), F.expr("substring(ref, 2)"))).otherwise(F.col("ref")))
    return g.ref_mismatches(spoilt, derived.reference(spark, sf), derived.CHUNK)


@query("select chrom, vid as variant_idx, pos from (select *, max(case when vid % 89 = 5 then pos + 40 else pos end) over (partition by chrom order by vid rows between unbounded preceding and 1 preceding) as seen, case when vid % 89 = 5 then pos + 40 else pos end as p from v) where seen > p")
def sortedness_check(spark, sf):
    rows = derived.variants(spark, sf)
    moved = rows.withColumn("pos", F.when(F.col("variant_idx") % 89 == 5, F.col("pos") + 40).otherwise(F.col("pos")))
    return g.unsorted_records(moved).select("chrom", "variant_idx", "pos")


_LISTED = "chrom < 3 and sample_idx < 5 and copy_idx = 0"


@query(f"select chrom, vid as variant_idx, sample_idx, copy_idx, allele from gts where {_LISTED}")
def sample_include(spark, sf):
    rows = paths.chosen_genotypes(derived.genotypes(spark, sf), derived.names(spark), derived.sample_list(spark, sf))
    return rows.select("chrom", "variant_idx", "sample_idx", "copy_idx", "allele")


@query(f"select chrom, vid as variant_idx, sample_idx, copy_idx, allele from gts where not ({_LISTED})")
def sample_exclude(spark, sf):
    rows = paths.chosen_genotypes(derived.genotypes(spark, sf), derived.names(spark), derived.sample_list(spark, sf), exclude=True)
    return rows.select("chrom", "variant_idx", "sample_idx", "copy_idx", "allele")


@query("select '1' as chrom, 'S' || i as sample, 0 as copy_idx from range(5) t(i)")
def sample_list_filter(spark, sf):
    """The sample list of one chromosome, read from its file."""
    return readers.read_sample_list(spark, derived.sample_file(spark, sf), "1")


@query("select chrom, sample_idx::int as sample_idx, name, count(*) as ploidy, min(copy)::int as copy_base from copies group by all")
def ploidy_csum(spark, sf):
    return paths.ploidy(derived.copies(spark, sf))


@query("select chrom, node, ref_pos, ref_delta from nodes")
def graph_nodes(spark, sf):
    v = derived.variants(spark, sf)
    return g.build_nodes(v, g.handled_alts(v), g.reference_lengths(derived.reference(spark, sf)))


@query("select chrom, edge, src, dst, label, variant_idx, alt_idx from edges")
def graph_edges(spark, sf):
    return derived.graph(spark, sf).edges.select("chrom", "edge", "src", "dst", "label", "variant_idx", "alt_idx")


@query("select n.chrom, n.node, count(e.edge) as n_edges, (sum(count(e.edge)) over (partition by n.chrom order by n.node) - count(e.edge))::bigint as first_edge from nodes n left join edges e on e.chrom = n.chrom and e.src = n.node group by 1, 2")
def edge_csum(spark, sf):
    graph = derived.graph(spark, sf)
    return g.edge_counts(graph.nodes, graph.edges)


@query("select chrom, node - 1 as src, node as dst, ref_pos - ref_delta as src_pos, ref_pos as tgt_pos from nodes where node > 0")
def ref_edges(spark, sf):
    return g.ref_edges(graph_nodes(spark, sf))


@query("select n.chrom, n.nodes, e.alt_edges, 20::bigint as copies from (select chrom, count(*) as nodes from nodes group by 1) n join (select chrom, count(*) as alt_edges from edges group by 1) e using (chrom)")
def graph_stats(spark, sf):
    return derived.graph(spark, sf).statistics()


@query("select chrom, copy::int as copy, edge, src, dst, allele from carried")
def paths_long(spark, sf):
    return derived.graph(spark, sf).paths.select("chrom", F.col("copy").cast("int"), "edge", "src", "dst", "allele")


@query("select chrom, edge, count(*) as carriers from carried group by 1, 2")
def edge_carriers(spark, sf):
    return incidence.carriers(derived.graph(spark, sf).carried)


@query("""select c.chrom, c.copy::int as copy, edge // 4096 as chunk, count(*) as carried, bit_xor(edge % 4096 * 1000003 + 1)::bigint as mark,
  (coalesce(sum(case when edge % 64 = 63 then 0 else 1::hugeint << (edge % 64)::int end) filter (edge // 64 % 64 = 0), 0) - case when bool_or(edge % 4096 = 63) then 9223372036854775808::hugeint else 0 end)::bigint as first_word from carried c group by 1, 2, 3""")
def copy_words(spark, sf):
    """The packed matrix by copies: of each chunk the number of carried edges, a checksum of their places, and the first word."""
    rows = incidence.copy_words(derived.graph(spark, sf).carried)
    ones = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))
    places = F.expr("filter(transform(sequence(0, 4095), i -> if((shiftright(words[i div 64], i % 64) & 1) = 1, i * 1000003L + 1, 0L)), x -> x > 0)")
    mark = F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    return rows.select("chrom", "copy", "chunk", ones.alias("carried"), mark.alias("mark"), F.get("words", F.lit(0)).alias("first_word"))


@query("select o.chrom, o.variant_idx + 1 as \"LINENO\", o.src_pos as \"POS\", 'v' || o.variant_idx as \"ID\", 'S' || (o.copy // 2) as \"SAMPLE\", (o.copy % 2)::int as \"CHROM_COPY\", o.allele as \"GT\" from (select *, lag(tgt_pos) over (partition by chrom, copy order by variant_idx, edge) as last from carried) o where o.last > o.src_pos")
def overlap_report(spark, sf):
    return derived.graph(spark, sf).overlap_report().withColumn("CHROM_COPY", F.col("CHROM_COPY").cast("int"))


@query("select chrom, node, ref_pos from marked where is_bridge")
def bridge_nodes(spark, sf):
    return derived.graph(spark, sf).nodes.where("is_bridge").select("chrom", "node", "ref_pos")


@query("select chrom, bubble, min(node) - 1 as first_node, max(node) as last_node, count(*) as nodes, sum(ref_delta)::bigint as ref_span from marked where node > 0 group by 1, 2")
def bubbles(spark, sf):
    rows = derived.graph(spark, sf).nodes.where("node > 0")
    return rows.groupBy("chrom", "bubble").agg((F.min("node") - 1).alias("first_node"), F.max("node").alias("last_node"), F.count("*").alias("nodes"), F.sum("ref_delta").alias("ref_span"))


@query("select chrom, node, ref_pos, aln_pos from aligned", _ALIGNED)
def aligned_positions(spark, sf):
    return derived.graph(spark, sf).nodes.select("chrom", "node", "ref_pos", "aln_pos")


@query("select chrom, copy::int as copy, edge from taken", _TAKEN)
def taken_edges(spark, sf):
    return derived.graph(spark, sf).taken.select("chrom", F.col("copy").cast("int"), "edge")


_DIGEST = "length(t)::bigint as n_chars, md5(t) as text_md5"


def _digest(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"select chrom, chunk_no, {_DIGEST} from (select chrom, chunk_no, string_agg(text || repeat('-', (width - length(text))::int), '' order by aln, width) as t from pieces group by 1, 2)", _ALIGNED, _TAKEN, _PIECES)
def ref_row(spark, sf):
    return _digest(walk.ref_row(derived.graph(spark, sf).chunks), "chrom", "chunk_no")


@query(f"select chrom, copy::int as copy, chunk_no, {_DIGEST} from (select chrom, copy, chunk_no, string_agg(text || repeat('-', (width - length(text))::int), '' order by aln, width) as t from parts group by 1, 2, 3)", _ALIGNED, _TAKEN, _PIECES)
def haplotype_rows(spark, sf):
    return _digest(derived.graph(spark, sf).copy_texts().withColumn("copy", F.col("copy").cast("int")), "chrom", "copy", "chunk_no")


@query(f"select chrom, copy::int as copy, chunk_no, {_DIGEST} from (select chrom, copy, chunk_no, string_agg(text, '' order by aln, width) as t from parts group by 1, 2, 3)", _ALIGNED, _TAKEN, _PIECES)
def haplotype_rows_unaligned(spark, sf):
    return _digest(derived.graph(spark, sf).copy_texts(False).withColumn("copy", F.col("copy").cast("int")), "chrom", "copy", "chunk_no")


@query("select chrom, copy::int as copy, name || '-' || (copy_idx + 1) as seq_id, name || '.' || (copy_idx + 1) || '.a2m' as file from copies")
def sequence_names(spark, sf):
    rows = derived.copies(spark, sf)
    ext = file_name([""], chromosome=None, a2m=True, aligned=True)
    return rows.select("chrom", "copy", haplotype_name(F.col("name"), F.col("copy_in_sample")).alias("seq_id"), F.concat("name", F.lit("."), (F.col("copy_in_sample") + 1).cast("string"), F.lit(ext)).alias("file"))


@query("select chrom, block, copy::int as copy, array_to_string(sig, ',') as sig from grid where len(sig) > 0", _BLOCKS)
def block_signatures(spark, sf):
    graph = derived.graph(spark, sf)
    return segments.block_signatures(graph.carried, _blocks(graph)).select("chrom", "block", F.col("copy").cast("int"), F.array_join("sig", ",").alias("sig"))


@query("select chrom, block, count(distinct sig) as n_classes from grid group by 1, 2", _BLOCKS)
def block_class_count(spark, sf):
    graph = derived.graph(spark, sf)
    return segments.class_counts(segments.block_signatures(graph.carried, _blocks(graph)), graph.copies, _spans(graph))


@query("select chrom, block, cls, min(copy)::int as first_copy, count(*) as size from classes group by 1, 2, 3", _BLOCKS)
def block_classes(spark, sf):
    graph = derived.graph(spark, sf)
    return segments.class_sizes(_classes(graph), graph.copies, _spans(graph))


@query("select chrom, block, cls, arg_min(copy, {'h': h, 'c': copy})::int as representative from (select c.*, coalesce((select list_sort(list(distinct d.edge), 'DESC') from carried d join blocks b on b.chrom = d.chrom and b.edge = d.edge where d.chrom = c.chrom and d.copy = c.copy and b.block < c.block), []::bigint[]) as h from classes c) group by 1, 2, 3", _BLOCKS)
def class_representative(spark, sf):
    graph = derived.graph(spark, sf)
    return matching.representatives(_classes(graph), graph.copies, _spans(graph))


@query("select chrom, block, lhs, cls as rhs, count(*) as size from (select *, lag(cls) over (partition by chrom, copy order by block) as lhs from classes) where lhs is not null group by 1, 2, 3, 4", _BLOCKS)
def joined_classes(spark, sf):
    return _joined(spark, sf).drop("place")


def _joined(spark, sf):
    graph = derived.graph(spark, sf)
    return matching.joined_classes(_classes(graph), graph.copies, _spans(graph))


@query("select chrom, block, lhs, rhs, size, row_number() over (partition by chrom, block order by size desc, rhs desc, lhs desc) as place from (select chrom, block, lhs, cls as rhs, count(*) as size from (select *, lag(cls) over (partition by chrom, copy order by block) as lhs from classes) where lhs is not null group by 1, 2, 3, 4)", _BLOCKS)
def joined_class_order(spark, sf):
    return _joined(spark, sf)


@query("select chrom, min(node) as node, first_edge, arg_min(aln_pos, node) as aln_pos from (select a.*, (select count(*) from edges e where e.chrom = a.chrom and e.src < a.node) as first_edge from aligned a where is_bridge) group by chrom, first_edge", _ALIGNED)
def cut_candidates(spark, sf):
    graph = derived.graph(spark, sf)
    return segments.cut_candidates(graph.nodes, g.edge_counts(graph.nodes, graph.edges))


# Sets are told apart by sums of edge hashes; pairs of candidates are extended while their classes are fewer than the copies.
_DP = """
leaving as (select n.chrom, n.node, count(e.edge) as c from nodes n left join edges e on e.chrom = n.chrom and e.src = n.node group by 1, 2),
before as (select chrom, node, sum(c) over (partition by chrom order by node) - c as first_edge from leaving),
cand as materialized (select *, row_number() over (partition by chrom order by node) - 1 as k from (select a.chrom, min(a.node) as node, b.first_edge, arg_min(a.aln_pos, a.node) as aln_pos
  from aligned a join before b on b.chrom = a.chrom and b.node = a.node where a.is_bridge group by a.chrom, b.first_edge)),
run as (select chrom, copy, edge, sum(hash(edge)::hugeint) over (partition by chrom, copy order by edge) as s from (select distinct chrom, copy, edge from carried)),
places_ as (select c.chrom, c.k, p.copy, c.first_edge from cand c join copies p on p.chrom = c.chrom),
added as (select p.chrom, p.k, p.copy, coalesce(r.s, 0) as s from places_ p asof left join run r on r.chrom = p.chrom and r.copy = p.copy and p.first_edge > r.edge),
sums as materialized (select chrom, k, list(s order by copy) as s from added group by all),
spans as (select a.chrom, a.k as i, b.k as j, len(list_distinct(list_transform(range(1, 21), lambda m: b.s[m] - a.s[m]))) as c from sums a join sums b on b.chrom = a.chrom and b.k = a.k + 1 union all
  select x.chrom, x.i, b.k, len(list_distinct(list_transform(range(1, 21), lambda m: b.s[m] - a.s[m]))) from spans x join sums a on a.chrom = x.chrom and a.k = x.i join sums b on b.chrom = x.chrom and b.k = x.j + 1 where x.c < 20),
starts as (select chrom, j, c as h, min(i) as i from spans where c < 20 group by all),
choices as materialized (select s.chrom, s.j, list({'h': s.h, 'i': s.i} order by s.h) as o from starts s join cand a on a.chrom = s.chrom and a.k = s.i join cand b on b.chrom = s.chrom and b.k = s.j where b.aln_pos - a.aln_pos >= %d group by all),
best as (select chrom, 0::bigint as j, [0::bigint] as score, [-1::bigint] as prev from lens union all
  select b.chrom, c.k, list_append(b.score, least(20, coalesce(list_min(list_transform(o.o, lambda x: greatest(x.h, b.score[x.i + 1]))), 20))),
    list_append(b.prev, case when list_min(list_transform(o.o, lambda x: greatest(x.h, b.score[x.i + 1]))) < 20 then o.o[list_position(list_transform(o.o, lambda x: greatest(x.h, b.score[x.i + 1])), list_min(list_transform(o.o, lambda x: greatest(x.h, b.score[x.i + 1]))))].i else -1 end)
  from best b join cand c on c.chrom = b.chrom and c.k = b.j + 1 left join choices o on o.chrom = c.chrom and o.j = c.k),
ends as materialized (select chrom, max(j) as last, arg_max(score, j) as score, arg_max(prev, j) as prev from best group by 1),
back as (select chrom, last as k, score, prev from ends where last > 0 union all select chrom, prev[k + 1], score, prev from back where prev[k + 1] >= 0),
found as (select chrom, k, score[-1] as score from back union select chrom, 0, score[-1] from ends where last > 0)
select f.chrom, (row_number() over (partition by f.chrom order by f.k) - 1)::int as cut_idx, case when f.k = e.last then (select max(node) from nodes n where n.chrom = f.chrom) else c.node end as node, f.score, %d::bigint as min_distance
from found f join ends e on e.chrom = f.chrom join cand c on c.chrom = f.chrom and c.k = f.k"""


def _cuts_sql(distance: int) -> tuple[str, ...]:
    parts, select = (_DP % (distance, distance)).rsplit("\nselect", 1)
    return "select" + select, _ALIGNED.replace("ends as", "folded as").replace("from ends)", "from folded)"), parts


@query(*_cuts_sql(0))
def cut_positions(spark, sf):
    return derived.graph(spark, sf).cut_positions(0)


@query(*_cuts_sql(50))
def cut_positions_distance_50(spark, sf):
    return derived.graph(spark, sf).cut_positions(50)


def _fixed_cuts(graph) -> DataFrame:
    """Cuts at every BLOCK_BUBBLES-th bridge and the sink, as if loaded from a saved segmentation."""
    rows = graph.nodes.where("is_bridge")
    sink = graph.nodes.groupBy("chrom").agg(F.max("node").alias("node"))
    return rows.where(f"bubble % {BLOCK_BUBBLES} = 0").select("chrom", "node").unionByName(sink).distinct()


_FIXED_CUTS = f"cuts as (select chrom, node from marked where is_bridge and bubble % {BLOCK_BUBBLES} = 0 union select chrom, max(node) from nodes group by 1)"


@query("select chrom, block, founder, copy from assigned", _FIXED_CUTS, founder_sql.BLOCKS, founder_sql.assignments(FOUNDERS))
def founder_assignments(spark, sf):
    graph = derived.graph(spark, sf)
    return graph.match(_fixed_cuts(graph), FOUNDERS)


@query(founder_sql.ROWS_SELECT, _ALIGNED, _TAKEN, _PIECES, _FIXED_CUTS, founder_sql.BLOCKS, founder_sql.assignments(FOUNDERS), founder_sql.ROWS)
def founder_rows(spark, sf):
    graph = derived.graph(spark, sf)
    cuts = _fixed_cuts(graph)
    return _digest(graph.founder_rows(cuts, graph.match(cuts, FOUNDERS)), "chrom", "seq_no", "seq_id", "chunk_no")


def _optimal_rows_sql(distance: int, founders: int) -> tuple[str, ...]:
    select, aligned, parts = _cuts_sql(distance)
    return founder_sql.ROWS_SELECT, aligned, parts, f"cuts as ({select.replace('select f.chrom', 'select f.chrom as chrom', 1)})", _TAKEN, _PIECES, founder_sql.BLOCKS, founder_sql.assignments(founders), founder_sql.ROWS


@query(*_optimal_rows_sql(50, 2))
def founder_rows_optimal(spark, sf):
    graph = derived.graph(spark, sf)
    cuts = graph.cut_positions(50)
    return _digest(graph.founder_rows(cuts, graph.match(cuts, 2)), "chrom", "seq_no", "seq_id", "chunk_no")


@query("""select chrom, 0 as part, node, 0::bigint as ord, chr(9) || node || ' [shape = Mrecord, label = "' || node || ' | ' || ref_pos || ' | ' || aln_pos || '"];' as line from aligned
union all select chrom, 1, node - 1, 0, chr(9) || (node - 1) || ' -> ' || node || ' [label = "' || text || '", penwidth = 2.0];' from pieces
union all select chrom, 1, src, edge + 1, chr(9) || src || ' -> ' || dst || ' [label = "' || label || '"];' from edges""", _ALIGNED, _TAKEN, _PIECES)
def graphviz_lines(spark, sf):
    return derived.graph(spark, sf).graphviz()


@query("select chrom, vid as variant_idx, case when length(l) > 20 then left(l, 10) || '…' || right(l, 10) || ' (' || length(l) || ')' else l end as label from (select chrom, vid, string_agg(alt, '' order by i) || repeat(any_value(ref), 2) as l from (select a.*, r.ref from alts a join vr r using (vid)) group by 1, 2)")
def label_abbreviation(spark, sf):
    rows = derived.variants(spark, sf)
    label = F.concat(F.array_join(F.transform("alts", lambda a: a["text"]), ""), F.repeat("ref", F.lit(2)))
    return rows.withColumn("label", label).select("chrom", "variant_idx", abbreviated(F.col("label")).alias("label"))


# A region starts at the rank that its aligned start has among a copy's own characters: a running sum over the copy's pieces, found by an as-of join.
_REGIONS = """
ranked_parts as (select chrom, copy, aln, text, sum(length(text)) over (partition by chrom, copy order by aln, width) - length(text) as before from parts where width > 0),
bare as materialized (select chrom, copy, string_agg(text, '' order by aln) as t from ranked_parts group by 1, 2),
asked as (select a.chrom, c.copy, 'r' || v.vid as name, a.aln_pos as at from v join aligned a on a.chrom = v.chrom and a.ref_pos = v.pos join copies c on c.chrom = v.chrom),
placed as (select q.chrom, q.copy, q.name, p.before + least(q.at - p.aln, length(p.text)) as r0 from asked q asof join ranked_parts p on p.chrom = q.chrom and p.copy = q.copy and q.at >= p.aln)
"""


@query("select p.chrom, p.name, p.copy::int as copy, b.t[p.r0::bigint + 1 : p.r0::bigint + 20] as text from placed p join bare b using (chrom, copy)", _ALIGNED, _TAKEN, _PIECES, _REGIONS)
def region_extract(spark, sf):
    """Regions from all records, of all copies."""
    graph = derived.graph(spark, sf)
    bed = derived.variants(spark, sf).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 20).alias("end"), F.concat(F.lit("r"), F.col("variant_idx").cast("string")).alias("name"))
    msa = graph.copy_texts().withColumn("seq_id", F.col("copy").cast("int"))
    rows = regions.extract_regions(bed, graph.nodes, msa.join(graph.chunks.select("chrom", "chunk_no", "aln"), ["chrom", "chunk_no"]), bucket=1 << 10)
    return rows.select("chrom", "name", F.col("seq_id").alias("copy"), "text")


@query("select p.chrom, p.name, p.copy::int as copy, b.t[p.r0::bigint + 1 : p.r0::bigint + 20] as text from placed p join bare b using (chrom, copy)", _ALIGNED, _TAKEN, _PIECES, _REGIONS)
def region_extract_by_text(spark, sf):
    """The same regions, their starts found in the aligned reference's own text, as for alignments that come from files."""
    graph = derived.graph(spark, sf)
    bed = derived.variants(spark, sf).select("chrom", F.col("pos").alias("start"), (F.col("pos") + 20).alias("end"), F.concat(F.lit("r"), F.col("variant_idx").cast("string")).alias("name"))
    at = graph.chunks.select("chrom", F.col("chunk_no").cast("long"), "aln", "text")
    msa = graph.copy_texts().withColumn("seq_id", F.col("copy").cast("int")).withColumn("chunk_no", F.col("chunk_no").cast("long")).join(at.drop("text"), ["chrom", "chunk_no"])
    return regions.extract_by_text(bed, at, msa).select("chrom", "name", F.col("seq_id").alias("copy"), "text")
