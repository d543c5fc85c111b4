"""The variant graph: nodes, ALT edges, bridges, bubbles and aligned positions, as relational steps.

A node is a reference position where an edge starts or ends. REF edges join neighbouring nodes; ALT edges are
numbered by record and allele. The aligned position of a node is the longest path to it, which is local
to a bubble (a maximal stretch between nodes that no edge jumps over), plus the lengths of the bubbles before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import prefix_scan
from ..functions.storage import dealt, large, materialise

#: Positions of a bucket, and bubbles of a part, whose running values one window takes.
BUCKET = 1 << 14
BUBBLES = 1 << 12
LONG_BUBBLE = 2000


def handled_alts(variants: DataFrame) -> DataFrame:
    """(chrom, variant_idx, alt_idx, pos, tgt_pos, label) of plain and deleted alternatives."""
    rows = variants.select("chrom", "variant_idx", "pos", "ref", F.explode("alts").alias("a")).where(F.col("a.kind").isin("NONE", "DEL"))
    return rows.select("chrom", "variant_idx", F.col("a.idx").alias("alt_idx"), "pos", (F.col("pos") + F.length("ref")).alias("tgt_pos"), F.when(F.col("a.kind") == "DEL", "").otherwise(F.col("a.text")).alias("label"))


def reference_lengths(reference: DataFrame) -> DataFrame:
    return reference.groupBy("chrom").agg(F.max(F.col("start") + F.length("bases")).alias("ref_len"))


def build_nodes(variants: DataFrame, alts: DataFrame, lengths: DataFrame) -> DataFrame:
    """(chrom, node, ref_pos, ref_delta): every record position is a node, whatever its alternatives."""
    places = variants.select("chrom", F.col("pos").alias("ref_pos")).unionByName(alts.select("chrom", F.col("tgt_pos").alias("ref_pos")))
    places = places.unionByName(lengths.select("chrom", F.lit(0).cast("long").alias("ref_pos"))).unionByName(lengths.select("chrom", F.col("ref_len").alias("ref_pos")))
    specs = [("node", "count", F.lit(1)), ("before", "max", F.col("ref_pos"))]
    rows = prefix_scan(places.distinct(), ["chrom"], ["ref_pos"], F.expr(f"ref_pos div {BUCKET}"), specs, inclusive=False)
    return rows.select("chrom", "node", "ref_pos", (F.col("ref_pos") - F.coalesce("before", F.lit(0))).alias("ref_delta"))


def sites(variants: DataFrame) -> DataFrame:
    """(chrom, variant_idx, pos, tgt_pos, n, alts): one row a record, with its n handled alternatives (alt_idx, label) in order; records without any stay."""
    handled = F.filter("alts", lambda a: a["kind"].isin("NONE", "DEL"))
    alts = F.sort_array(F.transform(handled, lambda a: F.struct(a["idx"].alias("alt_idx"), F.when(a["kind"] == "DEL", "").otherwise(a["text"]).alias("label"))))
    return variants.select("chrom", "variant_idx", "pos", (F.col("pos") + F.length("ref")).alias("tgt_pos"), F.size(handled).cast("long").alias("n"), alts.alias("alts"))


def edge_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(chrom, node, n_edges, first_edge): how many edges leave a node, and how many leave nodes before it."""
    out = edges.groupBy("chrom", F.col("src").alias("node")).agg(F.count("*").alias("n_edges"))
    rows = nodes.select("chrom", "node").join(large(out), ["chrom", "node"], "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)).cast("long"))
    return prefix_scan(rows, ["chrom"], ["node"], F.expr("node div 65536"), [("first_edge", "sum", F.col("n_edges"))], inclusive=False)


def marked_sites(records: DataFrame, lengths: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Nodes and sites in one table: (chrom, bubble, node, ref_pos, ref_delta, is_bridge, site); a row is a node or a site.

    Records and the ends of their edges are dealt out once, by position. Node and edge numbers, bridges (nodes that no edge jumps over) and
    bubbles (of a node, the one that ends in it; of a site, the one that its edges lie in) are running values along the positions. ``site`` has variant_idx, src, src_pos,
    tgt_pos, first_edge and alts. Records are sorted by position, so edges are numbered by record and allele.
    """
    nothing = F.lit(None).cast(records.schema["alts"].dataType)
    none = F.lit(None).cast("long")
    edged = F.col("n") > 0
    at = lambda df, pos: df.select("chrom", F.lit(pos).cast("long").alias("pos") if isinstance(pos, int) else F.col(pos).cast("long").alias("pos"), none.alias("variant_idx"), none.alias("tgt_pos"), F.lit(0).cast("long").alias("n"), nothing.alias("alts"))
    rows = records.select("chrom", F.col("pos").cast("long"), F.col("variant_idx").cast("long"), F.when(edged, F.col("tgt_pos")).cast("long").alias("tgt_pos"), "n", "alts")
    rows = rows.unionByName(at(records.where(edged), "tgt_pos")).unionByName(at(lengths, 0)).unionByName(at(lengths, "ref_len"))
    by, order, part = ["chrom"], ["pos", "variant_idx"], "_part"
    rows = dealt(rows.withColumn(part, F.expr(f"pos div {BUCKET}")), "chrom", part, of=records if of is None else of)
    new = ~F.col("pos").eqNullSafe(F.lag("pos").over(Window.partitionBy("chrom", part).orderBy(*order)))
    rows = rows.withColumn("new", new.cast("long"))
    specs = [("nodes", "sum", F.col("new")), ("before", "max", F.col("pos")), ("far", "max", F.col("tgt_pos")), ("first_edge", "sum", F.col("n"))]
    rows = prefix_scan(rows, by, order, part, specs, inclusive=False)
    rows = rows.withColumn("bridge", ((F.col("new") == 1) & F.coalesce(F.col("far") <= F.col("pos"), F.lit(True))).cast("long"))
    rows = prefix_scan(rows, by, order, part, [("bridges", "sum", F.col("bridge"))], inclusive=False)
    node = F.col("nodes") + F.col("new") - 1
    site = F.struct("variant_idx", node.alias("src"), F.col("pos").alias("src_pos"), "tgt_pos", "first_edge", "alts")
    kept = lambda bubble, own, of: F.struct(bubble.alias("bubble"), *(v.alias(n) for n, v in own.items()), of.alias("site"))
    a_node = kept(F.col("bridges"), {"node": node, "ref_pos": F.col("pos"), "ref_delta": F.col("pos") - F.coalesce("before", F.lit(0)), "is_bridge": F.col("bridge") == 1}, F.lit(None).cast(rows.select(site).schema[0].dataType))
    a_site = kept(F.col("bridges") + F.col("bridge"), {"node": none, "ref_pos": none, "ref_delta": none, "is_bridge": F.lit(None).cast("boolean")}, site)
    both = F.concat(F.when(F.col("new") == 1, F.array(a_node)).otherwise(F.array()), F.when(F.col("n") > 0, F.array(a_site)).otherwise(F.array()))
    return rows.select("chrom", F.explode(both).alias("r")).select("chrom", "r.*")


def _fold(pdf_nodes, pdf_sites):
    """Values of the nodes of a bubble (the first for the node before it), and the number in the bubble of each site's target."""
    place = {n["ref_pos"]: i for i, n in enumerate(pdf_nodes, 1)}
    base = pdf_nodes[0]["node"] - 1
    into, ends, values = {}, [], [0]
    for x in pdf_sites:
        ends.append(place[x["tgt_pos"]])
        into.setdefault(ends[-1], []).append((x["src"] - base, max(len(a["label"]) for a in x["alts"])))
    for i, n in enumerate(pdf_nodes, 1):
        values.append(max([values[-1] + n["ref_delta"], *(values[s] + w for s, w in into.get(i, ()))]))
    return values, ends


def fold_bubbles(rows: DataFrame, of: DataFrame, long_bubble: int = LONG_BUBBLE) -> DataFrame:
    """(chrom, part, bubble, nodes, sites, values, ends, total, before), written once, from rows as ``marked_sites`` has them.

    A bubble's nodes and sites meet in one row. ``values`` are the longest paths from the node before the bubble to that node and each of
    its own, ``ends`` the number in the bubble of each site's target, ``before`` the sum of the bubbles before it in its part. The native fold copies its array at each step; bubbles of over
    ``long_bubble`` nodes are folded by rows. ``of`` is a table of known size that grows with the rows.
    """
    rows = dealt(rows.withColumn("part", F.expr(f"bubble div {BUBBLES}")), "chrom", "part", of=of)
    node = F.when(F.col("node").isNotNull(), F.struct("node", "ref_pos", "ref_delta", "is_bridge"))
    groups = rows.groupBy("chrom", "part", "bubble").agg(F.sort_array(F.collect_list(node)).alias("nodes"), F.sort_array(F.collect_list("site")).alias("sites"))
    groups = groups.withColumn("base", F.get("nodes", F.lit(0))["node"] - 1)
    width = lambda x: F.array_max(F.transform(x["alts"], lambda a: F.length(a["label"]).cast("long")))
    steps = F.concat(
        F.transform("nodes", lambda n: F.struct(n["ref_pos"].alias("at"), F.lit(1).alias("kind"), n["ref_delta"].alias("d"), F.lit(0).alias("s"))),
        F.transform("sites", lambda x: F.struct(x["tgt_pos"].alias("at"), F.lit(0).alias("kind"), width(x).alias("d"), (x["src"] - F.col("base")).cast("int").alias("s"))),
    )
    zero = F.lit(0).cast("long")
    start = F.struct(F.array(zero).alias("v"), zero.alias("best"))
    step = lambda a, x: F.when(x["kind"] == 1, F.struct(F.concat(a["v"], F.array(F.greatest(F.element_at(a["v"], -1) + x["d"], a["best"]))).alias("v"), zero.alias("best"))).otherwise(F.struct(a["v"].alias("v"), F.greatest(a["best"], F.get(a["v"], x["s"]) + x["d"]).alias("best")))
    short = F.size("nodes") <= long_bubble
    ends = F.transform("sites", lambda x: F.array_position(F.col("nodes.ref_pos"), x["tgt_pos"]).cast("int"))
    groups = groups.select("chrom", "part", "bubble", "nodes", "sites", F.when(short, F.aggregate(F.sort_array(steps), start, step, lambda a: a["v"])).alias("values"), F.when(short, ends).alias("ends"))
    total = F.element_at("values", -1)
    before = F.coalesce(F.sum("total").over(Window.partitionBy("chrom", "part").orderBy("bubble").rowsBetween(Window.unboundedPreceding, -1)), zero)
    found = materialise(groups.withColumn("total", total).withColumn("before", before), "bubbles")
    if not found.where("total is null").limit(1).count():
        return found

    def by_rows(batches):
        for pdf in batches:
            folded = [_fold(n, s) for n, s in zip(pdf["nodes"], pdf["sites"], strict=True)]
            yield pdf[["chrom", "part", "bubble"]].assign(values=[v for v, _ in folded], ends=[e for _, e in folded])

    kind = found.schema["chrom"].dataType.simpleString()
    keys = ["chrom", "part", "bubble"]
    long = found.where("total is null").select(*keys, "nodes", "sites").mapInPandas(by_rows, f"chrom {kind}, part long, bubble long, values array<bigint>, ends array<int>")
    long = found.where("total is null").drop("values", "ends").join(large(long), keys)
    return materialise(found.where("total is not null").unionByName(long).withColumn("total", total).withColumn("before", before), "bubbles")


def bubble_offsets(folded: DataFrame) -> DataFrame:
    """(chrom, part, offset): the aligned position at which the bubbles of each part begin; one row for ``BUBBLES`` bubbles."""
    totals = folded.groupBy("chrom", "part").agg(F.sum("total").alias("total"))
    before = F.sum("total").over(Window.partitionBy("chrom").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("chrom", "part", F.coalesce(before, F.lit(0).cast("long")).alias("offset"))


def nodes_of(folded: DataFrame, offsets: DataFrame) -> DataFrame:
    """(chrom, node, ref_pos, ref_delta, is_bridge, bubble, aln_pos) of the nodes in their bubbles."""
    rows = folded.select("chrom", "part", "bubble", F.col("before"), "values", F.posexplode("nodes").alias("i", "n")).join(offsets, ["chrom", "part"])
    return rows.select("chrom", "n.node", "n.ref_pos", "n.ref_delta", "n.is_bridge", "bubble", (F.col("offset") + F.col("before") + F.get("values", F.col("i") + 1)).alias("aln_pos"))


def sites_of(folded: DataFrame) -> DataFrame:
    """(chrom, variant_idx, src, dst, src_pos, tgt_pos, first_edge, bubble, alts) of the sites in their bubbles."""
    rows = folded.select("chrom", "bubble", (F.get("nodes", F.lit(0))["node"] - 1).alias("base"), "ends", F.posexplode("sites").alias("i", "s"))
    dst = F.col("base") + F.get("ends", F.col("i"))
    return rows.select("chrom", "s.variant_idx", "s.src", dst.alias("dst"), "s.src_pos", "s.tgt_pos", "s.first_edge", "bubble", "s.alts")


def edges_of(sites: DataFrame) -> DataFrame:
    """(chrom, edge, src, dst, src_pos, tgt_pos, label, variant_idx, alt_idx, bubble) of the ALT edges of the sites."""
    rows = sites.select("*", F.posexplode("alts").alias("i", "a"))
    return rows.select("chrom", (F.col("first_edge") + F.col("i")).alias("edge"), "src", "dst", "src_pos", "tgt_pos", "a.label", "variant_idx", "a.alt_idx", "bubble")


def align_nodes(marked: DataFrame, edges: DataFrame, long_bubble: int = LONG_BUBBLE) -> DataFrame:
    """``marked`` nodes with aln_pos, anew from the edges."""
    nodes = marked.select("chrom", "bubble", "node", "ref_pos", "ref_delta", "is_bridge")
    site = F.struct("variant_idx", "src", "src_pos", "tgt_pos", F.col("edge").alias("first_edge"), F.array(F.struct("alt_idx", "label")).alias("alts"))
    folded = fold_bubbles(nodes.unionByName(edges.select("chrom", "bubble", site.alias("site")), allowMissingColumns=True), edges, long_bubble)
    return nodes_of(folded, bubble_offsets(folded))


def ref_edges(nodes: DataFrame) -> DataFrame:
    """(chrom, src, dst, src_pos, tgt_pos) of the implicit edges between neighbouring nodes."""
    rows = nodes.where("node > 0")
    return rows.select("chrom", (F.col("node") - 1).alias("src"), F.col("node").alias("dst"), (F.col("ref_pos") - F.col("ref_delta")).alias("src_pos"), F.col("ref_pos").alias("tgt_pos"))


def reference_slices(intervals: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """``intervals`` (chrom, id, lo, hi) with text: an equi-join on chunk numbers, not a range join."""
    spread = intervals.where("hi > lo").withColumn("chunk_no", F.explode(F.sequence(F.expr(f"lo div {chunk}"), F.expr(f"(hi - 1) div {chunk}"))))
    parts = spread.join(reference.select("chrom", F.col("chunk_no").cast("long"), "start", "bases"), ["chrom", "chunk_no"])
    lo, hi = F.greatest("lo", "start"), F.least(F.col("hi"), F.col("start") + F.length("bases"))
    parts = parts.select("chrom", "id", "chunk_no", F.col("bases").substr((lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("t"))
    text = parts.groupBy("chrom", "id").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "t"))).alias("p")).select("chrom", "id", F.array_join(F.col("p.t"), "").alias("text"))
    return intervals.join(large(text), ["chrom", "id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def ref_mismatches(variants: DataFrame, reference: DataFrame, chunk: int) -> DataFrame:
    """Records whose REF differs from the reference (case matters; the slice is clipped at the end)."""
    want = variants.select("chrom", F.col("variant_idx").alias("id"), F.col("pos").alias("lo"), (F.col("pos") + F.length("ref")).alias("hi"), "ref")
    return reference_slices(want, reference, chunk).where("ref <> text").select("chrom", F.col("id").alias("variant_idx"), F.col("lo").alias("pos"), "ref", F.col("text").alias("expected"))


def unsorted_records(variants: DataFrame) -> DataFrame:
    """Records that come after one with a larger position."""
    rows = prefix_scan(variants.select("chrom", "variant_idx", "pos"), ["chrom"], ["variant_idx"], F.expr("variant_idx div 65536"), [("seen", "max", F.col("pos"))], inclusive=False)
    return rows.where("seen > pos")
