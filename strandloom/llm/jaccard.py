"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are the hashes of its distinct word shingles. Two sets link when
100 * intersection >= percent * union.

1. Rows with equal sets form a class (pre-aggregated by a 128-bit set hash), and one owner row speaks
   for it; copies are never paired.
2. Token counts cover all classes. Each text group sends its tokens packed by hash bucket, so a bucket of bounded size is counted in one
   task with numpy; tokens that only one set holds end there. Tokens that recur inside text groups often enough to be a
   millionth of all tokens are counted first, by (group, token), and broadcast: there can't be more than a million of them,
   and no bucket is as large as a token is popular. Tokens are ordered by count, so those of one set only come first.
3. With p = n - ceil(t * n) + 1, linked sets share a token among their first p. A set with p tokens of its own
   links with nobody and ends here. Tokens that at most ``FREQUENT`` sets hold are rare and indexed singly. If all that two sets share
   among their first p is frequent, then all their rare tokens lie inside the prefix, and they share k frequent tokens among
   the first p + k - 1. Frequent tokens are dealt into m = k - 1 classes by hash, so two of the shared ones fall into one
   class: the index holds all pairs of a set's frequent prefix tokens inside each class. m is about p / 2, a power of
   two, fixed by the smaller set's size; a set whose partner may have another m is indexed under both. Keys stay linear in the
   set's size.
4. Of keys with the same list of sets one is kept. The sets of a key are compared in cells of two blocks, each of at most about
   ``BLOCK`` sets and ``BLOCK_BYTES``, so a popular key is spread over many tasks. What is compared are parity sketches of the tokens that
   come back: one bit a hash slot, flipped by each token. A token in one set alone flips one bit at most, and tokens of one set only are
   counted exactly, so more differences than the measure allows rule a pair out for certain. A cell returns the
   components of the pairs that are left as stars, not the pairs.
5. Components over all cells are candidates: linked sets are always in the same one. Each candidate is compared again in
   such cells, now with the tokens themselves, closest sketches first, leaving out pairs that the cell has already joined. The
   components of these links are the result, exact up to collisions of token (48 bits and more) and set hashes (64 bits).

Defined cases: null text, or text without words, has an empty set and is linked with nothing; fewer words
than a shingle form one token of the whole sequence; repeated rows are in one class; null ids are members
but never name a component unless all ids of it are null; an empty table gives no rows; other columns are not read
(``keep_one`` passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import mix, powers, slice_hashes, word_bounds
from .common import bitmap, discard, in_bitmap, join_texts_lower, materialise, packed, runs_of, text_groups
from .components import components

FREQUENT = 40
#: A token is counted ahead from this many (group, set) hits on, and from a millionth of all tokens on.
AHEAD = 4096
GROUP_SHARE = 0.01
BUCKET_TOKENS = 1 << 19
#: Text whose tokens are packed together: larger groups make fewer and longer rows.
PACK_BYTES = 2 << 20
#: Widest bitmap of owner rows. A false hit only costs work: sets are told apart again where tokens are counted.
OWNER_BITS = 1 << 28
#: Sets in a block of an index key (compared by sketch) and of a candidate component (compared by tokens).
BLOCK = 512
LINK_BLOCK = 128
BLOCK_BYTES = 4 << 20
SALTS = 8
SHORT = np.uint64(0xA24BAED4963EE407)
SPREAD = np.uint64(0x9FB21C651E98DF25)
LOW48 = np.uint64((1 << 48) - 1)


# ---------------------------------------------------------------- sets


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Ascending distinct uint64 shingle hashes of each text."""
    data, ends = join_texts_lower(texts)
    start, end = word_bounds(data)
    words = mix(slice_hashes(data, start, end))
    upto = np.searchsorted(start, ends)
    n = len(words)
    power, inverse = powers(n + 1, 0)
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(words * power[:n], out=run[1:])
        shingles = mix((run[k:] - run[: n + 1 - k]) * inverse[: n + 1 - k]) if n >= k else np.zeros(0, np.uint64)
        out, lo = [], 0
        for hi in upto.tolist():
            if hi - lo >= k:
                out.append(np.unique(shingles[lo : hi - k + 1]))
            elif hi > lo:
                out.append(mix((run[hi : hi + 1] - run[lo : lo + 1]) * inverse[lo : lo + 1] ^ (SHORT + np.uint64(hi - lo))))
            else:
                out.append(np.zeros(0, np.uint64))
            lo = hi
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, and two 64-bit hashes of each set); an empty set has zeros."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
    live = n > 0
    if live.any():
        flat = np.concatenate(sets)
        at = (np.cumsum(n) - n)[live]
        with np.errstate(over="ignore"):
            a[live] = mix(np.add.reduceat(flat, at) + n[live].astype(np.uint64))
            b[live] = mix(np.add.reduceat(mix(flat ^ SHORT), at))
    return n, a.view(np.int64), b.view(np.int64)


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def class_count(n: int, percent: int) -> int:
    """m of a pair whose smaller set has n tokens: a power of two, about half the prefix."""
    return 1 << max(0, (prefix_length(n, percent) // 2).bit_length() - 1)


def index_keys(tokens: np.ndarray, counts: np.ndarray, n: int, percent: int, frequent: int) -> np.ndarray:
    """Keys of a set of n tokens; ``tokens`` are those that other sets hold too, by ascending count."""
    own_only = n - len(tokens)
    p = prefix_length(n, percent)
    cut = int(np.searchsorted(counts, frequent, side="right"))
    rare, often = tokens[:cut], tokens[cut:]
    keys = [rare[: max(0, p - own_only)]]
    before = own_only + len(rare)
    if before < p:
        least = -(-percent * n // 100)
        for m in {class_count(n, percent), class_count(min(n, least), percent)}:
            own = often[: p + m - before]
            group = own & np.uint64(m - 1)
            for g in np.unique(group):
                mine = np.sort(own[group == g])
                i, j = np.triu_indices(len(mine), 1)
                with np.errstate(over="ignore"):
                    keys.append(mix(mine[i] * SPREAD + mine[j] + np.uint64(m)))
    return np.unique(np.concatenate(keys))


def parity_sketch(tokens: np.ndarray) -> bytes:
    """A power of two of bits, at least four a token; each token flips one."""
    bits = 1 << max(6, (4 * len(tokens) - 1).bit_length())
    flips = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def sketch_distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Differing bits of one sketch and each row of sketches; the longer kind is folded to the shorter."""
    w, v = len(one), many.shape[1]
    if w > v:
        one = np.bitwise_xor.reduce(one.reshape(-1, v), axis=0)
    elif v > w:
        many = np.bitwise_xor.reduce(many.reshape(len(many), -1, w), axis=1)
    return np.bitwise_count(one ^ many).sum(axis=1, dtype=np.int64)


# ---------------------------------------------------------------- passes over the texts


def _member_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each row's set hash; a group's first row also tells which tokens recur in the group."""
    ahead = pa.list_(pa.struct([("t", pa.int64()), ("c", pa.int64())]))
    for part, texts in text_groups(batches):
        sets = shingle_sets(texts, k)
        n, s1, s2 = signatures(sets)
        distinct = [sets[i] for i in np.unique(s1, return_index=True)[1]]
        t, c = np.unique(np.concatenate(distinct), return_counts=True)
        often = c >= max(4, GROUP_SHARE * len(distinct))
        told = [[{"t": x, "c": y} for x, y in zip(t[often].view(np.int64).tolist(), c[often].tolist(), strict=True)]] + [None] * (len(sets) - 1)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(n), pa.array(s1), pa.array(s2), pa.array(told, ahead)], names=["doc_id", "key", "n", "s1", "s2", "ahead"])


PACKED = "bucket int, ahead boolean, nodes binary, sizes binary, counts binary, tokens binary"


def _token_rows(batches: Iterator[pa.RecordBatch], k: int, owners: np.ndarray, ahead: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """The tokens of owner rows, packed by bucket: nodes, set sizes, tokens of each node, and the tokens' low 48 bits."""
    for part, texts in text_groups(batches, limit=PACK_BYTES):
        sets = shingle_sets(texts, k)
        n, s1, _ = signatures(sets)
        own = np.flatnonzero(in_bitmap(owners, s1 ^ part.column("key").to_numpy()) & (n > 0))
        own = own[np.unique(s1[own], return_index=True)[1]]
        if not len(own):
            continue
        flat = np.concatenate([sets[i] for i in own])
        owner = np.repeat(np.arange(len(own)), n[own])
        at = np.minimum(np.searchsorted(ahead, flat), max(0, len(ahead) - 1))
        known = ahead[at] == flat if len(ahead) else np.zeros(len(flat), bool)
        rows: list[tuple] = []
        for which in (False, True):
            pick = np.flatnonzero(known == which)
            if not len(pick):
                continue
            t, o = flat[pick], owner[pick]
            # tokens counted ahead need no count: they are spread by their set
            b = ((t >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64) if not which else s1[own][o] % buckets
            order = np.argsort(b, kind="stable")
            t, o, b = t[order], o[order], b[order]
            run = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (o[1:] != o[:-1])]))
            size = np.diff(np.append(run, len(b)))
            raw = t.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 if which else 6]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(b[run])) + 1, [len(run)]])
            for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                who = own[o[run[lo:hi]]]
                end = run[hi] if hi < len(run) else len(b)
                rows.append((int(b[run[lo]]), which, s1[who].tobytes(), n[who].astype(np.uint32).tobytes(), size[lo:hi].astype(np.uint32).tobytes(), np.ascontiguousarray(raw[run[lo] : end]).tobytes()))
        kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 4)
        for lo in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[lo : lo + 64]], t) for c, t in enumerate(kinds)], names=["bucket", "ahead", "nodes", "sizes", "counts", "tokens"])


REPEATED = "node long, n long, token long, count long"


def _unpack(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """(node, set size, token) of every token of a packed row."""
    nodes, sizes, counts = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("nodes", np.int64), ("sizes", np.uint32), ("counts", np.uint32)))
    width = 8 if batch.column("ahead")[i].as_py() else 6
    raw = np.frombuffer(batch.column("tokens")[i].as_py(), np.uint8).reshape(-1, width)
    tokens = np.zeros((len(raw), 8), np.uint8)
    tokens[:, :width] = raw
    return np.repeat(nodes, counts), np.repeat(sizes.astype(np.int64), counts), tokens.view("<u8")[:, 0].astype(np.uint64)


def _repeated(bucket: int, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Tokens of one bucket that at least two sets hold, with how many do."""
    node, n, token = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(token, kind="stable")
    token = token[order]
    new = np.concatenate([[True], token[1:] != token[:-1]])
    some = np.diff(np.append(np.flatnonzero(new), len(token)))
    keep = np.repeat(some > 1, some)
    order, token = order[keep], token[keep]
    inside = np.lexsort((node[order], token))
    order, token = order[inside], token[inside]
    node, n = node[order], n[order]
    # a set that came twice (a false hit among the owners) counts once
    first = np.ones(len(token), bool)
    first[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    node, n, token = node[first], n[first], token[first]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    some = np.diff(np.append(start, len(token)))
    count = np.repeat(some, some)
    keep = count > 1
    with np.errstate(over="ignore"):
        named = mix(token[keep] ^ (np.uint64(bucket + 1) * SPREAD))
    return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(n[keep]), pa.array(named.view(np.int64)), pa.array(count[keep])], names=["node", "n", "token", "count"])


def _count_rows(batches: Iterator[pa.RecordBatch], ahead: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Packed rows sorted by bucket -> ``REPEATED``."""
    held: list[tuple[np.ndarray, ...]] = []
    now = None
    for batch in batches:
        for i, (b, known) in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("ahead").to_pylist(), strict=True)):
            if known:
                node, n, token = _unpack(batch, i)
                count = ahead[1][np.searchsorted(ahead[0], token)]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(mix(token).view(np.int64)), pa.array(count)], names=["node", "n", "token", "count"])
                continue
            if b != now and held:
                yield _repeated(now, held)
                held = []
            now = b
            held.append(_unpack(batch, i))
    if held:
        yield _repeated(now, held)


NODE = "node long, n long, own long, tokens binary, sketch binary, keys array<long>"


def _node_rows(batches: Iterator[pa.RecordBatch], percent: int, frequent: int) -> Iterator[pa.RecordBatch]:
    """``REPEATED`` rows sorted by (node, count, token) -> sets that may link, with tokens, sketch and index keys."""
    for group in runs_of(batches, "node"):
        node, n, token, count = (group.column(c).to_numpy() for c in ("node", "n", "token", "count"))
        start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        end = np.append(start[1:], len(node))
        # a set whose token counted ahead was sent by two rows holds it once
        live = np.flatnonzero(n[start] - (end - start) < prefix_length(n[start], percent))
        rows = []
        for i in live.tolist():
            t, c = token[start[i] : end[i]].view(np.uint64), count[start[i] : end[i]]
            fresh = np.ones(len(t), bool)
            fresh[1:] = t[1:] != t[:-1]
            t, c, size = t[fresh], c[fresh], int(n[start[i]])
            if size - len(t) >= prefix_length(size, percent):
                continue
            keys = index_keys(t, c, size, percent, frequent)
            if len(keys):
                rows.append((int(node[start[i]]), size, size - len(t), np.sort(t).tobytes(), parity_sketch(t), keys.view(np.int64)))
        for lo in range(0, len(rows), 256):
            some = rows[lo : lo + 256]
            cuts = pa.array(np.concatenate([[0], np.cumsum([len(r[5]) for r in some])]), pa.int32())
            cols = [pa.array([r[c] for r in some], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([r[5] for r in some])))], names=["node", "n", "own", "tokens", "sketch", "keys"])


# ---------------------------------------------------------------- cells


def merge(label: np.ndarray, found: np.ndarray) -> None:
    """Give all components in ``found`` (labels) the smallest of them."""
    if len(found) > 1:
        label[np.isin(label, found)] = found.min()


def allowed(n, m, percent: int):
    """Differences up to which sets of these sizes link: 100 * both >= percent * (n + m - both), n + m - 2 * both = differences."""
    return (100 - percent) * (n + m) // (100 + percent)


def close_pairs(block: np.ndarray, n: np.ndarray, own: np.ndarray, sketches: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, others j > i, differences at least) of the pairs of a cell that sketches and sizes can't rule out; pairs are of
    different blocks, unless the cell has only one."""
    width = np.array([len(s) for s in sketches])
    mixed = block.min() != block.max()
    where = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    table = {w: np.stack([sketches[j] for j in at]) for w, at in where.items()}
    for i in range(len(sketches) - 1):
        js, ds = [], []
        for w, at in where.items():
            lo = int(np.searchsorted(at, i + 1))
            later = at[lo:]
            fits = np.minimum(n[later], n[i]) * 100 >= np.maximum(n[later], n[i]) * percent
            if mixed:
                fits &= block[later] != block[i]
            if not fits.any():
                continue
            later = later[fits]
            d = sketch_distances(sketches[i], table[w][lo:][fits]) + own[i] + own[later]
            ok = d <= allowed(n[i], n[later], percent)
            js.append(later[ok])
            ds.append(d[ok])
        if js:
            j, d = np.concatenate(js), np.concatenate(ds)
            if len(j):
                yield i, j, d


def _stars(node: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): each node that isn't the first of its component, and that first one; labels are places of first nodes."""
    moved = label != np.arange(len(label))
    return node[moved], node[label[moved]]


def _cell_columns(cell: pa.RecordBatch) -> tuple:
    cell = cell.take(pa.array(np.unique(cell.column("node").to_numpy(), return_index=True)[1]))
    node, block, n, own = (cell.column(c).to_numpy() for c in ("node", "block", "n", "own"))
    return cell, node, block, n, own, [np.frombuffer(s, np.uint64) for s in cell.column("sketch").to_pylist()]


def _candidate_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Cells of index keys -> stars (u, v) of the components of pairs that sketches can't rule out."""
    us, vs, many = [], [], 0
    for cell in _cells(batches):
        _, node, block, n, own, sketches = _cell_columns(cell)
        label = np.arange(len(node))
        for i, j, _ in close_pairs(block, n, own, sketches, percent):
            merge(label, np.unique(np.append(label[j], label[i])))
        u, v = _stars(node, label)
        us.append(u)
        vs.append(v)
        many += len(u)
        if many > 10_000:
            yield _edges(us, vs)
            us, vs, many = [], [], 0
    if many:
        yield _edges(us, vs)


def _link_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Cells of candidate components -> stars (u, v) of the components of links."""
    for cell in _cells(batches):
        cell, node, block, n, own, sketches = _cell_columns(cell)
        tokens = [np.frombuffer(t, np.uint64) for t in cell.column("tokens").to_pylist()]
        near = list(close_pairs(block, n, own, sketches, percent))
        if not near:
            continue
        i = np.repeat([x for x, _, _ in near], [len(j) for _, j, _ in near])
        j = np.concatenate([j for _, j, _ in near])
        order = np.argsort(np.concatenate([d for _, _, d in near]), kind="stable")
        label = np.arange(len(node))
        for lo in range(0, len(order), 4096):
            some = order[lo : lo + 4096]
            for x, y in zip(i[some].tolist(), j[some].tolist(), strict=True):
                if label[x] == label[y]:
                    continue
                both = len(np.intersect1d(tokens[x], tokens[y], assume_unique=True))
                if 100 * both >= percent * (int(n[x]) + int(n[y]) - both):
                    merge(label, np.array([label[x], label[y]]))
        u, v = _stars(node, label)
        if len(u):
            yield _edges([u], [v])


def _edges(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell -> one batch a cell."""
    for group in runs_of(batches, "cell"):
        cell = group.column("cell").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if hi - lo > 1:
                yield group.slice(lo, hi - lo)


def in_cells(rows: DataFrame, group: str, blocks: str) -> DataFrame:
    """Rows in every cell of two blocks that theirs is part of, sorted by cell; a group of one block has one cell."""
    block = F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    # (b, b) is a cell of its own; for (a, b) with a < b the rows of both blocks come together
    cell = F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other"))
    return rows.withColumn("cell", cell).drop(group, blocks, "other").repartition("cell").sortWithinPartitions("cell")


def salted_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """An equi-join whose left rows of one key go to ``SALTS`` places; ``right`` has each key once."""
    left = left.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return left.join(right, [on, "salt"], how).drop("salt")


# ---------------------------------------------------------------- tables


def link_documents(docs: DataFrame, *, shingle: int = 4, percent: int = 85, frequent: int = FREQUENT, block: int = BLOCK, link_block: int = LINK_BLOCK, ahead_from: int = AHEAD) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, group) of every row; ``key`` hashes id and text.

    ``group`` is the component's own number (null for empty sets), whatever the ids are.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    texts = rows.select("key", "text").where("text is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    members = materialise(rows.mapInArrow(lambda it: _member_rows(it, shingle), f"doc_id {kind}, key long, n long, s1 long, s2 long, ahead array<struct<t:long,c:long>>"), "members")
    classes = materialise(members.where("n > 0").groupBy("s1", "s2").agg(F.min("key").alias("owner"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n")), "classes")
    nodes = _nodes(spark, texts, members, classes, shingle, percent, frequent, ahead_from)

    index = nodes.select(F.explode("keys").alias("key"), "node", F.length("sketch").alias("size"))
    lists = index.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g"), F.sum("size").alias("size")).where("c > 1")
    blocks = lambda most: F.ceil(F.greatest(F.col("c") / most, F.col("size") / BLOCK_BYTES)).cast("int").alias("blocks")
    kept = lists.groupBy("c", "h", "g").agg(F.min("key").alias("key"), F.first("size").alias("size")).select("key", blocks(block))
    found = salted_join(index.select("key", "node"), kept, "key").join(nodes.select("node", "n", "own", "sketch"), "node")
    near = in_cells(found, "key", "blocks").mapInArrow(lambda it: _candidate_rows(it, percent), "u long, v long")
    candidates = components(near)

    # only candidates of several blocks need their size looked up
    held = candidates.join(nodes.select("node", "n", "own", "sketch", "tokens"), "node")
    large = held.groupBy("component").agg(F.count("*").alias("c"), F.sum(F.length("tokens")).alias("size")).select("component", blocks(link_block)).where("blocks > 1")
    held = salted_join(held, large, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    links = in_cells(held, "component", "blocks").mapInArrow(lambda it: _link_rows(it, percent), "u long, v long")
    comp = components(links)
    discard(nodes)
    discard(candidates)

    linked = classes.join(comp, F.col("s1") == F.col("node")).select("s1", "s2", "node", "component", "least")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = salted_join(linked.drop("least"), least, "component").drop("node")
    named = classes.join(linked, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("component", "s1").alias("group"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    out = _named_members(members, classes, named)
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def _nodes(spark, texts: DataFrame, members: DataFrame, classes: DataFrame, shingle: int, percent: int, frequent: int, ahead_from: int) -> DataFrame:
    """The sets that may link with another, as ``NODE``."""
    about = classes.agg(F.count("*").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    least = max(ahead_from, about["n"] // 1_000_000)
    counted = members.select(F.explode("ahead").alias("a")).groupBy("a.t").agg(F.sum("a.c").alias("c")).where(F.col("c") >= least).toArrow()  # at most a million rows
    token, count = counted["t"].to_numpy().view(np.uint64), counted["c"].to_numpy().astype(np.int64)
    order = np.argsort(token)
    owners = bitmap(classes.select(F.expr("s1 ^ owner").alias("h")), "h", min(OWNER_BITS, 1 << max(16, (32 * about["c"]).bit_length())))
    buckets = min(1 << 24, max(64, about["n"] // BUCKET_TOKENS))
    shared = spark.sparkContext.broadcast((owners, token[order], count[order]))
    sent = texts.mapInArrow(lambda it: _token_rows(it, shingle, shared.value[0], shared.value[1], buckets), PACKED)
    repeated = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _count_rows(it, shared.value[1:]), REPEATED)
    ordered = repeated.repartition("node").sortWithinPartitions("node", "count", "token")
    return materialise(ordered.mapInArrow(lambda it: _node_rows(it, percent, frequent), NODE), "nodes")


def _named_members(members: DataFrame, classes: DataFrame, named: DataFrame) -> DataFrame:
    """Members with what their class has; classes of over a thousandth of all rows (so at most 1,000) are spread over ``SALTS`` x 8 places."""
    spark = members.sparkSession
    rows = classes.agg(F.sum("copies").alias("n")).first()["n"] or 0
    large = [r["s1"] for r in classes.where(F.col("copies") > max(1000, rows // 1000)).select("s1").distinct().collect()]
    salts = F.lit(SALTS * 8).cast("long")
    spread = spark.createDataFrame([(x, True) for x in large], "s1 long, spread boolean")
    part = F.when(F.col("spread"), F.pmod(F.monotonically_increasing_id(), salts)).otherwise(F.lit(0).cast("long"))
    left = members.drop("ahead").join(F.broadcast(spread), "s1", "left").withColumn("salt", part).drop("spread")
    last = F.when(F.col("spread"), salts - 1).otherwise(F.lit(0).cast("long"))
    right = named.join(F.broadcast(spread), "s1", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("spread")
    return left.join(right, ["s1", "s2", "salt"], "left").drop("salt")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One row of each component: that with the smallest id (null ids last; of rows equal in id and text, any one).

    Rows with empty sets all stay. Copies are merged before the shuffle, so a row repeated many times is no hot group.
    """
    linked = link_documents(docs.select("doc_id", "text"), **how)
    best = linked.where("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("m")).select("m.key")
    filled = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    rows = docs.select(packed(docs), F.xxhash64("doc_id", "text").alias("key"), filled.alias("filled"))
    one = rows.where("filled").groupBy("key").agg(F.first("row").alias("row")).join(best, "key").select("row.*")
    return one.unionByName(rows.where("not filled").select("row.*"))
