"""Operator 2: n-gram Jaccard join with prefix trees.

1. Texts become sets of 64-bit shingle hashes; equal sets are one class.
2. All sets follow one global order, rarest shingle first.  Document counts are
   exact: chunks of documents post their shingles, packed, to hash buckets; a
   shingle that several documents of a chunk have is posted once with its count,
   so that frequent ones load no bucket.  Buckets answer each chunk with the
   counts of the shingles that more than one document has.
3. Two sets that reach the threshold share a shingle among their first
   ``n - ceil(t n) + 1``.  Classes meet on these; meetings larger than a tile are
   dealt over pairs of blocks.  Pairs whose lengths, positions and parity
   signatures (a lower bound of the symmetric difference) allow the threshold
   connect their classes into neighbourhoods; large meetings give a spanning
   forest, not their pairs.
4. The set of each class in a neighbourhood is sent once to a block of bounded
   size.  A block is a prefix tree: its sets follow one order, common beginnings
   are stored once, and one traversal holds all probes of the block against it,
   sharing their partial overlaps and leaving a subtree for each probe that the
   remaining lengths rule out.  Neighbourhoods larger than a block are held
   against each other block by block.  What reaches the leaves is exact.

All links between different texts are found; none is written as a pair.  The
work within one neighbourhood grows with the square of its different texts.

Null and empty texts have no set and are linked with nothing; repeated rows and
rows that repeat a doc_id are linked by their texts, also over rows without a
doc_id; a null doc_id never is a component's id unless all of the component are
null.  Other columns are not read.  Empty tables give none.  Hashes have 64 bits:
with n distinct shingles a chance collision of any two has a probability of
about n^2 / 2^65.  A lost task must find the same rows in the same order again,
as it does in files.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.llm.common import ByteWords, array_slices, arrow_batches, stored, table, tidied, whole_groups
from strataflow.llm.components import components

WIDTH, PERCENT = 4, 85
#: Shingles and documents of a chunk, and bytes of text of a bucket.
CHUNK, CHUNK_DOCS, BUCKET_BYTES = 500_000, 60_000, 6_000_000
#: Bytes of a shingle in a bucket, besides the bits that name the bucket.
KEY_BYTES = 5
SEVERAL = 0xFFFF
#: Classes of a block of a meeting; meetings up to SMALL give pairs.
MEETING, SMALL = 2048, 16
#: Sets and elements of a block of a neighbourhood, and cells of the table that says which probe has which element.
BLOCK_SETS, BLOCK_ELEMENTS, CELLS = 512, 400_000, 16_000_000
#: Bytes of an Arrow batch of packed rows or sets.
BATCH_BYTES = 4_000_000
#: Ids (16 bytes each) that are sent to all tasks to find texts; more are joined by a shuffle.
MOST_BROADCAST = 300_000
_P = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(8)]


def shingle_sets(texts, width: int):
    """Sorted distinct shingle hashes of each text of a large binary array."""
    w = ByteWords(texts)
    h, first = w.hash, w.first
    n = max(0, len(h) - width + 1)
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for k in range(1, width):
            s = s * _P[1] + h[k : n + k]
        s ^= s >> np.uint64(32)
        s *= _P[3]
        s ^= s >> np.uint64(29)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield np.unique(s[a : b - width + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for x in h[a:b]:
                    whole = (whole ^ x) * _P[2] + x
                yield np.array([whole])
            else:
                yield np.zeros(0, np.uint64)


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def signature(shingles: np.ndarray) -> np.ndarray:
    """256 parity bits: two sets differ in at least as many elements as their signatures in bits."""
    bits = np.bincount((shingles & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


# -- document counts of shingles -------------------------------------------------------------------------------------


def _short(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The places of shingles within their buckets, as numbers of KEY_BYTES bytes."""
    return (shingles << np.uint64(bits)) >> np.uint64(64 - 8 * KEY_BYTES)


def _packed(short: np.ndarray) -> bytes:
    return np.ascontiguousarray(short.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(np.uint64).ravel()


def _chunk_rows(chunk: int, ids, sets, bits: int):
    """Rows of a chunk: one of its documents and the shingles that several of them have, and one for each bucket."""
    n = np.array([len(s) for s in sets], np.int64)
    node = np.array([set_id(s) if len(s) else 0 for s in sets], np.int64)
    signs = b"".join(signature(s).tobytes() for s in sets)
    firsts = np.zeros(len(sets), bool)  # copies within the chunk post nothing
    firsts[np.unique(node, return_index=True)[1]] = True
    firsts &= n > 0
    posting = [s for s, f in zip(sets, firsts) if f]
    doc = np.repeat(np.flatnonzero(firsts), n[firsts]).astype(np.uint16)
    h = np.concatenate(posting) if posting else np.zeros(0, np.uint64)
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    short = _short(h, bits)
    key = (bucket.astype(np.uint64) << np.uint64(8 * KEY_BYTES)) | short
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    start = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(key)])
    alone = np.ones(len(key), bool)
    many = size > 1
    in_many = np.repeat(many, size)
    alone[order[in_many]] = False
    yield chunk, chunk, ids, n, node, signs, sorted_key[start[many]].tobytes(), doc[order[in_many]].tobytes(), size[many].astype(np.uint32).tobytes()
    # each bucket: first the shingles of one document, in the order of documents, then those of several
    at = np.r_[bucket[alone], bucket[order[start[many]]]]
    keys = np.r_[short[alone], short[order[start[many]]]]
    refs = np.r_[doc[alone], np.full(int(many.sum()), SEVERAL, np.uint16)]
    counts = np.r_[np.ones(int(alone.sum()), np.uint32), size[many].astype(np.uint32)]
    by = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[by], np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(edges)):
        rows = by[edges[b] : edges[b + 1]]
        several = refs[rows] == SEVERAL
        yield int(b), chunk, None, None, None, None, _packed(keys[rows]), refs[rows].tobytes(), counts[rows][several].tobytes()


_COLUMNS = ["at", "chunk", "ids", "n", "node", "sign", "keys", "refs", "counts"]


def _types(id_type: pa.DataType) -> list:
    return [pa.int64(), pa.int64(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list, id_type: pa.DataType) -> pa.RecordBatch:
    columns = [[x.tobytes() if isinstance(x, np.ndarray) else x for x in c] for c in zip(*rows)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _types(id_type))], _COLUMNS)


@tidied
def _posted(batches, width: int, bits: int):
    part, k = TaskContext.get().partitionId(), 0
    ids, sets, held, id_type = [], [], 0, None

    def out():
        nonlocal k
        rows, size = [], 0
        for row in _chunk_rows((part << 24) + k, ids, sets, bits):
            rows.append(row)
            size += len(row[6]) + len(row[7])
            if size > BATCH_BYTES:
                yield _batch(rows, id_type)
                rows, size = [], 0
        if rows:
            yield _batch(rows, id_type)
        k += 1

    for batch in batches:
        column = batch.column("doc_id")
        id_type = column.type
        for at, texts in array_slices(batch):
            names = column.slice(at, len(texts)).to_pylist()
            for name, s in zip(names, shingle_sets(texts, width)):
                ids.append(name)
                sets.append(s)
                held += len(s)
                if held >= CHUNK or len(ids) >= CHUNK_DOCS:
                    yield from out()
                    ids, sets, held = [], [], 0
    if ids:
        yield from out()


@tidied
def _counted(batches):
    """Answers each chunk with the counts of those shingles of a bucket that more than one document has."""
    for batch in whole_groups(batches, ["at"]):
        id_type = batch.schema.field("ids").type.value_type
        own = batch.column("n").is_valid().to_numpy(zero_copy_only=False)
        if own.any():
            yield batch.filter(pa.array(own))
        if own.all():
            continue
        batch = batch.filter(pa.array(~own))
        buckets = batch.column("at").to_numpy()
        chunks, refs, counts = batch.column("chunk"), batch.column("refs"), batch.column("counts")
        for b in np.unique(buckets):
            at = np.flatnonzero(buckets == b)
            keys = [_unpacked(batch.column("keys")[int(i)].as_py()) for i in at]
            ends = np.cumsum([0, *map(len, keys)])
            keys = np.concatenate(keys)
            ref = np.concatenate([np.frombuffer(refs[int(i)].as_py(), np.uint16) for i in at])
            count = np.ones(len(keys), np.int64)
            count[ref == SEVERAL] = np.concatenate([np.frombuffer(counts[int(i)].as_py(), np.uint32) for i in at])
            order = np.argsort(keys, kind="stable")
            start = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
            total = np.add.reduceat(count[order], start)
            found = np.empty(len(keys), np.int64)
            found[order] = np.repeat(total, np.diff(np.r_[start, len(keys)]))
            rows = []
            for i, lo, hi in zip(at, ends[:-1], ends[1:]):
                met = np.flatnonzero(found[lo:hi] > 1) + lo
                if len(met):
                    rows.append((int(b), chunks[int(i)].as_py(), None, None, None, None, _packed(keys[met]), ref[met].tobytes(), np.minimum(found[met], 0xFFFFFFFF).astype(np.uint32).tobytes()))
            if rows:
                yield _batch(rows, id_type)


@tidied
def _prefixes(batches, percent: int):
    """Of each chunk its documents, and the met shingles among the first of its sets in global order."""
    names = ["doc_id", "n", "node", "token", "pos", "df", "sign"]
    longs = pa.list_(pa.int64())
    for batch in whole_groups(batches, ["chunk"]):
        chunk = batch.column("chunk").to_numpy()
        valid = batch.column("n").is_valid().to_numpy(zero_copy_only=False)
        for c in np.unique(chunk):
            mine = np.flatnonzero(chunk == c)
            own = int(mine[valid[mine]][0])
            read = lambda name, i, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)  # noqa: B023, E731
            ids = batch.column("ids")[own].values
            n, node = read("n", own, np.int64), read("node", own, np.int64)
            sign = read("sign", own, np.int64).reshape(-1, 4)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(node, mask=n == 0), none, none, none, pa.nulls(len(n), longs)], names)
            keys, refs, dfs = [], [], []
            for i in mine:
                if i != own:
                    bucket = np.uint64(batch.column("at")[int(i)].as_py()) << np.uint64(8 * KEY_BYTES)
                    keys.append(_unpacked(batch.column("keys")[int(i)].as_py()) | bucket)
                    refs.append(read("refs", int(i), np.uint16))
                    dfs.append(read("counts", int(i), np.uint32).astype(np.int64))
            if not keys:
                continue
            key, doc, df = np.concatenate(keys), np.concatenate(refs), np.concatenate(dfs)
            several = doc == SEVERAL
            if several.any():
                shared, size = read("keys", own, np.uint64), read("counts", own, np.uint32)
                at = np.argsort(key[several])
                count = df[several][at][np.searchsorted(key[several][at], shared)]
                key = np.r_[key[~several], np.repeat(shared, size)]
                doc = np.r_[doc[~several], read("refs", own, np.uint16)]
                df = np.r_[df[~several], np.repeat(count, size)]
            doc = doc.astype(np.int64)
            order = np.lexsort((key, df, doc))
            key, doc, df = key[order], doc[order], df[order]
            met = np.bincount(doc, minlength=len(n))
            begin = np.r_[0, np.cumsum(met)]
            rank = np.arange(len(doc)) - begin[doc]
            # two shingles of a set that look alike in their buckets share the lower place
            same = np.r_[False, (key[1:] == key[:-1]) & (df[1:] == df[:-1]) & (doc[1:] == doc[:-1])]
            rank = np.maximum.accumulate(np.where(same, -1, np.arange(len(doc)))) - begin[doc] if same.any() else rank
            pos = (n - met)[doc] + rank
            keep = (pos < (n + (-percent * n) // 100 + 1)[doc]) & ~same
            key, doc, df, pos = key[keep], doc[keep], df[keep], pos[keep]
            for lo in range(0, len(key), 20_000):
                s = slice(lo, lo + 20_000)
                d = doc[s]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(d), ids.type), pa.array(n[d]), pa.array(node[d]), pa.array(key[s].view(np.int64)), pa.array(pos[s]), pa.array(df[s]), pa.FixedSizeListArray.from_arrays(pa.array(sign[d].ravel()), 4).cast(longs)], names)


def scan_sets(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, node of each row, and token, node, n, pos, df, sign of each class (maybe repeated) under its met prefix shingles."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    bytes_ = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max(0, int(np.ceil(np.log2(max(1, bytes_ / BUCKET_BYTES))))))
    packed = f"at long, chunk long, ids array<{kind}>, n binary, node binary, sign binary, keys binary, refs binary, counts binary"
    with arrow_batches(spark, BATCH_BYTES):
        rows = texts.mapInArrow(partial(_posted, width=width, bits=bits), packed)
        rows = rows.repartition(1 << bits, "at").sortWithinPartitions("at").mapInArrow(_counted, packed)
        rows = rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(partial(_prefixes, percent=percent), f"doc_id {kind}, n long, node long, token long, pos long, df long, sign array<long>")
        scan = stored(rows, "jaccard-scan")
    return scan.filter("token IS NULL").select("doc_id", "n", "node"), scan.filter("token IS NOT NULL").drop("doc_id")


# -- neighbourhoods --------------------------------------------------------------------------------------------------


def _allowed(rows, i, j, percent: int):
    """Which pairs (i, j) may reach the threshold by lengths, positions and signatures."""
    _, n, pos, sign = rows
    total = n[i] + n[j]
    need = (percent * total + 99 + percent) // (100 + percent)
    ok = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
    i, j, total, need = i[ok], j[ok], total[ok], need[ok]
    fine = np.bitwise_count((sign[i] ^ sign[j]).view(np.uint64)).sum(1).astype(np.int64) <= total - 2 * need
    return i[fine], j[fine]


def _forest(rows, left, right, percent: int):
    """A spanning forest of the allowed pairs of a meeting of two blocks (or one with itself)."""
    root = {}

    def top(x):
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    out = []
    step = max(1, 1_000_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        i, j = np.repeat(some, len(right)), np.tile(right, len(some))
        if left is right:
            i, j = i[i < j], j[i < j]
        i, j = _allowed(rows, i, j, percent)
        for a, b in zip(i.tolist(), j.tolist()):
            a, b = top(a), top(b)
            if a != b:
                root[b] = a
                out.append((a, b))
    return out


@tidied
def _neighbours(batches, percent: int):
    """Edges (u, v) between classes that meet and may reach the threshold."""
    for batch in whole_groups(batches, ["token", "a", "b"]):
        token, a, b, node, n, pos, block = (batch.column(c).to_numpy() for c in ("token", "a", "b", "node", "n", "pos", "block"))
        sign = batch.column("sign").flatten().to_numpy().reshape(-1, 4)
        # rows are ordered by tile and node: classes count once
        tile = np.r_[True, (token[1:] != token[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        fresh = tile | np.r_[True, node[1:] != node[:-1]]
        tile_of = np.cumsum(tile)[fresh]
        rows = (node[fresh], n[fresh], pos[fresh], sign[fresh])
        cross, block = (a != b)[fresh], block[fresh]
        start = np.flatnonzero(np.r_[True, tile_of[1:] != tile_of[:-1]])
        size = np.diff(np.r_[start, len(tile_of)])
        # small meetings at once: each member with those before it
        small = np.repeat(size <= SMALL, size) & ~cross
        before = np.where(small, np.arange(len(tile_of)) - np.repeat(start, size), 0)
        j = np.repeat(np.arange(len(tile_of)), before)
        i = np.arange(len(j)) - np.repeat(np.cumsum(before) - before, before) + np.repeat(np.repeat(start, size), before)
        i, j = _allowed(rows, i, j, percent)
        found = [(i, j)]
        for s, m in zip(start.tolist(), size.tolist()):
            members = np.arange(s, s + m)
            if cross[s]:
                low = block[s : s + m] == block[s : s + m].min()
                pairs = _forest(rows, members[low], members[~low], percent)
            elif m > SMALL:
                pairs = _forest(rows, members, members, percent)
            else:
                continue
            if pairs:
                found.append(tuple(np.array(pairs).T))
        u, v = (rows[0][np.concatenate([p[k] for p in found])] for k in (0, 1))
        both = np.unique(np.stack([np.maximum(u, v), np.minimum(u, v)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])


def neighbourhoods(postings: DataFrame, percent: int) -> DataFrame:
    """node, component of the classes that have a neighbour."""
    postings = postings.withColumn("blocks", F.ceil(F.col("df") / MEETING)).drop("df")
    one = postings.filter("blocks = 1").selectExpr("token", "0L AS a", "0L AS b", "0L AS block", "node", "n", "pos", "sign")
    large = postings.filter("blocks > 1").dropDuplicates(["token", "node"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    large = large.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    large = large.select("token", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "block", "node", "n", "pos", "sign")
    rows = one.unionByName(large).repartition("token", "a", "b").sortWithinPartitions("token", "a", "b", "node")
    found = components(rows.mapInArrow(partial(_neighbours, percent=percent), "u long, v long"))
    return found.unionByName(found.selectExpr("component AS node", "component").distinct())


# -- prefix trees ----------------------------------------------------------------------------------------------------


class Trie:
    """Sets of numbers, each in ascending order, with common beginnings stored once.

    An edge holds a run of elements; a node knows the longest and the shortest
    set below it and the sets that end there.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        self.root = self._node(None, 0, 0)
        path = [self.root]
        last = None
        for k in order:
            s = sets[k]
            common = 0
            if last is not None:
                m = min(len(s), len(last))
                apart = np.flatnonzero(s[:m] != last[:m])
                common = int(apart[0]) if len(apart) else m
            cut = None
            while path[-1]["end"] > common:
                cut = path.pop()
            if cut is not None and path[-1]["end"] < common:  # the edge is split where the sets part
                middle = self._node(cut["elements"][: common - cut["begin"]], cut["begin"], common)
                cut["elements"], cut["begin"] = cut["elements"][common - cut["begin"] :], common
                path[-1]["children"][-1] = middle
                middle["children"].append(cut)
                path.append(middle)
            if path[-1]["end"] < len(s):
                leaf = self._node(s[path[-1]["end"] :], path[-1]["end"], len(s))
                path[-1]["children"].append(leaf)
                path.append(leaf)
            path[-1]["sets"].append(k)
            last = s
        self._lengths(self.root)

    @staticmethod
    def _node(elements, begin: int, end: int) -> dict:
        return {"elements": elements, "begin": begin, "end": end, "children": [], "sets": [], "longest": 0, "shortest": 0}

    @staticmethod
    def _lengths(root: dict) -> None:
        stack = [(root, False)]
        while stack:
            node, done = stack.pop()
            if not done:
                stack.append((node, True))
                stack += [(c, False) for c in node["children"]]
                continue
            ends = [node["end"]] * bool(node["sets"])
            node["longest"] = max([*ends, *(c["longest"] for c in node["children"])], default=0)
            node["shortest"] = min([*ends, *(c["shortest"] for c in node["children"])], default=0)

    def similar(self, has: np.ndarray, sizes: np.ndarray, percent: int):
        """Yields (probe numbers, set) of those probes whose Jaccard similarity with the set is at least the percentage.

        ``has[e, p]`` is 1 if probe p has the element e; ``sizes`` are the probes' numbers of elements.
        """
        stack = [(self.root, np.arange(len(sizes)), np.zeros(len(sizes), np.int64))]
        while stack:
            node, probes, shared = stack.pop()
            if node["sets"]:
                near = probes[100 * shared >= percent * (sizes[probes] + node["end"] - shared)]
                for k in node["sets"]:
                    yield near, k
            for child in node["children"]:
                longest, shortest = child["longest"], child["shortest"]
                n = sizes[probes]
                # what may be missed on the way to the longest set below; shorter ones may miss less
                spare = longest - (percent * (n + longest) + 99 + percent) // (100 + percent)
                ok = (child["begin"] - shared <= spare) & ((percent * (n + shortest) + 99 + percent) // (100 + percent) <= n)
                if not ok.any():
                    continue
                on = probes[ok]
                rows = has[child["elements"]]
                got = shared[ok] + (rows if len(on) == has.shape[1] else rows[:, on]).sum(0, dtype=np.int64)
                fine = child["end"] - got <= spare[ok]
                if fine.any():
                    stack.append((child, on[fine], got[fine]))


def similar_sets(stored_sets: list[np.ndarray], probes: list[np.ndarray], percent: int) -> np.ndarray:
    """links[i, j]: stored set i and probe j reach the percentage."""
    vocabulary, inverse, counts = np.unique(np.concatenate(stored_sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(vocabulary), np.int64)
    rank[np.lexsort((vocabulary, -counts))] = np.arange(len(vocabulary))  # what most sets have comes first: long common beginnings
    ends = np.cumsum([len(s) for s in stored_sets])
    trie = Trie([np.sort(r) for r in np.split(rank[inverse], ends[:-1])])
    links = np.zeros((len(stored_sets), len(probes)), bool)
    step = max(1, CELLS // len(vocabulary))
    for at in range(0, len(probes), step):
        some = probes[at : at + step]
        sizes = np.array([len(p) for p in some], np.int64)
        has = np.zeros((len(vocabulary), len(some)), np.uint8)
        flat = np.concatenate(some)
        place = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
        known = vocabulary[place] == flat
        has[rank[place[known]], np.repeat(np.arange(len(some)), sizes)[known]] = 1
        for near, k in trie.similar(has, sizes, percent):
            links[k, at + near] = True
    return links


def _least_labels(links: np.ndarray) -> np.ndarray:
    """The least number that each row of a symmetric matrix reaches."""
    label = np.arange(len(links))
    while True:
        reached = np.where(links, label[None, :], len(links)).min(1)
        new = np.minimum(label, reached)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


@tidied
def _joined(batches, percent: int):
    """node, root, others, whole: the least class of the tile that links lead to, documents linked with, and whether the tile is all of the neighbourhood."""
    for batch in whole_groups(batches, ["component", "a", "b"]):
        columns = [batch.column(c).to_numpy() for c in ("component", "a", "b", "block", "node", "rows")]
        blocks = batch.column("blocks").to_numpy()
        component, a, b = columns[:3]
        tile = np.flatnonzero(np.r_[True, (component[1:] != component[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        out = []
        for lo, hi in zip(tile.tolist(), [*tile[1:].tolist(), len(component)]):
            some = lo + np.unique(columns[4][lo:hi], return_index=True)[1]
            if len(some) < 2:
                continue
            block, node, rows = (c[some] for c in columns[3:])
            sets = [np.frombuffer(batch.column("elements")[int(i)].as_py(), np.uint64) for i in some]
            if a[lo] == b[lo]:
                links = similar_sets(sets, sets, percent)
            else:
                first = block == a[lo]
                if first.all() or not first.any():
                    continue
                left, right = np.flatnonzero(first), np.flatnonzero(~first)
                links = np.zeros((len(some), len(some)), bool)
                links[np.ix_(left, right)] = similar_sets([sets[i] for i in left], [sets[i] for i in right], percent)
                links |= links.T
            np.fill_diagonal(links, False)
            out.append((node, node[_least_labels(links)], links @ rows, np.full(len(some), blocks[lo] == 1)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["node", "root", "others", "whole"])


@tidied
def _sets(batches, width: int):
    """The sets of texts; of those with a wanted node only sets of that node."""
    names = batches_names = None
    for batch in batches:
        names = names or [c for c in batch.schema.names if c not in ("text", "node")]
        batches_names = batches_names or ["node", *names, "elements"]
        wanted = batch.column("node").to_pylist()
        for at, texts in array_slices(batch):
            rows, nodes, sets = [], [], []
            for k, s in enumerate(shingle_sets(texts, width)):
                if len(s) and wanted[at + k] in (None, x := set_id(s)):
                    rows.append(at + k)
                    nodes.append(x)
                    sets.append(s.tobytes())
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *(batch.column(c).take(rows) for c in names), pa.array(sets, pa.binary())], batches_names)


def _linked(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scan (doc_id, n, node), its classes (node, doc_id, rows), and node, component, others of those with neighbours."""
    spark = docs.sparkSession
    scan, postings = scan_sets(docs, width, percent)
    near = neighbourhoods(postings, percent)
    classes = stored(scan.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.min("n").alias("n")), "jaccard-classes")
    active = stored(classes.join(near, "node"), "jaccard-active")
    sizes = active.groupBy("component").agg(F.sum("n").alias("n"), F.count("*").alias("sets"))
    sizes = stored(sizes.select("component", F.greatest(F.ceil(F.col("n") / BLOCK_ELEMENTS), F.ceil(F.col("sets") / BLOCK_SETS)).alias("blocks")), "jaccard-blocks")
    placed = active.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).drop("n")
    known = placed.filter("doc_id IS NOT NULL")
    counts = active.agg(F.count("doc_id"), F.count("*")).first()
    texts = docs.select("doc_id", "text")
    extra = "rows long, blocks long, block long, component long"
    with arrow_batches(spark, BATCH_BYTES):
        found = texts.join(F.broadcast(known) if counts[0] <= MOST_BROADCAST else known, "doc_id").select("node", "rows", "blocks", "block", "component", "text")
        sets = found.mapInArrow(partial(_sets, width=width), f"node long, {extra}, elements binary")
        if counts[0] < counts[1]:  # classes of which no row has an id are found by their sets
            nameless = texts.filter("doc_id IS NULL").select(F.lit(None).cast("long").alias("node"), "text").mapInArrow(partial(_sets, width=width), "node long, elements binary")
            sets = sets.unionByName(nameless.join(placed.filter("doc_id IS NULL").drop("doc_id"), "node"))
        tiles = sets.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        tiles = tiles.select("component", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "blocks", "block", "node", "rows", "elements")
        tiles = tiles.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b")
        linked = stored(tiles.mapInArrow(partial(_joined, percent=percent), "node long, root long, others long, whole boolean"), "jaccard-links")
    label = linked.filter("whole").selectExpr("node", "root AS component")
    parts = linked.filter("NOT whole")
    if not parts.isEmpty():
        label = label.unionByName(components(parts.selectExpr("node AS u", "root AS v")))
    others = linked.groupBy("node").agg(F.sum("others").alias("others"))
    return scan, classes.drop("n"), others.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "others")


def jaccard_links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row; ``n_links`` are the other rows whose sets reach the threshold."""
    scan, classes, linked = _linked(docs, width, percent)
    classes = stored(classes.withColumnRenamed("doc_id", "first").join(linked, "node", "left"), "jaccard-classes")
    ids = stored(classes.filter("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("least")), "jaccard-ids")
    classes = stored(classes.join(ids, "component", "left").select("node", F.coalesce("least", "first").alias("component_id"), (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "jaccard-classes")
    rows = scan.filter("node IS NOT NULL").join(classes, "node").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "n_links")
    empty = scan.filter("node IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return rows.unionByName(empty)


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; see the module."""
    return jaccard_links(docs, width, percent).drop("n_links")


def one_of_each_group(docs: DataFrame, **how) -> DataFrame:
    """The documents whose doc_id is that of their component.

    Rows that repeat a doc_id stay or go together, and equal ones stay once.
    Rows without a doc_id can't be told apart and stay.
    """
    found = jaccard_components(docs, **how).groupBy("doc_id").agg(F.max(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).alias("stays"), F.count("*").alias("rows"))
    found = stored(found.filter("doc_id IS NOT NULL AND (NOT stays OR rows > 1)"), "jaccard-dropped")
    dropped = found.filter("NOT stays").select("doc_id")
    out = docs.join(F.broadcast(dropped) if dropped.count() <= MOST_BROADCAST else dropped, "doc_id", "left_anti").select(docs.columns)
    if not found.filter("stays AND rows > 1").isEmpty():
        named = out.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
        out = named.unionByName(out.filter("doc_id IS NULL"))
    return out


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"))
