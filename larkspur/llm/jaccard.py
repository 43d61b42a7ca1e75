"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Documents become sets of hashed 5-word shingles; equal sets are one node from then on. Two nodes link when
100 * intersection >= 75 * union. The join is exact:

1. Order. All shingles are counted. Those in more than ``LIGHT`` documents are heavy and come last in the global
   order, by count; the others come first, by hash. The heavy ones are broadcast, the most frequent ``HEAVY_BOUND`` of
   them at most; which ones they are changes the cost of the join, never its result.
2. Reduced sets. With n shingles, any partner shares at least m = ceil(0.75 n) of them, so two linked nodes share at
   least SUBSET of their first n - m + SUBSET shingles in the order. Only those are indexed, and only shingles that
   two nodes share this way stay: the join has become one of reduced sets with at least SUBSET common elements.
3. Leaders. A pair within one component needs no comparison, since components are what is asked for. So each node
   is first compared with the LEADERS leaders of each list that it is in, and large groups of copies fall together in
   linear time. A list's leaders are its least nodes in LEADERS orders that all lists share, so lists with much the
   same nodes, of whatever length, mostly agree in them. Of a node's links one stays; its other leaders are chained to
   that one, once for all nodes, which keeps the components. From then on only elements count whose lists still hold
   nodes of different components.
4. Light and heavy. A reduced set of up to so many such elements is light: all its subsets of SUBSET elements are
   enumerated, and partners meet at an equal subset. Larger ones are heavy: the inverted lists of their elements are
   scanned and common elements counted. The boundary is the one with the lowest total cost, from the numbers of
   subsets and the list lengths of all reduced sets.
5. Links. Common shingles that the index does not show lie behind the front of one of the two sets, so the sizes tell
   how many must be in front. Where a node and a larger component meet so often, the node is compared with the
   component's nodes, in blocks of bounded size. However many blocks find a link, the two components are joined once.

A set is told by a 64-bit digest, and where two different sets share one, as a second digest tells, by both.

A null text, an empty one and one of white space only has no shingles and links with nothing. Rows that repeat a
doc_id are documents of their own with the same id. A null doc_id is never a component id unless all are null. An empty
table gives an empty one; extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm._store import drop, read_table, save, ship
from larkspur.llm._text import mix, shingle_sets, slices
from larkspur.llm.components import components

WORDS = 5
PERCENT = 75
SUBSET = 2
LIGHT = 16
HEAVY_BOUND = 2_000_000
COUNT_PART = 8_000_000
INDEX_PART = 1_000_000
LIST_PART = 4096
LEADERS = 2
APART = 64
SCAN = 0.05
BLOCK = 256
IDS_BOUND = 4_000_000
_BUFFER = 1_000_000


def least_common(n: int) -> int:
    return -(-PERCENT * n // 100)


def linked(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * common >= PERCENT * (n + m - common)


def least_in_front(n: Column, m: Column) -> Column:
    """How many elements the reduced sets of two linked nodes of n and m shingles have in common at least."""
    common = F.ceil((n + m) * PERCENT / (100 + PERCENT))
    behind = F.ceil(F.greatest(n, m) * PERCENT / 100) - SUBSET
    return F.greatest(common - behind, F.lit(SUBSET))


def least_in_range(n: Column, low: Column, high: Column) -> Column:
    """The least that ``least_in_front`` gives for n and a size from low to high. Below n it rises with the other size, so
    low has its least there; above n it falls, but for the rounding, and is higher by 1 at least for a size less by 4:
    the least is among the last four sizes."""
    return F.least(least_in_front(n, low), *[least_in_front(n, F.greatest(high - k, low)) for k in range(4)])


def common_sorted(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set, as signed numbers."""
    with np.errstate(over="ignore"):
        one = mix(s).sum(dtype=np.uint64) + np.uint64(len(s))
        two = mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(mix(np.array([one])).view(np.int64)[0]), int(mix(np.array([two])).view(np.int64)[0])


# -- 1. order ---------------------------------------------------------------------------------------------------
def _parts(n: float, each: int, least: int) -> int:
    """Bits of a number of parts of about ``each`` out of n."""
    return max(math.ceil(math.log2(max(n / each, 1))), math.ceil(math.log2(least)))


def heavy_shingles(docs: DataFrame, text_col: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (the first 32 + bits bits of the hash), sorted, and counts of the shingles in more than LIGHT documents."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            keys = np.sort(np.concatenate(held) >> np.uint64(32 - bits))
            part = keys >> np.uint64(32)
            ends = np.searchsorted(part, np.arange((1 << bits) + 1))
            low = keys.astype(np.uint32)
            some = np.flatnonzero(np.diff(ends))
            return pa.record_batch([pa.array(some, pa.int64()), pa.array([low[ends[p] : ends[p + 1]].tobytes() for p in some], pa.binary())], names=["part", "keys"])

        for batch in batches:
            for texts in slices(batch.column(0)):
                sets = shingle_sets(texts, WORDS)
                held += sets
                n += sum(map(len, sets))
                if n >= _BUFFER:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("keys")]))
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(begin, len(keys)))
        many = n > LIGHT
        part = np.uint64(table.column("part")[0].as_py())
        full = (part << np.uint64(32)) | keys[begin[many]].astype(np.uint64)
        return pa.table({"key": pa.array(full.view(np.int64), pa.int64()), "n": pa.array(n[many], pa.int64())})

    counted = docs.select(text_col).mapInArrow(split, "part long, keys binary").groupBy("part").applyInArrow(count, "key long, n long")
    counted = save(counted, "heavy")
    # Bounded: the HEAVY_BOUND most frequent.
    rows = counted.orderBy(F.col("n").desc(), "key").limit(HEAVY_BOUND).toArrow()
    drop(counted)
    keys, n = rows.column("key").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


# -- 2. reduced sets --------------------------------------------------------------------------------------------
def _counts_of(s: np.ndarray, keys: np.ndarray, n: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """The count of each shingle if it is heavy, else 0."""
    short = s >> np.uint64(32 - bits)
    out = np.zeros(len(s), np.int64)
    maybe = np.flatnonzero(bitmap[(mix(short) >> np.uint64(40)).astype(np.int64)])
    if len(maybe) and len(keys):
        at = np.minimum(np.searchsorted(keys, short[maybe]), len(keys) - 1)
        hit = keys[at] == short[maybe]
        out[maybe[hit]] = n[at[hit]]
    return out


def prefixes(docs: DataFrame, id_col: str, text_col: str, heavy: tuple[np.ndarray, np.ndarray], bits: int) -> DataFrame:
    """(doc_id, n, node, check, prefix, freq): the size of each set, its two digests, and the shingles at its front."""
    held = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = held.value
        bitmap = np.zeros(1 << 24, bool)
        bitmap[(mix(keys) >> np.uint64(40)).astype(np.int64)] = True
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                rows = []
                for s in shingle_sets(texts, WORDS):
                    size = len(s)
                    if size < 3:  # only an equal set can link with so small a one
                        rows.append((size, *set_keys(s), b"", b""))
                        continue
                    front = size - least_common(size) + SUBSET
                    count = _counts_of(s, keys, n, bitmap, bits)
                    order = np.argsort(count, kind="stable")[:front] if count.any() else slice(front)
                    rows.append((size, *set_keys(s), s[order].tobytes(), np.minimum(count[order], 2**31 - 1).astype(np.int32).tobytes() if count.any() else b""))
                cols = list(zip(*rows, strict=True))
                made = [pa.array(cols[i], pa.int64()) for i in range(3)] + [pa.array(cols[i], pa.binary()) for i in (3, 4)]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), *made], names=["doc_id", "n", "node", "check", "prefix", "freq"])
                at += len(texts)

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n long, node long, `check` long, prefix binary, freq binary")


def shared_elements(table: DataFrame, bits: int) -> DataFrame:
    """(node, size, token, df, leaders): elements of reduced sets that at least two nodes have, from an index in parts, with
    the length of each list and its leaders (null for the leader itself and where the sizes rule out a link)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: a node's copies give its elements once
        held, total = [], 0

        def flush():
            token, node, size, freq = (np.concatenate(x) for x in zip(*held, strict=True))
            # Lists that are known to be long are dealt out by node as well.
            spread = np.where(freq > LIST_PART, 1 + (mix(node) % (freq // LIST_PART + 1).astype(np.uint64)).astype(np.int64), 0)
            part = (token >> np.uint64(64 - bits)).astype(np.int64)
            order = np.lexsort((spread, part))
            token, node, size, part, spread = token[order], node[order], size[order], part[order], spread[order]
            begin = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (spread[1:] != spread[:-1])]))
            ends = np.append(begin[1:], len(part))
            blobs = [pa.array([x[a:b].tobytes() for a, b in zip(begin, ends, strict=True)], pa.binary()) for x in (token, node, size)]
            return pa.record_batch([pa.array(part[begin], pa.int64()), pa.array(spread[begin], pa.int64()), *blobs], names=["part", "spread", "tokens", "nodes", "sizes"])

        for batch in batches:
            for node, size, prefix, freq in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if node in seen or not prefix:
                    continue
                seen.add(node)
                token = np.frombuffer(prefix, np.uint64)
                count = np.frombuffer(freq, np.int32).astype(np.int64) if freq else np.zeros(len(token), np.int64)
                held.append((token, np.full(len(token), node, np.int64).view(np.uint64), np.full(len(token), size, np.int32), count))
                total += len(token)
                if total >= _BUFFER // 2:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    def lists(table: pa.Table) -> pa.Table:
        token, node = (np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column(c)]) for c in ("tokens", "nodes"))
        size = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table.column("sizes")])
        order = np.lexsort((node, token))
        token, node, size = token[order], node[order], size[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, node, size = token[new], node[new], size[new]
        begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        n = np.diff(np.append(begin, len(token)))
        df = np.repeat(n, n)
        keep = (df > 1) | (table.column("spread")[0].as_py() > 0)
        columns = [pa.array(node[keep].view(np.int64)), pa.array(size[keep]), pa.array(token[keep].view(np.int64)), pa.array(df[keep], pa.int64())]
        for k in range(LEADERS):
            drawn = mix(node ^ np.uint64(k + 1))
            first = np.flatnonzero(drawn == np.repeat(np.minimum.reduceat(drawn, begin), n)) if len(token) else begin
            at = np.repeat(first, n)  # mix is one to one, so a list has one least node
            lead, small, large = node[at], np.minimum(size, size[at]).astype(np.int64), np.maximum(size, size[at]).astype(np.int64)
            fits = (lead != node) & (100 * small >= PERCENT * large)
            columns.append(pa.array(lead[keep].view(np.int64), mask=~fits[keep]))
        return pa.table(columns, names=["node", "size", "token", "df", *(f"leader_{k}" for k in range(LEADERS))])

    index = table.select("node", "n", "prefix", "freq").mapInArrow(split, "part long, spread long, tokens binary, nodes binary, sizes binary")
    ddl = "node long, size int, token long, df long" + "".join(f", leader_{k} long" for k in range(LEADERS))
    made = index.groupBy("part", "spread").applyInArrow(lists, ddl)
    leaders = [F.col(f"leader_{k}") for k in range(LEADERS)]
    return made.select("node", "size", "token", "df", F.array_distinct(F.array(*leaders)).alias("leaders"))


# -- 4. light and heavy -----------------------------------------------------------------------------------------
def boundary(reduced: DataFrame) -> int:
    """The largest size of a light reduced set that makes the join cheapest; at most 300 rows are gathered. A subset
    costs a row; an element a row and ``SCAN`` for each entry of its list."""
    size = F.least(F.col("pi"), F.lit(300))
    subsets = F.col("pi") * (F.col("pi") - 1) / 2
    rows = reduced.groupBy(size.alias("pi")).agg(F.sum(subsets).alias("subsets"), F.sum(F.col("pi") + SCAN * F.col("scan")).alias("scan")).collect()
    rows = sorted((r["pi"], r["subsets"], r["scan"]) for r in rows)
    scan = sum(r[2] for r in rows)
    best, at, light = scan, 1, 0.0
    for pi, subsets, s in rows:
        light, scan = light + subsets, scan - s
        if pi < 300 and light + scan <= best:
            best, at = light + scan, pi
    return at


def meetings(reduced: DataFrame, limit: int) -> DataFrame:
    """(key, node, root, weight, heavy): light sets under each subset (weight SUBSET) and each element, heavy ones
    under each element (weight 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, node, root, weight, heavy, held = [], [], [], [], [], 0

            def out():
                cols = [np.concatenate(x) for x in (key, node, root, weight, heavy)]
                return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=["key", "node", "root", "weight", "heavy"])

            for i in range(batch.num_rows):
                token = np.sort(np.asarray(batch.column(2)[i].values).view(np.uint64))
                light = len(token) <= limit
                keys, weights = [mix(token ^ np.uint64(1))], [np.ones(len(token), np.int32)]
                if light and len(token) >= SUBSET:
                    a, b = np.triu_indices(len(token), 1)
                    with np.errstate(over="ignore"):
                        keys.append(mix(token[a] * np.uint64(0x9E3779B97F4A7C15) + mix(token[b])))
                    weights.append(np.full(len(a), SUBSET, np.int32))
                k = np.concatenate(keys)
                key.append(k.view(np.int64))
                weight.append(np.concatenate(weights))
                node.append(np.full(len(k), batch.column(0)[i].as_py(), np.int64))
                root.append(np.full(len(k), batch.column(1)[i].as_py(), np.int64))
                heavy.append(np.full(len(k), not light))
                held += len(k)
                if held > 200_000:
                    yield out()
                    key, node, root, weight, heavy, held = [], [], [], [], [], 0
            if held:
                yield out()

    return reduced.select("node", "root", "tokens").mapInArrow(run, "key long, node long, root long, weight int, heavy boolean")


# -- 3. and 5. links ---------------------------------------------------------------------------------------------------
def rekeyed(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """rows (node, check, ...) with another node for the sets whose first digest is that of a different set; clashes: (node, check)
    of the sets that keep it."""
    if clashes is None:
        return rows
    rows = rows.join(clashes.select(F.col("node").alias("c_node"), F.col("check").alias("c_check")), F.col("node") == F.col("c_node"), "left")
    return rows.withColumn("node", F.when(F.col("check") != F.col("c_check"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("c_node", "c_check")


def sets_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """(node, shingles) of the wanted (node, doc_id). Up to IDS_BOUND ids are sent to every task; more are joined."""
    spark = docs.sparkSession
    ids = wanted.select("doc_id").distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    few = ids.limit(IDS_BOUND + 1).count() <= IDS_BOUND
    held = None
    if few:
        known = ids.where("doc_id is not null").toArrow().column(0).to_numpy().astype(np.int64)
        held = spark.sparkContext.broadcast(np.sort(known))
    else:
        texts = texts.join(ids.withColumnRenamed("doc_id", "w_id"), F.col("doc_id").eqNullSafe(F.col("w_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held is not None:
                ids = batch.column(0).cast(pa.int64())
                hit = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), held.value)
                batch = batch.filter(pa.array(hit | ids.is_null().to_numpy(zero_copy_only=False)))
            for part in slices(batch.column(1)):
                sets = shingle_sets(part, WORDS)
                keys = [set_keys(s) for s in sets]
                yield pa.record_batch([pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)] + [pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "check", "shingles"])

    made = rekeyed(texts.mapInArrow(run, "node long, `check` long, shingles binary"), clashes).join(wanted.select("node").distinct(), "node", "left_semi")
    return made.groupBy("node").agg(F.any_value("shingles").alias("shingles"))


def verify_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two in batches:
            out = []
            for x, y in zip(one, two, strict=True):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                out.append(bool(linked(common_sorted(s, t), len(s), len(t))))
            yield pa.array(out, pa.bool_())

    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    test = F.arrow_udf(run, "boolean")(F.col("set_a"), F.col("set_b"))
    return pairs.join(b, "b").join(a, "a").where(test).select("a", "b")


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) of leaders and nodes with the same components: each node's link to its least leader, and links from
    each of its leaders to the next, which nodes of the same leaders have in common. A node has no more leaders than
    elements in front."""
    leaders = F.array_sort(F.collect_set("a"))
    each = links.groupBy("b").agg(leaders.alias("l"))
    own = each.select(F.col("l")[0].alias("a"), "b")
    chain = each.where(F.size("l") > 1).select(F.explode(F.arrays_zip(F.slice("l", F.lit(1), F.size("l") - 1).alias("a"), F.slice("l", F.lit(2), F.size("l") - 1).alias("b"))).alias("c"))
    return own.union(chain.select("c.a", "c.b")).distinct()


def verify_blocks(visits: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """visits: (node, target), a node and a component; members: (node, root). (node, target): the visits that find a link,
    once for each block of the component's members that has one. A task holds at most about 2 * BLOCK sets at once."""
    sizes = visits.groupBy("target").agg(F.count("*").alias("n_visits"))
    hosts = members.join(sizes, F.col("root") == F.col("target"))
    blocks = hosts.groupBy("target").agg(F.count("*").alias("n_members"), F.first("n_visits").alias("n_visits"))
    blocks = blocks.select("target", F.ceil(F.col("n_members") / BLOCK).cast("int").alias("n_blocks"), F.ceil(F.col("n_visits") / BLOCK).cast("int").alias("n_chunks"))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    host = hosts.select("node", "target").join(blocks, "target").select("target", own(F.col("n_blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk"), "node", F.lit(True).alias("host"))
    guest = visits.join(blocks, "target").select("target", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), own(F.col("n_chunks")).alias("chunk"), "node", F.lit(False).alias("host"))

    def run(table: pa.Table) -> pa.Table:
        host = np.asarray(table.column("host"))
        node = table.column("node").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        hosts, found = np.flatnonzero(host), []
        if len(hosts):
            n = np.array([len(sets[i]) for i in hosts])
            token, owner = np.concatenate([sets[i] for i in hosts]), np.repeat(np.arange(len(hosts)), n)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            for i in np.flatnonzero(~host):
                left, right = np.searchsorted(token, sets[i]), np.searchsorted(token, sets[i], side="right")
                width = right - left
                at = np.repeat(left - (np.cumsum(width) - width), width) + np.arange(width.sum())
                if linked(np.bincount(owner[at], minlength=len(hosts)), n, np.int64(len(sets[i]))).any():
                    found.append(int(node[i]))
        return pa.table({"node": pa.array(found, pa.int64()), "target": pa.array([table.column("target")[0].as_py()] * len(found), pa.int64())})

    rows = host.unionByName(guest).join(sets, "node")
    return rows.groupBy("target", "block", "chunk").applyInArrow(run, "node long, target long")


def dense_meetings(rows: DataFrame, reduced: DataFrame) -> DataFrame:
    """rows: (key, node, members), nodes of lists with many components. (node, target): pairs of a list whose sizes
    and common elements allow a link, from blocks of a list against each other; only such pairs leave a task."""
    counts = rows.groupBy(F.col("key").alias("n_key")).agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("n_blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    rows = rows.join(counts, F.col("key") == F.col("n_key")).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") <= F.col("other")).alias("first"), "node", "members")

    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("one", "two", "first", "node", "members", "root", "size")}
        tokens = [np.asarray(x.values) for x in table.column("tokens")]
        flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        n, across = col["size"].astype(np.int64), col["one"][0] != col["two"][0]
        least, node, target = -(-n * PERCENT // 100), [], []
        for i in range(len(tokens)):
            left = np.searchsorted(flat, tokens[i])
            width = np.searchsorted(flat, tokens[i], side="right") - left
            at = np.repeat(left - (np.cumsum(width) - width), width) + np.arange(width.sum())
            common = np.bincount(owner[at], minlength=len(tokens))
            need = np.maximum(-(-(n + n[i]) * PERCENT // (100 + PERCENT)) - (np.maximum(least, least[i]) - SUBSET), SUBSET)
            fits = (common >= need) & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i])) & (col["root"] != col["root"][i])
            # The node of the smaller component visits the larger.
            fits &= (col["members"] > col["members"][i]) | ((col["members"] == col["members"][i]) & (col["root"] > col["root"][i]))
            if across:
                fits &= col["first"] != col["first"][i]
            found = np.unique(col["root"][fits])
            node += [int(col["node"][i])] * len(found)
            target += found.tolist()
        return pa.table({"node": pa.array(node, pa.int64()), "target": pa.array(target, pa.int64())})

    rows = rows.join(reduced.select("node", "root", "size", "tokens"), "node")
    return rows.groupBy("key", "one", "two").applyInArrow(run, "node long, target long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    least = 8 * spark.sparkContext.defaultParallelism
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shingles = size / 6  # roughly; it only sets how many parts there are
    bits = min(_parts(shingles, COUNT_PART, least), 24)
    heavy = heavy_shingles(docs, text_col, bits)
    table = save(prefixes(docs, id_col, text_col, heavy, bits), "prefixes")
    clashes = None
    if table.groupBy("node").agg((F.min("check") != F.max("check")).alias("two")).where("two").limit(1).count():
        clashes = save(table.groupBy("node").agg(F.min("check").alias("check"), F.max("check").alias("other")).where("check != other").drop("other"), "clashes")
        table = save(rekeyed(table, clashes), "prefixes")
    shared = save(shared_elements(table, min(_parts(shingles / 4, INDEX_PART, least), 24)), "shared")
    nodes = table.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    nodes = save(nodes, "nodes")

    def known(rows: DataFrame) -> DataFrame:
        return sets_of(docs, id_col, text_col, nodes.join(rows.distinct(), "node", "left_semi"), clashes)

    led = shared.select("node", F.explode("leaders").alias("leader")).where("leader is not null")
    pairs = led.groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("met"))
    pairs = save(pairs.where(f"met >= {SUBSET}").select("a", "b"), "pairs")
    sets = save(known(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))), "sets")
    links = save(thinned(verify_pairs(pairs, sets)), "links")
    drop(sets)
    drop(pairs)
    roots = components(links)
    drop(links)

    named = save(shared.drop("leaders").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    drop(shared)
    mixed = named.groupBy("token").agg((F.min("root") != F.max("root")).alias("mixed")).where("mixed").select("token")
    open_ = named.join(mixed, "token", "left_semi").groupBy("node", "root", "size").agg(F.collect_list("token").alias("tokens"), F.sum("df").alias("scan"), F.count("*").alias("pi"))
    reduced = save(open_.where(f"pi >= {SUBSET}"), "reduced")
    drop(named)
    met = meetings(reduced, boundary(reduced))
    # Elements matter only where a heavy set has them: two light sets meet at their subsets.
    keys = met.groupBy("key", "weight").agg((F.min("root") != F.max("root")).alias("mixed"), F.max("heavy").alias("any_heavy"))
    keys = keys.where(f"mixed and (weight = {SUBSET} or any_heavy)").select(F.col("key").alias("k"), F.col("weight").alias("w"))
    lists = save(met.join(keys, (F.col("key") == F.col("k")) & (F.col("weight") == F.col("w")), "left_semi"), "lists")
    weights = roots.groupBy("root").agg(F.count("*").alias("members"))
    ranked = lists.join(weights, "root", "left").withColumn("rank", F.struct(F.coalesce("members", F.lit(1)).alias("members"), F.col("root")))
    there = ranked.groupBy(F.col("key").alias("t_key"), F.col("rank").alias("t_rank")).agg(F.max("heavy").alias("t_heavy"))
    tops = there.groupBy("t_key").agg(F.max("t_rank").alias("major"), (F.count("*") - 1).alias("others"))
    ranked = save(ranked.join(tops, F.col("key") == F.col("t_key")).where("rank < major").drop("t_key", "members"), "ranked")
    # With the largest component of its list each node meets once; the other components meet each other, pair by pair
    # where they are few, in blocks where they are many.
    major = ranked.select("node", F.col("major.root").alias("target"), "weight")
    few = ranked.where(f"others between 2 and {APART}")
    there = few.groupBy(F.col("key").alias("t_key"), F.col("rank").alias("t_rank")).agg(F.max("heavy").alias("t_heavy"))
    apart = few.join(there, (F.col("key") == F.col("t_key")) & (F.col("t_rank") > F.col("rank")) & ((F.col("weight") == SUBSET) | F.col("heavy") | F.col("t_heavy")))
    seen = major.union(apart.select("node", F.col("t_rank.root").alias("target"), "weight"))
    dense = dense_meetings(ranked.where(f"others > {APART}").select("key", "node", F.col("rank.members").alias("members")), reduced)
    # Elements that a node has in common with any one of a component are no more than it meets the component at; of
    # two light sets the subsets tell how many.
    visits = seen.groupBy("node", "target").agg(F.count_if(F.col("weight") == SUBSET).alias("subsets"), F.count_if(F.col("weight") != SUBSET).alias("elements"))
    front = F.greatest(F.col("elements"), F.when(F.col("subsets") > 0, F.floor((1 + F.sqrt(1 + 8 * F.col("subsets"))) / 2)).otherwise(0))
    spans = reduced.groupBy(F.col("root").alias("target")).agg(F.min("size").alias("low"), F.max("size").alias("high"))
    visits = visits.join(reduced.select("node", "size"), "node").join(spans, "target")
    size, low, high = F.col("size"), F.greatest("low", F.ceil(F.col("size") * PERCENT / 100)), F.least("high", F.floor(F.col("size") * 100 / PERCENT))
    visits = visits.where((low <= high) & (front >= least_in_range(size, low, high))).select("node", "target")
    visits = save(visits.union(dense).distinct(), "visits")
    drop(lists)
    drop(ranked)
    members = save(reduced.select("node", "root").join(visits.select(F.col("target").alias("root")).distinct(), "root", "left_semi"), "members")
    sets = save(known(visits.select("node").union(members.select("node"))), "sets")
    found = verify_blocks(visits, members, sets).distinct().join(reduced.select("node", "root"), "node")
    more = save(found.select(F.col("root").alias("a"), F.col("target").alias("b")).distinct(), "links")
    for t in (sets, visits, members, reduced):
        drop(t)
    # Components whose nodes link become one; a root that no leader had linked is a component of itself.
    over = components(more).select(F.col("node").alias("below"), F.col("root").alias("over"))
    alone = over.join(roots, F.col("below") == F.col("node"), "left_anti").select(F.col("below").alias("node"), F.col("below").alias("root"))
    roots = roots.union(alone).join(over, F.col("root") == F.col("below"), "left").select("node", F.coalesce("over", "root").alias("root"))
    best = roots.join(nodes, "node").groupBy("root").agg(F.min("doc_id").alias("component"))
    label = roots.join(best, "root").select("node", "component")
    copies = nodes.where("copies > 1").select("node", F.col("doc_id").alias("own"))
    label = label.join(copies, "node", "full").select(F.col("node").alias("l_node"), F.coalesce("component", "own").alias("component"))
    out = table.select("doc_id", "n", "node").join(label, (F.col("node") == F.col("l_node")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, one with the smallest id. Rows without words are components of their own. Where
    ids are null or repeated they do not tell rows apart, so the rows are numbered in a written copy first."""
    if not docs.groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("n")).where("n > 1 or id is null").limit(1).count():
        found = near_duplicates(docs, id_col, text_col).where("doc_id = component_id")
        return docs.join(found.select(F.col("doc_id").alias(_own_name(docs))), F.col(id_col) == F.col(_own_name(docs)), "left_semi")
    own = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("own_row")
    rows = docs.select(F.monotonically_increasing_id().alias("row_number"), F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), own)
    rows = save(rows, "numbered")
    found = near_duplicates(rows, "row_number", "text").select(F.col("doc_id").alias("row_number"), "component_id")
    order = F.struct(F.col("own_id").isNull(), F.col("own_id"), F.col("row_number"))
    first = found.join(rows.select("row_number", "own_id"), "row_number").groupBy("component_id").agg(F.min_by("row_number", order).alias("row_number"))
    return rows.join(first, "row_number", "left_semi").select("own_row.*")


def _own_name(docs: DataFrame) -> str:
    """A name that no column of docs has."""
    return "_".join(["kept", *docs.columns])


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
