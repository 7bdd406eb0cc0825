r"""N-gram Jaccard join (operator 9): groups of similar documents and a token-group matrix.

Two documents link if their sets of five-word shingles have a Jaccard similarity of at least 0.8.
The result is exact up to equal 64-bit shingle hashes; no candidate, partner or bucket is cut off.

1. Documents with equal sets are one node.  A node's group is chosen by its smallest shingle (the
   smallest that isn't known to be common, if at least half of the set isn't): similar documents
   mostly agree on it.  Within a partition, nodes of a group that are similar to one of its leaders
   are linked to it on the spot; what is left of a group is joined exactly, GROUP nodes at a time.
2. Groups are merged along the links that were found; a group is now a connected part.
3. Token-group matrix: each set has a prefix of its tokens, common tokens last, which any partner
   must share LEAST tokens of.  Rare tokens, in at most LONG_LIST prefixes, take a plain
   prefix-filter join: each pair of a list is made, as that is at most LONG_LIST nodes wide, and
   pairs with LEAST shared tokens are compared one by one.  Only nodes of longer lists are
   stacked in blocks (a large part's by themselves); a block asks the blocks that share a token.
4. What is asked is opened unless both ends are in one group: a block has the union of its members'
   tokens; a query whose overlap with the union is too small skips the block, others are compared
   with the members.

Texts travel once by group and once by id, compressed, and only lists of tokens besides.

Defined results: null or wordless texts have an empty set, link with nothing and are their own
component; texts of fewer than five words are one shingle; rows that repeat an id or a text are rows
of their own; a null id never names a component unless all ids of the component are null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridia.operators.components import connected_components

from .common import file_backed, hash_words, lean, materialise, mix64, numbered, remove, slices, uniform, with_row_number

WORDS = 5
#: Similarity as a fraction: NUM / DEN.
NUM, DEN = 4, 5
#: Prefix tokens that two similar sets share at least (no more than the smallest set that can have a partner needs).
LEAST = 3
SMALLEST = 4
#: Documents looked at to learn common shingles, and how many of them have a common one. This and the
#: next two only decide the order of tokens and the choice of groups, never which links are found.
SAMPLE_DOCS, SAMPLE_COMMON = 10_000, 20
COMMON, MOST_COMMON = 32, 1_000_000
#: Longer token lists are taken up group by group.
LONG_LIST = 64
LOCAL_LEADERS = 8
BLOCK = 512
#: A group is joined in portions of so many nodes; pairs of different portions are left to the token lists.
GROUP = 1024
#: Groups whose only common ground is a shingle known to be common are dealt to so many keys.
SPREAD = 64
#: Documents for each bucket of token lists, where there are many.
BUCKET_DOCS = 100_000
#: Components of so many nodes have blocks of their own.
OWN_BLOCKS = 64

_K = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1) for j in range(WORDS)]
_LOW40 = np.uint64((1 << 40) - 1)


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text (bytes in lower case)."""
    words, at = hash_words(texts)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(words) - WORDS + 1), dtype=np.uint64)
        for j in range(WORDS):
            runs += words[j : len(words) - WORDS + 1 + j] * _K[j] if len(runs) else np.zeros(0, np.uint64)
        runs = mix64(runs)
        out = []
        for a, b in zip(at, at[1:]):
            if b - a >= WORDS:
                out.append(np.unique(runs[a : b - WORDS + 1]))
            elif b > a:
                out.append(mix64(np.array([sum(int(words[a + j]) * int(_K[j]) for j in range(b - a)) + int(b - a) & (1 << 64) - 1], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def needed(n: int) -> int:
    """Tokens that a set of n shares with any partner at least."""
    return -(-NUM * n // DEN)


def similar(n: int, m: int, common: int) -> bool:
    return DEN * common >= NUM * (n + m - common)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    k = np.searchsorted(y, x)
    return int((y[np.minimum(k, len(y) - 1)] == x).sum()) if len(y) else 0


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    n, m = len(x), len(y)
    return DEN * min(n, m) >= NUM * max(n, m) and similar(n, m, overlap(x, y))


def member_of(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted array."""
    if not len(among):
        return np.zeros(len(x), dtype=bool)
    k = np.searchsorted(among, x)
    return among[np.minimum(k, len(among) - 1)] == x


def prefix(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The tokens of a set that are looked up. common: low 40 bits of the tokens that come last, sorted."""
    n = len(tokens)
    late = member_of(tokens & _LOW40, common)
    return np.concatenate([tokens[~late], tokens[late]])[: n - needed(n) + LEAST]


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def pairs_in_runs(start: np.ndarray, length: np.ndarray, most: int = 4_000_000):
    """Index pairs (i < j) inside runs of a sorted array, in portions."""
    for n in np.unique(length):
        n = int(n)
        if n < 2:
            continue
        first, (i, j) = start[length == n], np.triu_indices(n, 1)
        step = max(1, most // len(i))
        for k in range(0, len(first), step):
            at = first[k : k + step, None]
            yield (at + i).ravel(), (at + j).ravel()


def local_join(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of the sets given: exact, in memory."""
    n, out = len(sets), []
    parts = Union(n)
    if n <= 6:
        return [(i, j) for i in range(n) for j in range(i) if parts.find(i) != parts.find(j) and linked(sets[i], sets[j]) and parts.join(i, j)]
    leaders: list[int] = []
    for i in range(n):
        k = next((k for k in leaders[:LOCAL_LEADERS] if linked(sets[i], sets[k])), None)
        if k is None:
            leaders.append(i)
        else:
            parts.join(i, k)
            out.append((i, k))
    if all(parts.find(i) == parts.find(0) for i in range(n)):
        return out
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), size)
    tokens, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((which, count[which], owner))  # each set's tokens, rare ones first
    place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    kept = place < np.repeat([max(0, s - needed(s) + LEAST) if s >= SMALLEST else 0 for s in size], size)
    tok, own = which[order][kept], owner[order][kept]
    by = np.lexsort((own, tok))
    tok, own = tok[by], own[by]
    if not len(tok):
        return out
    start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    length = np.diff(np.append(start, len(tok)))
    root = np.array([parts.find(i) for i in range(n)])
    shared, held, waiting = np.zeros(n * n, dtype=np.int64), [], 0  # n is GROUP at most

    def count():
        nonlocal held, waiting
        if held:
            pair, times = np.unique(np.concatenate(held), return_counts=True)
            shared[pair] += times
        held, waiting = [], 0

    for i, j in pairs_in_runs(start, length):
        a, b = own[i], own[j]
        use = (root[a] != root[b]) & (DEN * np.minimum(size[a], size[b]) >= NUM * np.maximum(size[a], size[b]))
        held.append(a[use] * n + b[use])
        waiting += len(held[-1])
        if waiting > 4_000_000:
            count()
    count()
    for p in np.flatnonzero(shared >= LEAST).tolist():
        i, j = divmod(p, n)
        if parts.find(i) != parts.find(j) and linked(sets[i], sets[j]):
            parts.join(i, j)
            out.append((i, j))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _digest(x: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix64(x ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64), mix64(x + np.uint64(0x1234567DEADC0DE)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _mixed(x: int) -> int:
    return int(mix64(np.array([x & (1 << 64) - 1], dtype=np.uint64))[0])


def _signed_int(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _batch(columns: dict, doc_type) -> pa.RecordBatch:
    kinds = {"kind": pa.int8(), "key": pa.int64(), "rid": pa.int64(), "doc": doc_type, "n": pa.int32(), "d1": pa.int64(), "d2": pa.int64(), "other": pa.int64(), "packed": pa.binary()}
    n = max(len(v) for v in columns.values())
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))


#: Kinds of rows of the first table: documents, nodes (with text), links.
DOC, NODE, LINK = 0, 1, 2


def _whole_sets(batch):
    texts = batch.column(0).cast(pa.binary()).to_pylist()
    for a, b in slices(texts):
        yield from shingle_sets([(x or b"").lower() for x in texts[a:b]])


def _prefix_ends(batch):
    """Rather more of each set's smallest tokens than its prefix will have."""
    for x in unpack_each(batch.column(0).to_pylist()):
        yield x[: (3 * (len(x) - needed(len(x)) + LEAST) + 1) // 2]


def _first(steer):
    """Cuts texts into sets; links nodes to leaders within the partition. steer: a broadcast of common tokens."""

    def run(batches):
        common = steer.value
        squeeze = zstandard.ZstdCompressor(level=3)
        seen: set[tuple[int, int]] = set()
        leaders: dict[int, list[tuple[int, np.ndarray]]] = {}
        held = 0
        for batch in batches:
            doc_type = batch.schema.field("doc").type
            rids, docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
            for a, b in slices(texts):
                low = [(x or b"").lower() for x in texts[a:b]]
                sets = shingle_sets(low)
                digests = [_digest(x) if len(x) else (0, 0) for x in sets]
                spread = _signed(mix64(np.array(rids[a:b], dtype=np.int64).view(np.uint64)))
                yield _batch({"kind": [DOC] * (b - a), "key": spread, "rid": rids[a:b], "doc": docs[a:b], "n": [len(x) for x in sets], "d1": [d[0] for d in digests], "d2": [d[1] for d in digests]}, doc_type)
                new = {k: [] for k in ("key", "rid", "n", "d1", "d2", "other", "packed")}
                for rid, x, d, text in zip(rids[a:b], sets, digests, low):
                    if not len(x) or d in seen:
                        continue
                    seen.add(d)
                    own = x[~member_of(x & _LOW40, common)]
                    first = int((own if 2 * len(own) >= len(x) else x)[0])
                    mates = leaders.setdefault(first, [])
                    leader = next((r for r, y in mates if linked(x, y)), None)
                    if leader is None and len(mates) < LOCAL_LEADERS:
                        mates.append((rid, x))
                        held += len(x)
                    if leader is not None:
                        key = _mixed(d[0])
                    else:
                        key = first if 2 * len(own) >= len(x) else _mixed(first + _mixed(d[0]) % SPREAD)
                    for k, v in zip(new, (_signed_int(key), rid, len(x), *d, leader, squeeze.compress(text))):
                        new[k].append(v)
                if new["rid"]:
                    yield _batch({"kind": [NODE] * len(new["rid"]), **new}, doc_type)
                if held > 4_000_000:  # bounds the memory; what is forgotten meets in the next step
                    leaders, seen, held = {}, set(), 0

    return run


@dataclass
class Node:
    rid: int
    n: int
    d: tuple[int, int]
    leader: int | None
    packed: bytes


def unpack_each(packed: list[bytes]):
    grow = zstandard.ZstdDecompressor()
    for a, b in slices(packed, 1 << 18):
        yield from shingle_sets([grow.decompress(x) for x in packed[a:b]])


def unpack(packed: list[bytes]) -> list[np.ndarray]:
    return list(unpack_each(packed))


def _grouped(batches):
    """Rows come sorted by key and digest: joins what is left of each group, GROUP nodes at a time. A node that was linked
    to a leader has a key of its own, and so has each portion of a group."""

    def finish(key: int, rest: list[Node], links: list[tuple[int, int]]):
        links = links + [(x.rid, x.leader) for x in rest if x.leader is not None]
        heads = [x for x in rest if x.leader is None]
        if len(heads) > 1:
            links += [(heads[i].rid, heads[j].rid) for i, j in local_join(unpack([x.packed for x in heads]))]
        own = [key if x.leader is None else x.rid ^ 0x5BD1E995 for x in rest]
        yield {"kind": [NODE] * len(rest), "key": own, "rid": [x.rid for x in rest], "n": [x.n for x in rest], "d1": [x.d[0] for x in rest], "d2": [x.d[1] for x in rest], "packed": [x.packed for x in rest]}
        if links:
            yield {"kind": [LINK] * len(links), "rid": [a for a, _ in links], "other": [b for _, b in links]}

    at, portion, nodes, links, doc_type = None, 0, [], [], pa.int64()
    for batch in batches:
        doc_type = batch.schema.field("doc").type
        kind = batch.column("kind").to_numpy()
        if (kind == DOC).any():
            yield batch.filter(pa.array(kind == DOC))
        rows = batch.filter(pa.array(kind == NODE))
        out: list[dict] = []
        for key, rid, n, d1, d2, other, packed in zip(*(rows.column(c).to_pylist() for c in ("key", "rid", "n", "d1", "d2", "other", "packed"))):
            if key == at and nodes[-1].d == (d1, d2):  # an equal set is the same node
                links.append((rid, nodes[-1].rid))
                if other is not None:
                    links.append((rid, other))
                continue
            if nodes and (key != at or len(nodes) >= GROUP):
                out += finish(at if not portion else _signed_int(_mixed(at + portion)), nodes, links)
                portion, nodes, links = portion + 1 if key == at else 0, [], []
            at = key
            nodes.append(Node(rid, n, (d1, d2), other, packed))
        for part in _stack(out):
            yield _batch(part, doc_type)
    for part in _stack(list(finish(at if not portion else _signed_int(_mixed(at + portion)), nodes, links)) if nodes else []):
        yield _batch(part, doc_type)


def _stack(parts: list[dict]):
    for kind in (NODE, LINK):
        same = [p for p in parts if p["kind"][0] == kind]
        if same:
            yield {k: [v for p in same for v in p[k]] for k in same[0]}


def _counted(least: int):
    """Sums packed counts of tokens: rows (bucket, ones, many, counts) sorted by bucket."""

    def run(batches):
        def finish(ones, many, counts):
            value = np.concatenate([_wide(b"".join(ones)), np.frombuffer(b"".join(many), np.uint64)])
            count = np.concatenate([np.ones(len(value) - len(b"".join(many)) // 8, np.int64), np.frombuffer(b"".join(counts), np.uint32).astype(np.int64)])
            token, which = np.unique(value, return_inverse=True)
            total = np.bincount(which, weights=count, minlength=len(token)).astype(np.int64)
            hot = total > least
            return pa.RecordBatch.from_arrays([pa.array(token[hot].astype(np.int64)), pa.array(total[hot])], names=["token", "n"])

        at, held = None, ([], [], [])
        for batch in batches:
            for bucket, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at and at is not None:
                    yield finish(*held)
                    held = ([], [], [])
                at = bucket
                for store, x in zip(held, blobs):
                    store.append(x)
        if at is not None:
            yield finish(*held)

    return run


def _narrow(x: np.ndarray) -> bytes:
    """40-bit numbers in 5 bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _wide(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def _count_tokens(buckets: int, pick, batches):
    """Packed counts of the tokens that pick(sets) gives, for each partition (or each 2 million of them)."""

    def flush(tokens):
        value, count = np.unique(np.concatenate(tokens) & _LOW40, return_counts=True)
        bucket = (value % np.uint64(buckets)).astype(np.int64)
        rows = []
        for b in np.unique(bucket).tolist():
            v, c = value[bucket == b], count[bucket == b]
            rows.append((b, _narrow(v[c == 1]), v[c > 1].tobytes(), c[c > 1].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "ones", "many", "counts"])

    held, size = [], 0
    for batch in batches:
        for x in pick(batch):
            held.append(x)
            size += len(x)
            if size > 2_000_000:
                yield flush(held)
                held, size = [], 0
    if size:
        yield flush(held)


def _common_tokens(df: DataFrame, pick, least: int, buckets: int) -> np.ndarray:
    """Low 40 bits of the tokens that more than `least` of the picked sets have, the MOST_COMMON commonest at most (a fixed bound), sorted."""
    blocks = df.mapInArrow(lean(lambda it: _count_tokens(buckets, pick, it)), "bucket int, ones binary, many binary, counts binary")
    found = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_counted(least)), "token bigint, n bigint")
    top = found.orderBy(F.desc("n"), "token").limit(MOST_COMMON).select("token").toPandas()
    return np.sort(top["token"].to_numpy(dtype=np.int64).astype(np.uint64))


def _postings(shipped, buckets: int):
    """Prefix tokens by bucket, packed: tokens, which node has them, and the nodes' ids, sizes and groups."""

    def run(batches):
        def flush(held):
            count = np.array([len(p) for p, *_ in held])
            token = np.concatenate([p for p, *_ in held])
            owner = np.repeat(np.arange(len(held)), count)
            bucket = (token >> np.uint64(7)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            token, owner, bucket = token[order], owner[order], bucket[order]
            rid, n, key = (np.array([h[k] for h in held], dtype=np.int64) for k in (1, 2, 3))
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            rows = {k: [] for k in ("bucket", "token", "owner", "rid", "n", "key")}
            for a, b in zip(cut, np.append(cut[1:], len(bucket))):
                used, where = np.unique(owner[a:b], return_inverse=True)
                values = (int(bucket[a]), token[a:b].tobytes(), where.astype(np.uint32).tobytes(), rid[used].tobytes(), n[used].astype(np.uint32).tobytes(), key[used].tobytes())
                for k, v in zip(rows, values):
                    rows[k].append(v)
            return pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *(pa.array(rows[k], pa.binary()) for k in list(rows)[1:])], names=list(rows))

        late, held, size = shipped.value, [], 0
        for batch in batches:
            rid, n, key, packed = (c.to_pylist() for c in batch.columns)
            for i, x in enumerate(unpack_each(packed)):
                p = prefix(x, late)
                held.append((p, rid[i], n[i], key[i]))
                size += len(p)
                if size > 1_000_000:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _listed(batches):
    """From packed postings, sorted by bucket: pairs of nodes (a, b, shared) from short lists, and rows (a, token) of long ones."""

    def finish(blocks):
        count = [len(b[1]) // 8 for b in blocks]
        nodes = np.cumsum([0, *(len(b[3]) // 8 for b in blocks)])
        token = np.frombuffer(b"".join(b[1] for b in blocks), np.uint64)
        owner = np.frombuffer(b"".join(b[2] for b in blocks), np.uint32).astype(np.int64) + np.repeat(nodes[:-1], count)
        rid, key = (np.frombuffer(b"".join(b[k] for b in blocks), np.int64) for k in (3, 5))
        n = np.frombuffer(b"".join(b[4] for b in blocks), np.uint32).astype(np.int64)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(start, len(token)))
        short = (length > 1) & (length <= LONG_LIST)
        ids, which = np.unique(rid, return_inverse=True)
        found = []
        for i, j in pairs_in_runs(start[short], length[short]):
            a, b = owner[i], owner[j]
            use = (key[a] != key[b]) & (DEN * np.minimum(n[a], n[b]) >= NUM * np.maximum(n[a], n[b]))
            a, b = which[a[use]], which[b[use]]
            found.append(np.minimum(a, b) * len(ids) + np.maximum(a, b))
        pair, shared = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(pair):
            yield pa.RecordBatch.from_arrays([pa.array(ids[pair // len(ids)]), pa.array(ids[pair % len(ids)]), pa.array(shared.astype(np.int64)), pa.nulls(len(pair), pa.int64())], names=["a", "b", "shared", "token"])
        long = np.repeat(length > LONG_LIST, length)
        if long.any():
            k = int(long.sum())
            yield pa.RecordBatch.from_arrays([pa.array(rid[owner[long]]), pa.nulls(k, pa.int64()), pa.array(n[owner[long]]), pa.array(token[long].view(np.int64))], names=["a", "b", "shared", "token"])

    at, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != at and held:
                yield from finish(held)
                held = []
            at = row[0]
            held.append(row)
    if held:
        yield from finish(held)


def _neighbours(batches):
    """Rows (token, big, part, chunk), each once, sorted by token: pairs of blocks that have a token in common."""

    def finish(blocks, total):
        blocks = sorted(blocks)
        for i, x in enumerate(blocks):
            for y in blocks[i:]:
                if not (x[0] and x[:2] == y[:2]):  # blocks of one component have nothing to ask each other
                    total.add((*x, *y))

    def batch_of(total):
        rows = list(total)
        kinds = [pa.bool_(), pa.int64(), pa.int32()] * 2
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["big", "part", "chunk", "to_big", "to_part", "to_chunk"])

    at, held, total = None, [], set()
    for batch in batches:
        for token, *block in zip(*(c.to_pylist() for c in batch.columns)):
            if token != at and held:
                finish(held, total)
                held = []
                if len(total) > 200_000:
                    yield batch_of(total)
                    total = set()
            at = token
            held.append(tuple(block))
    if held:
        finish(held, total)
    if total:
        yield batch_of(total)


class Block:
    """Members (id, component, packed text): their tokens in one sorted array, and its union."""

    def __init__(self, members):
        sets = unpack([m[2] for m in members])
        self.rid = np.array([m[0] for m in members], dtype=np.int64)
        self.part = np.array([m[1] for m in members], dtype=np.int64)
        self.size = np.array([len(s) for s in sets])
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(token, kind="stable")
        self.token, self.owner = token[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], self.token[1:] != self.token[:-1]]))
        self.union, self.start, self.end = self.token[first], first, np.append(first[1:], len(token))
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.up.get(x, x) != x:
            x = self.up[x]
        return x

    def links(self, rid: int, part: int, q: np.ndarray) -> list[tuple[int, int]]:
        """Links of a query that join components."""
        k = np.searchsorted(self.union, q)
        k = k[self.union[np.minimum(k, len(self.union) - 1)] == q]
        if len(k) < needed(len(q)):
            return []
        count = self.end[k] - self.start[k]
        at = np.repeat(self.start[k] - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = np.bincount(self.owner[at], minlength=len(self.size))
        good = (DEN * common >= NUM * (len(q) + self.size - common)) & (self.part != part)
        out = []
        for i in np.flatnonzero(good):
            a, b = self.find(part), self.find(int(self.part[i]))
            if a != b:
                self.up[max(a, b)] = min(a, b)
                out.append((rid, int(self.rid[i])))
        return out


def _opened(batches):
    """Rows by block, members (role 0) before queries: links between components."""
    at, members, queries, block = None, [], [], None

    def answer():
        nonlocal block, members, queries
        if block is None and members:
            block, members = Block(members), []
        found = []
        if block is not None and queries:
            for (rid, part, _), q in zip(queries, unpack([x[2] for x in queries])):
                found += block.links(rid, part, q)
        queries = []
        return found

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["u", "v"])

    for batch in batches:
        out = []
        for big, part, chunk, role, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (big, part, chunk) != at:
                out += answer()
                at, members, block = (big, part, chunk), [], None
            (members if role == 0 else queries).append(tuple(row))
            if len(queries) >= 256:
                out += answer()
        yield batch_of(out)
    yield batch_of(answer())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: rid (with_row_number), id_col, n_shingles, component_id (the
    smallest id reachable by links), label (of the component; null without shingles), materialised
    up to the last joins. Components can share a component_id, where ids repeat or are null, but no label."""
    return _near_duplicates(with_row_number(file_backed(docs)), id_col, text_col)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates of rows that have a rid."""
    spark = docs.sparkSession
    n_docs = docs.select(id_col).count()
    buckets = max(512, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_docs // BUCKET_DOCS)
    doc_kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select("rid", F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))

    # shingles that are common in a bounded sample only steer the choice of groups
    sample = docs.where(uniform(id_col) < min(1.0, SAMPLE_DOCS / max(1, n_docs))).select(F.col(text_col).cast("string").alias("text"))
    steer = spark.sparkContext.broadcast(_common_tokens(sample, _whole_sets, SAMPLE_COMMON, 64))
    schema = f"kind tinyint, key bigint, rid bigint, doc {doc_kind}, n int, d1 bigint, d2 bigint, other bigint, packed binary"
    first = texts.mapInArrow(lean(_first(steer)), schema)
    table = materialise(first.repartition("key").sortWithinPartitions("key", "d1", "d2", "rid").mapInArrow(lean(_grouped), schema), "groups")
    nodes, links = table.where(F.col("kind") == NODE), table.where(F.col("kind") == LINK).select(F.col("rid").alias("u"), F.col("other").alias("v"))
    parts = connected_components(links)

    able = nodes.where(F.col("n") >= SMALLEST)

    common = spark.sparkContext.broadcast(_common_tokens(able.select("packed"), _prefix_ends, COMMON, buckets))  # MOST_COMMON numbers at most
    posted = able.select("rid", "n", "key", "packed").mapInArrow(lean(_postings(common, buckets)), "bucket int, token binary, owner binary, rid binary, n binary, key binary")
    lists = materialise(posted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_listed), "a bigint, b bigint, shared bigint, token bigint"), "lists")

    def part_of(df: DataFrame, rid: str, name: str) -> DataFrame:
        right = parts.select(F.col("node").alias(rid), F.col("component").alias(name))
        return df.join(right, rid, "left").withColumn(name, F.coalesce(name, rid))

    # Rare tokens: pairs of nodes. A pair that shares a token of a long list is met below, so here LEAST rare ones are needed.
    pairs = lists.where("b is not null").groupBy("a", "b").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= LEAST)
    pairs = part_of(part_of(pairs, "a", "part_a"), "b", "part_b").where("part_a != part_b").select("a", "b", "part_a", "part_b")
    pairs = materialise(pairs, "pairs")

    # Tokens of long lists: their nodes are stacked in blocks, those of a large component by themselves,
    # the others with nodes that have the same tokens (the label is the smallest token two steps away).
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    hot = lists.where("b is null").select(F.col("a").alias("rid"), "token")
    near = hot.groupBy("rid").agg(F.min("token").alias("label"))
    for _ in range(2):
        of_token = hot.join(near, "rid").groupBy("token").agg(F.min("label").alias("label"))
        near = hot.join(of_token, "token").groupBy("rid").agg(F.min("label").alias("label"))
    near = part_of(near, "rid", "component").join(sizes, "component", "left")
    near = near.withColumn("big", F.coalesce(F.col("size") >= OWN_BLOCKS, F.lit(False)))
    near = near.withColumn("part", F.when(F.col("big"), F.col("component")).otherwise(F.col("label"))).select("rid", "component", "big", "part")
    chunks = near.groupBy("big", "part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    near = near.join(chunks, ["big", "part"]).withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("chunks")).cast("int"))
    near = materialise(near.select("rid", "component", "big", "part", "chunk"), "blocks")
    having = hot.join(near, "rid").select("token", "big", "part", "chunk").distinct()
    ask = "big boolean, part bigint, chunk int, to_big boolean, to_part bigint, to_chunk int"
    asked = having.repartition("token").sortWithinPartitions("token").mapInArrow(lean(_neighbours), ask).distinct()
    queries = near.join(asked, ["big", "part", "chunk"]).select(F.col("to_big").alias("big"), F.col("to_part").alias("part"), F.col("to_chunk").alias("chunk"), F.lit(1).alias("role"), "rid", "component")
    rows = near.where("not big").select("big", "part", "chunk", F.lit(0).alias("role"), "rid", "component").unionByName(queries)
    rows = rows.unionByName(near.where("big").select("big", "part", "chunk", F.lit(0).alias("role"), "rid", "component"))
    for rid, part, role in (("a", "part_a", 0), ("b", "part_b", 1)):
        each = pairs.select(F.lit(None).cast("boolean").alias("big"), F.col("a").alias("part"), F.lit(-1).alias("chunk"), F.lit(role).alias("role"), F.col(rid).alias("rid"), F.col(part).alias("component"))
        rows = rows.unionByName(each.distinct() if role == 0 else each)
    open_ = rows.join(able.select("rid", "packed"), "rid").select("big", "part", "chunk", "role", "rid", "component", "packed")
    more = open_.repartition("big", "part", "chunk").sortWithinPartitions("big", "part", "chunk", "role").mapInArrow(lean(_opened), "u bigint, v bigint")
    # whole components: the parts found first, and the links between them
    more = more.union(parts.select(F.col("node").alias("u"), F.col("component").alias("v")))
    whole = connected_components(more)
    for t in (lists, pairs, near):
        remove(t)

    rows = table.where(F.col("kind") == DOC)
    least = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("doc").alias("doc"))
    label = nodes.select("rid", "d1", "d2").join(whole.withColumnRenamed("node", "rid"), "rid", "left")
    label = label.groupBy("d1", "d2").agg(F.min(F.coalesce("component", "rid")).alias("label"))
    named = least.join(label, ["d1", "d2"])
    of_label = named.groupBy("label").agg(F.min("doc").alias("least"))
    named = materialise(named.join(of_label, "label").select("d1", "d2", "label", "least"), "named")
    out = rows.select("rid", "doc", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc"))
    return out.select("rid", F.col("doc").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"), "label")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id (null after all others), the first
    of its rows. Rows that link with nothing, empty ones too, all stay, whatever their ids."""
    rows = numbered(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    found = _near_duplicates(rows.select("rid", F.col(f"row.`{id_col}`").alias(id_col), F.col(f"row.`{text_col}`").alias(text_col)), id_col, text_col)
    alone = found.where("n_shingles = 0").select("rid")
    best = found.where("n_shingles > 0").groupBy("label").agg(F.min(F.struct(F.col(id_col).isNull().alias("unnamed"), F.col(id_col).alias("id"), "rid")).alias("best"))
    keep = materialise(alone.union(best.select("best.rid")), "kept")
    return rows.join(keep, "rid", "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def report(docs: DataFrame, **how) -> DataFrame:
    return near_duplicates(docs, **how).select("doc_id", "n_shingles", "component_id")


REPORT_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id
"""
