"""N-gram Jaccard join: count vectors of shingle groups, R-trees over them, exact checks.

A document is its set of 5-word shingles (64-bit hashes). Shingles are hashed into groups;
the counts of a document's groups are a point. R-trees over such points, bulk-loaded by
splits at the median of the coordinate with the widest spread, find every candidate pair:
a node is entered only if the sum of the coordinates' minima reaches the overlap that the
smallest sizes demand, and so is each point. What comes out is verified on whole sets.

One tree over all points would be one task, so points are dealt first. By size, documents
fall into levels, and a level has so many coarse groups that two linked sets, which differ
in few shingles, hold the same shingles in at least one of them. All documents with equal
contents of a group belong to one bundle, named by the smallest of them. Each document
needs only its smallest bundles: linked sets share several groups, how many at least follows
from size and empty groups. A group content that a sizeable share of all documents has is
found while the sets are surveyed, and its bundle is known before anything is dealt, so that
no task sees all of its documents. Large bundles are searched in blocks.

Only components are asked for, so most pairs need no check. Three searches of the trees
follow one another, on bundles with several labels only: each document's smallest candidate,
its nearest one, and last all candidate pairs with different labels. After each, links
are verified and linked documents get a common label; a bundle with one label is done.

Documents with the same set are linked at once by its digest; one of them goes on. Null or
empty text, or text without words: no shingles, no links. Fewer than five words: the whole
sequence is one shingle. Very long texts: whole, with more groups; blocks of them are smaller.
A null doc_id: no links, null component_id. Rows with one id are one vertex with all their
texts' links. Ties go to the smaller id. Repeated rows: each has a result row. Further
columns, also of clashing names, are passed over. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadweave.llm.common import batch_slices, broadcast_if_small, give_back, materialize, pick, release
from leadweave.llm.words import gram_hashes, mix64, words

SHINGLE, PERCENT = 5, 80
SIGNATURES_A_BUCKET, MIN_BUCKETS = 600_000, 64
NODE, FINE = 32, 4  # points of a leaf; coordinates for each group
BLOCK, BLOCK_BYTES, PART_BYTES = 1024, 8 << 20, 8 << 20  # points of a block; their bytes; bytes of a task's group
#: A group content is hot if batches with so many documents that have it make up this share of all.
HOT_BATCH, HOT_SHARE = 16, 200
SEARCHES = ("first", "nearest", "all")


def level_bounds(top: int = 1 << 40) -> np.ndarray:
    """Smallest set size of each level; partners of a set are in its level or the next."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, -(-out[-1] * 3 // 2)))
    return np.array(out, dtype=np.int64)


LEVELS = level_bounds()
#: Linked sets of a level differ in (a + b) / 9 shingles at most; a quarter more groups than
#: needed leaves room for empty ones.
_MOST = 2 * (LEVELS[1:] - 1) * (100 - PERCENT) // (100 + PERCENT)
GROUPS = _MOST + 1 + (_MOST + 1) // 4 + 1
SLACK = GROUPS - _MOST - 1  # a set with more empty groups than this lists those too


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All texts' shingle hashes, sorted and once in each text, and where each text's begin."""
    count = np.array([len(t.split()) for t in texts], dtype=np.int64)
    _, _, h = words(b"\n".join(texts), lower=True)
    first, own = np.cumsum(count) - count, np.maximum(count - shingle + 1, 0)
    owner = np.repeat(np.arange(len(texts)), own)
    at = first[owner] + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    value = gram_hashes(h, shingle)[at] if len(at) else np.zeros(0, dtype=np.uint64)
    short = np.flatnonzero((count > 0) & (count < shingle))
    if len(short):
        whole = np.array([np.uint64(int.from_bytes(hashlib.blake2b(h[first[i] : first[i] + count[i]].tobytes(), digest_size=8).digest(), "little")) for i in short])
        owner, value = np.r_[owner, short], np.r_[value, whole]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])] if len(value) else np.zeros(0, dtype=bool)
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def levels_of(n: np.ndarray) -> np.ndarray:
    """Level of each set size; -1 without shingles."""
    return np.searchsorted(LEVELS, n, side="right") - 1


def in_next(n: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Whether a set of this size can have a partner in the next level."""
    return (level >= 0) & (n * 100 // PERCENT >= LEVELS[level + 1])


def grouped(value: np.ndarray, cut: np.ndarray, docs: np.ndarray, level: np.ndarray, fine: int = 1):
    """Filled groups of the given sets at the given levels: position in docs, group, count, sum.
    fine: each group is cut into so many."""
    n = cut[docs + 1] - cut[docs]
    owner = np.repeat(np.arange(len(docs)), n)
    v = value[np.repeat(cut[docs], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    group = ((v >> np.uint64(32)) * (fine * GROUPS[level])[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (group[1:] != group[:-1])]) if len(v) else np.zeros(0, dtype=np.int64)
    total = np.add.reduceat(mix64(v), new) if len(v) else v
    return owner[new], group[new], np.diff(np.r_[new, len(v)]), total


def signatures(value: np.ndarray, cut: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the groups of these sets, at all their levels: position in docs, signature, level."""
    n = cut[docs + 1] - cut[docs]
    own = levels_of(n)
    out = []
    for here, level in ((n > 0, own), (in_next(n, own), own + 1)):
        at = np.flatnonzero(here)
        lv = level[at]
        pos, group, _, total = grouped(value, cut, docs[at], lv)
        filled = np.bincount(pos, minlength=len(at))
        for i in np.flatnonzero(GROUPS[lv] - filled > SLACK[lv]):
            empty = np.setdiff1d(np.arange(GROUPS[lv[i]]), group[pos == i])
            pos, group, total = np.r_[pos, np.full(len(empty), i)], np.r_[group, empty], np.r_[total, np.zeros(len(empty), dtype=np.uint64)]
        salt = lv[pos].astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + group.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        out.append((at[pos], mix64(total ^ mix64(salt + np.uint64(1))), lv[pos]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _digests(value: np.ndarray, cut: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def shared_at_least(value: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """How many filled groups each set has in common with any linked one, at least.

    Of a level's groups, those that differ are bounded by the differing shingles, and those
    that are empty in both by the set's own empty ones.
    """
    n = np.diff(cut)
    own, out = levels_of(n), np.full(len(n), np.iinfo(np.int64).max)
    for here, level in ((n > 0, own), (in_next(n, own), own + 1)):
        at = np.flatnonzero(here)
        filled = np.bincount(grouped(value, cut, at, level[at])[0], minlength=len(at))
        partner = np.minimum(LEVELS[level[at] + 1] - 1, n[at] * 100 // PERCENT)
        differ = (n[at] + partner) * (100 - PERCENT) // (100 + PERCENT)
        out[at] = np.minimum(out[at], filled - differ)
    return np.maximum(out, 1)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where rows with other keys than the row before begin, and the end."""
    if not len(keys[0]):
        return np.zeros(1, dtype=np.int64)
    new = np.zeros(len(keys[0]), dtype=bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.r_[np.flatnonzero(new), len(new)]


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to doc_id, set size, digest of the set, and groups shared with partners;
    then signatures that many documents of the batch have: one of them, how many, signature."""
    names = ["doc_id", "n", "digest", "need", "sig"]
    for part in batch_slices(batches, 1):
        value, cut = shingle_sets([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
        rows = part.num_rows
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(cut)), pa.array(_digests(value, cut), pa.binary()), pa.array(shared_at_least(value, cut)), pa.nulls(rows, pa.int64())], names=names)
        doc, sig, _ = signatures(value, cut, np.flatnonzero(part.column(0).is_valid().to_numpy(zero_copy_only=False)))
        sig, at, many = np.unique(sig, return_index=True, return_counts=True)
        hot = many >= HOT_BATCH
        if hot.any():
            ids = part.column(0).drop_null().take(pa.array(doc[at[hot]]))
            k = int(hot.sum())
            yield pa.RecordBatch.from_arrays([ids, pa.array(many[hot]), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), pa.array(sig[hot].view(np.int64))], names=names)


def _dealt(buckets: int, hot_sig: np.ndarray, hot_lead: np.ndarray):
    """(doc_id, text) to rows of one bucket: signatures, each document's number of them, ids.

    Hot signatures (sorted) have known leads: their bundles' members come as they are, with n = -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batch_slices(batches, 1):
            ids = part.column(0).to_numpy(zero_copy_only=False)
            value, cut = shingle_sets([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
            first: dict[bytes, int] = {}
            for i, g in sorted(enumerate(_digests(value, cut)), key=lambda x: ids[x[0]]):
                first.setdefault(g, i)
            docs = np.array(sorted(first.values()), dtype=np.int64)
            doc, sig, level = signatures(value, cut, docs)
            out = []
            if len(hot_sig):
                at = np.minimum(np.searchsorted(hot_sig, sig), len(hot_sig) - 1)
                is_hot = hot_sig[at] == sig
                if is_hot.any():
                    members = _members(hot_lead[at[is_hot]], level[is_hot], ids[docs[doc[is_hot]]])
                    for s in range(0, len(members[0]), 4096):
                        data = np.stack([x[s : s + 4096] for x in members]).astype(np.int64)
                        out.append((int(data[2, 0]) % buckets, -1, data.shape[1], data.tobytes()))
                    doc, sig, level = doc[~is_hot], sig[~is_hot], level[~is_hot]
            bucket = (sig % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((doc, bucket))
            doc, sig, level, bucket = doc[order], sig[order] // np.uint64(buckets), level[order], bucket[order]
            edges = _runs(bucket)
            for a, b in zip(edges[:-1], edges[1:]):
                who, many = np.unique(doc[a:b], return_counts=True)
                low, high = sig[a:b].astype(np.uint32), (sig[a:b] >> np.uint64(32) & np.uint64(1023)) << np.uint64(6) | np.minimum(level[a:b], 63).astype(np.uint64)
                data = low.tobytes() + high.astype(np.uint16).tobytes() + many.astype(np.uint32).tobytes() + ids[docs[who]].astype(np.int64).tobytes()
                out.append((int(bucket[a]), int(b - a), len(who), data))
            if out:
                b_, n_, w_, d_ = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(b_, pa.int64()), pa.array(n_, pa.int32()), pa.array(w_, pa.int32()), pa.array(d_, pa.binary())], names=["bucket", "n", "docs", "data"])

    return run


def _members(lead: np.ndarray, level: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """lead, level, doc, and how often, each once."""
    order = np.lexsort((doc, level, lead))
    lead, level, doc = lead[order], level[order], doc[order]
    cut = _runs(lead, level, doc)
    return lead[cut[:-1]], level[cut[:-1]], doc[cut[:-1]], np.diff(cut)


def _bundles(t: pa.Table) -> pa.Table:
    """Members of bundles from one bucket: lead (the smallest document of a signature), level,
    document, and how many signatures put it there. A signature of one document makes none."""
    give_back()
    sig, ids, known = [], [], []
    for n, m, data in zip(t.column("n").to_pylist(), t.column("docs").to_pylist(), t.column("data").to_pylist()):
        if n < 0:
            known.append(np.frombuffer(data, np.int64).reshape(4, m))
            continue
        low, high = np.frombuffer(data, np.uint32, n), np.frombuffer(data, np.uint16, n, 4 * n)
        many = np.frombuffer(data[6 * n : 6 * n + 4 * m], np.uint32)
        sig.append(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
        ids.append(np.repeat(np.frombuffer(data[6 * n + 4 * m :], np.int64), many))
    out = known
    if sig:
        s, d = np.concatenate(sig), np.concatenate(ids)
        order = np.lexsort((d, s))
        s, d = s[order], d[order]
        cut = _runs(s)
        size, some = np.diff(cut), d[cut[1:] - 1] != d[cut[:-1]]
        keep = np.repeat(some, size)
        lead, level = np.repeat(d[cut[:-1]], size)[keep], ((s >> np.uint64(32)) & np.uint64(63)).astype(np.int64)[keep]
        out = [*known, np.stack(_members(lead, level, d[keep]))]
    cols = np.concatenate(out, axis=1) if out else np.zeros((4, 0), dtype=np.int64)
    return pa.table({"lead": cols[0], "level": cols[1].astype(np.int32), "doc_id": cols[2], "w": cols[3]})


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of hashes are similar enough."""
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    both = int((a[at] == b).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text of a, text of b) to the pairs that are linked."""
    last_id, last_text, last = None, None, np.zeros(0, dtype=np.uint64)
    for part in batch_slices(batches, 3):
        a, ta = part.column(0).to_pylist(), part.column(2).cast(pa.binary()).to_pylist()
        value, cut = shingle_sets([t or b"" for t in part.column(3).cast(pa.binary()).to_pylist()])
        keep = np.zeros(len(a), dtype=bool)
        for i in range(len(a)):
            if a[i] != last_id or ta[i] != last_text:
                last_id, last_text, last = a[i], ta[i], shingle_sets([ta[i] or b""])[0]
            keep[i] = linked(last, value[cut[i] : cut[i + 1]])
        yield part.select([0, 1]).filter(pa.array(keep))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked ones of the pairs (a, b); texts: doc_id, text of all that occur."""
    ta, tb = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long").distinct()


class CountTree:
    """An R-tree over count vectors, bulk-loaded by recursive splits.

    A node splits at the median of the coordinate whose counts vary most. It keeps the
    maximum of each coordinate and the smallest and largest size of its points.
    """

    def __init__(self, points: np.ndarray, size: np.ndarray, node: int = NODE) -> None:
        self.p = np.where(points == 255, np.uint16(65535), points.astype(np.uint16)) if (points == 255).any() else points
        self.n, self.leaf = size, node
        self.kids: list[tuple[int, int] | None] = []
        self.held: list[np.ndarray | None] = []
        box: list[np.ndarray] = []
        ends: list[tuple[int, int]] = []
        todo = [(np.arange(len(size)), -1, 0)] if len(size) > node else []
        while todo:
            own, parent, side = todo.pop()
            me = len(box)
            box.append(self.p[own].max(axis=0))
            ends.append((int(size[own].min()), int(size[own].max())))
            self.kids.append(None)
            self.held.append(own if len(own) <= node else None)
            if parent >= 0:
                old = self.kids[parent] or (0, 0)
                self.kids[parent] = (me, old[1]) if side == 0 else (old[0], me)
            if len(own) > node:
                axis = int(self.p[own].astype(np.float32).var(axis=0).argmax())
                order = own[np.argsort(self.p[own, axis], kind="stable")]
                todo += [(order[: len(own) // 2], me, 0), (order[len(own) // 2 :], me, 1)]
        self.box, self.ends = np.array(box), np.array(ends, dtype=np.int64).reshape(-1, 2)

    def _reach(self, rows: np.ndarray, i: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bound of the overlap with point i, and whether it is enough for sizes between low and high."""
        n = self.n[i]
        bound = np.minimum(rows, self.p[i]).sum(axis=1, dtype=np.int64)
        near = (high * 100 >= PERCENT * n) & (low * PERCENT <= 100 * n)
        return bound, near & (bound * (100 + PERCENT) >= PERCENT * (n + low))

    def near(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Points, point i too, whose overlap with it may be large enough, and the bounds."""
        at = np.arange(len(self.n))
        if len(self.box):
            nodes, leaves = np.zeros(1, dtype=np.int64), []
            while len(nodes):
                _, ok = self._reach(self.box[nodes], i, self.ends[nodes, 0], self.ends[nodes, 1])
                inner = []
                for k in nodes[ok].tolist():
                    if self.held[k] is not None:
                        leaves.append(self.held[k])
                    else:
                        inner += self.kids[k]
                nodes = np.array(inner, dtype=np.int64)
            at = np.concatenate(leaves) if leaves else at[:0]
        bound, ok = self._reach(self.p[at], i, self.n[at], self.n[at])
        return at[ok], bound[ok]


def search(tree: CountTree, doc: np.ndarray, label: np.ndarray, how: str, allowed=None) -> list[tuple[int, int, int]]:
    """Candidate pairs (i, j, bound) of points with different labels.

    first: each point's smallest partner among the points that have none themselves.
    nearest: its partner with the largest bound. all: every pair once.
    allowed(i, js): which of the partners count.
    """
    out, order = [], np.argsort(doc, kind="stable")
    open_ = np.ones(len(doc), dtype=bool)
    for i in order.tolist():
        if how == "first" and not open_[i]:
            continue
        at, bound = tree.near(i)
        ok = label[at] != label[i]
        if how != "nearest":
            ok &= doc[at] > doc[i]
        if how == "first":
            ok &= open_[at]
        if allowed is not None:
            ok &= allowed(i, at)
        at, bound = at[ok], bound[ok]
        if not len(at):
            continue
        if how == "nearest":
            best = np.lexsort((doc[at], -bound))[:1]
            at, bound = at[best], bound[best]
        if how == "first":
            open_[at] = False
        out += [(i, j, b) for j, b in zip(at.tolist(), bound.tolist())]
    return out


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to a row for each level of the document: size and group counts."""
    for part in batch_slices(batches, 1):
        ids = part.column(0).to_pylist()
        value, cut = shingle_sets([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()])
        n = np.diff(cut)
        own = levels_of(n)
        rows = []
        for here, level in ((n > 0, own), (in_next(n, own), own + 1)):
            at = np.flatnonzero(here)
            pos, group, count, _ = grouped(value, cut, at, level[at], FINE)
            edge = np.searchsorted(pos, np.arange(len(at) + 1))
            for k, i in enumerate(at):
                p = np.zeros(FINE * GROUPS[level[i]], dtype=np.uint8)
                p[group[edge[k] : edge[k + 1]]] = np.minimum(count[edge[k] : edge[k + 1]], 255)
                rows.append((ids[i], int(level[i]), int(own[i]), int(n[i]), p.tobytes()))
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["doc_id", "level", "own", "size", "point"])


def _searched(how: str):
    """Candidate pairs (a, b, bound) of the bundles' blocks in one part.

    A pair is looked for at the level of its larger set only; in a block with two sides, only
    between those.
    """

    def run(t: pa.Table) -> pa.Table:
        give_back()
        lead, level, x, y, side, doc, label, own, size = (t.column(c).to_numpy() for c in ("lead", "level", "x", "y", "side", "doc_id", "label", "own", "size"))
        order = np.lexsort((y, x, level, lead))
        cut, point, out = _runs(*(c[order] for c in (lead, level, x, y))), t.column("point").combine_chunks(), [[], [], []]
        for a, b in zip(cut[:-1], cut[1:]):
            at = order[a:b]
            if (label[at] == label[at[0]]).all():
                continue
            tree = CountTree(np.frombuffer(b"".join(point.take(pa.array(at)).to_pylist()), dtype=np.uint8).reshape(len(at), -1), size[at])
            s, o, lv = side[at], own[at], level[at[0]]
            allowed = lambda i, j: (np.maximum(o[i], o[j]) == lv) & ((s[j] < 0) | (s[j] != s[i]))  # noqa: E731, B023
            for i, j, bound in search(tree, doc[at], label[at], how, allowed):
                i, j = int(doc[at[i]]), int(doc[at[j]])
                if i != j:
                    out[0].append(min(i, j))
                    out[1].append(max(i, j))
                    out[2].append(bound)
        return pa.table([pa.array(z, pa.int64()) for z in out], names=["a", "b", "bound"])

    return run


def components(links: DataFrame) -> DataFrame:
    """doc_id, label (the smallest id of its component) of every id in the links (a, b).

    Every round, an id takes the smallest label among its neighbours and then the label of
    its label; paths shrink by a factor each time.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    step = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("next")).withColumnRenamed("a", "doc_id"), "labels")
    while True:
        labels = step.select("doc_id", F.col("next").alias("label"))
        near = both.join(labels.withColumnRenamed("doc_id", "a"), "a").groupBy("b").agg(F.min("label").alias("near")).withColumnRenamed("b", "doc_id")
        new = labels.join(near, "doc_id").select("doc_id", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("doc_id").alias("next"), F.col("label").alias("far"))
        new = materialize(new.join(jump, "next").select("doc_id", "label", F.least("next", "far").alias("next")), "labels")
        moved = new.filter("label <> next").limit(1).count()
        release(step)
        step = new
        if not moved:
            release(both)
            return step  # doc_id, label, next (the same)


def _sized(members: DataFrame, label: str) -> DataFrame:
    """lead, level, size, head (the smallest member) of each bundle of two members or more.

    Written, so that a join of a hot bundle's members with it can be split.
    """
    return materialize(members.groupBy("lead", "level").agg(F.count(F.lit(1)).alias("members"), F.min("doc_id").alias("head")).filter("members > 1"), label)


def _enough(members: DataFrame, need: DataFrame) -> DataFrame:
    """Bundles without the documents that share too few groups in all bundles together."""
    sure = members.groupBy("doc_id").agg(F.sum("w").alias("all")).join(need, "doc_id").filter(F.col("all") >= F.col("need")).select("doc_id")
    members = materialize(members.join(sure, "doc_id"), "members")
    sizes = _sized(members, "sizes")
    out = materialize(members.join(sizes, ["lead", "level"]).select("lead", "level", "doc_id", "w"), "members")
    release(members, sizes)
    return out


def _smallest(members: DataFrame, need: DataFrame) -> DataFrame:
    """Each document only in its smallest bundles.

    A linked pair shares at least `need` groups, all of them in bundles of both. So, in the
    order of bundle sizes, the first bundle where they share one is followed, itself
    included, by at least `need` of either's groups: bundles nearer to the end can go.
    """
    sizes = _sized(members, "sizes")
    rest = Window.partitionBy("doc_id").orderBy("members", "lead", "level").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    kept = members.join(sizes, ["lead", "level"]).withColumn("rest", F.sum("w").over(rest)).join(need, "doc_id")
    out = materialize(kept.filter(F.col("rest") >= F.col("need")).select("lead", "level", "doc_id"), "members")
    release(sizes)
    return out


def _block_rows() -> list[int]:
    """Points of a block at each level."""
    width = FINE * GROUPS[:64]
    return [int(x) for x in np.clip(BLOCK_BYTES // width, 2, BLOCK)]


def _blocks(members: DataFrame, how: str) -> tuple[DataFrame, DataFrame]:
    """Members (lead, level, doc_id, label) of bundles with several labels, dealt to blocks
    (x, y), and the table that is read with them.

    Up to the last search, a document looks for partners in its own block and in that block's
    copy of the bundle's smallest document. In the last one, blocks meet: the documents of the
    commonest label meet those of all others, and those each other.
    """
    by_label = members.groupBy("lead", "level", "label").agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("head"))
    state = by_label.groupBy("lead", "level").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("n_top"), (F.sum("c") - F.max("c")).alias("n_rest"), F.min("head").alias("head")).filter("n_rest > 0")
    state = materialize(state, "bundles")
    rows = F.element_at(F.array(*map(F.lit, _block_rows())), F.col("level") + 1)
    parts = lambda n: F.ceil(F.col(n) / rows).cast("int")
    m = members.join(state, ["lead", "level"])
    hashed = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(how)), n).cast("int")
    if how != "all":
        blocks = F.ceil((F.col("n_top") + F.col("n_rest")) / rows).cast("int")
        x = F.when(F.col("doc_id") == F.col("head"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(hashed(blocks)))
        return m.withColumn("x", F.explode(x)).select("lead", "level", "doc_id", "label", "x", F.lit(0).alias("y"), F.lit(-1).alias("side")), state
    one = F.col("n_top") + F.col("n_rest") <= rows
    is_top, tops, rests = F.col("label") == F.col("top"), parts("n_top"), parts("n_rest")
    at = lambda x, y, side: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    mine = hashed(F.when(is_top, tops).otherwise(rests))
    # blocks (x, y) with x >= 0: part x of the top label and part y of the rest; below: parts of the rest
    with_rest = F.transform(F.sequence(F.lit(0), rests - 1), lambda y: at(mine, y, F.lit(0)))
    with_top = F.transform(F.sequence(F.lit(0), tops - 1), lambda x: at(x, mine, F.lit(1)))
    among = F.transform(F.sequence(F.lit(0), rests - 1), lambda y: at(-1 - F.least(mine, y), F.greatest(mine, y), F.when(mine == y, -1).otherwise(mine)))
    places = F.when(one, F.array(at(F.lit(0), F.lit(0), F.lit(-1)))).when(is_top, with_rest).otherwise(F.concat(with_top, among))
    return m.withColumn("p", F.explode(places)).select("lead", "level", "doc_id", "label", "p.*"), state


def candidates(members: DataFrame, points: DataFrame, how: str) -> DataFrame:
    """a < b, bound: candidate pairs with different labels, from the R-trees of the bundles' blocks."""
    placed, state = _blocks(members, how)
    placed = materialize(placed, "placed")
    width = F.element_at(F.array(*[F.lit(int(w)) for w in FINE * GROUPS[:64]]), F.col("level") + 1)
    total = placed.agg(F.sum(width + 64)).first()[0] or 0
    part = F.pmod(F.xxhash64("lead", "level", "x", "y"), F.lit(max(1, -(-total // PART_BYTES)))).alias("part")
    found = placed.join(points, ["doc_id", "level"]).select("*", part).groupBy("part").applyInArrow(_searched(how), "a long, b long, bound long")
    if how == "all":
        pairs = found.groupBy("a", "b").agg(F.max("bound").alias("bound"))
    elif how == "first":  # one partner for each document
        pairs = found.groupBy("b").agg(F.min("a").alias("a"))
    else:
        both = found.union(found.select("b", "a", "bound"))
        pairs = both.groupBy("b").agg(F.max(F.struct("bound", (-F.col("a")).alias("a"))).alias("x"))
        pairs = pairs.select(F.least("b", -F.col("x.a")).alias("a"), F.greatest("b", -F.col("x.a")).alias("b")).distinct()
    pairs = materialize(pairs.select("a", "b"), f"pairs-{how}")
    release(placed, state)
    return pairs


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    seen = materialize(rows.mapInArrow(_survey, "doc_id long, n long, digest binary, need long, sig long"), "sets")
    some = seen.filter("sig IS NULL AND n > 0 AND doc_id IS NOT NULL")
    count, total = some.agg(F.count(F.lit(1)), F.sum("n")).first()
    least = materialize(some.groupBy("digest").agg(F.min("doc_id").alias("a")), "least")  # so that the join can be split
    links = some.join(least, "digest").filter("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    links = materialize(links, "same")
    need = some.groupBy("doc_id").agg(F.min("need").alias("need"), F.countDistinct("digest").alias("sets"))
    # a document with one set, which a smaller one also has, is settled
    copies = links.select(F.col("b").alias("doc_id")).distinct()
    need = materialize(need.join(copies.withColumn("copy", F.lit(True)), "doc_id", "left").filter("copy IS NULL OR sets > 1").select("doc_id", "need"), "need")
    release(least)

    # at most HOT_SHARE times the mean number of signatures
    hot = seen.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("lead"), F.sum("n").alias("n")).filter(F.col("n") >= (count or 0) // HOT_SHARE)
    hot = sorted((r.sig & (1 << 64) - 1, r.lead) for r in hot.collect())
    hot_sig, hot_lead = np.array([h[0] for h in hot], dtype=np.uint64), np.array([h[1] for h in hot], dtype=np.int64)
    buckets = max(MIN_BUCKETS, (total or 0) * 11 // 20 // SIGNATURES_A_BUCKET + 1)
    known = rows.filter("doc_id IS NOT NULL AND text <> ''")
    dealt = known.mapInArrow(_dealt(buckets, hot_sig, hot_lead), "bucket long, n int, docs int, data binary")
    members = dealt.groupBy("bucket").applyInArrow(_bundles, "lead long, level int, doc_id long, w long")
    members = materialize(members.groupBy("lead", "level", "doc_id").agg(F.sum("w").alias("w")), "members")
    for _ in range(2):
        old, members = members, _enough(members, need)
        release(old)
    old, members = members, _smallest(members, need)
    release(old, need)
    sizes = _sized(members, "sizes")
    old, members = members, materialize(members.join(sizes, ["lead", "level"]).select("lead", "level", "doc_id"), "members")
    release(old, sizes)
    ids = materialize(members.select("doc_id").distinct(), "ids")
    texts = materialize(known.join(broadcast_if_small(ids), "doc_id"), "listed")
    points = materialize(texts.mapInArrow(_points, "doc_id long, level int, own int, size long, point binary"), "points")

    labels = None
    for how in SEARCHES:
        if labels is None:
            labelled = members.withColumn("label", F.col("doc_id"))
        else:
            labelled = members.join(labels.select("doc_id", "label"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
        labelled = materialize(labelled, "labelled")
        pairs = candidates(labelled, points, how)
        old, links = links, materialize(links.union(verified(pairs, texts)), "links")
        release(labelled, pairs, old)
        if labels is not None:
            release(labels)
        labels = components(links)
    release(links, texts, points, ids, members)
    out = seen.filter("sig IS NULL").join(labels.select("doc_id", "label"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_jaccard_join": op10_jaccard_join}
#: Pairs over common shingles, and all that each document reaches: fit for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: md5(array_to_string(list_slice(w, i, i + 4), ' ')))) END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b USING (g) WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(s) AS n_shingles, component_id FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""
ORACLES = {"op10_jaccard_join": ORACLE}
