"""Near duplicates by a chosen-path set similarity join.

Documents are sets of word shingles.  Equal sets are one class with a representative.  Each representative starts in
``trees`` roots: (tree, its minwise shingle there).  Inside a node, documents are compared exhaustively by sketches of
128 minwise values if they are few; a larger node branches again by positions chosen from a hash of its path, after
each of its documents has been compared with the node's pivot and those very close to it have left.  A pair at the
threshold shares a root with probability 1 - (1 - threshold) ** trees, 1 - 1e-7 for ten.

Sketches only gather: what they connect is a neighbourhood, told as a spanning forest and not as pairs.  Links are
confirmed on full sets: every member of a neighbourhood with its pivot, and each member that is not linked to the
pivot with all members, in blocks of bounded bytes, of which again only a spanning forest is told.  So no link between
different texts is lost inside a neighbourhood, and a group of thousands of copies costs a few rows a copy.

Defined results: a text without words (or null) has an empty set and is linked with nothing; a text of fewer words
than a shingle has one shingle, its whole sequence; repeated rows are one class and each row is returned.  Classes are
told apart by the 128-bit digest of their set, not by an id, so different texts under one id stay apart and rows without id take
part; a component's id is its smallest, and null where it has none.  With ``row_names`` a row without id is kept only where
its component has no id, and then only that of the smallest rid; without, every row without id is returned as kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT_BYTES, cut, key_groups, map_batches, mix, row_key, salted, salted_join, slices, texts_of, word_hashes
from .components import components

#: POSITIONS minwise values make a sketch; MEMBERS of a neighbourhood meet its pivot in one place.
#: MET classes at most share half of a digest: of 1e12 classes some 27,000 pairs do by chance.
POSITIONS, MEMBERS, MET = 128, 500, 100_000
_RNG = np.random.default_rng(20)
_MASK = _RNG.integers(0, 1 << 64, POSITIONS, dtype=np.uint64)
_ODD = _RNG.integers(0, 1 << 64, POSITIONS, dtype=np.uint64) | np.uint64(1)
_STEP = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles (A-Z lowered, words cut at the bytes 9-13 and 32)."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = mix(word_hashes(words))
    n = min(size, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out += h[k : len(words) - n + 1 + k] * _STEP[k]
    return np.unique(mix(out + np.uint64(n)))


def minwise(s: np.ndarray) -> np.ndarray:
    """The least value of each of the 128 permutations."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, s.size, 2048):
        np.minimum(least, ((s[a : a + 2048, None] ^ _MASK) * _ODD).min(axis=0), out=least)
    return least


def _digest(s: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return int(np.uint64(x >> 64).view(np.int64)), int(np.uint64(x & (1 << 64) - 1).view(np.int64))


class Forest:
    """Labels of small sets that are joined again and again."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        own = np.unique(self.label[members])
        if own.size > 1:
            self.label[np.isin(self.label, own)] = own[0]


def _neighbourhoods(ids: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare all: (member, first member) for those that enough equal positions connect and sizes allow."""
    order = np.argsort(sizes, kind="stable")
    ids, sizes, sketch = ids[order], sizes[order], sketch[order]
    forest = Forest(ids.size)
    to = np.searchsorted(sizes * percent, sizes * 100, side="right")  # 100 * smaller >= percent * larger
    for i in range(ids.size - 1):
        if to[i] > i + 1:
            near = np.flatnonzero((sketch[i + 1 : to[i]] == sketch[i]).sum(axis=1) >= least)
            if near.size:
                forest.join(np.append(near + i + 1, i))
    first = forest.label
    take = np.flatnonzero(first != np.arange(ids.size))
    return ids[take], ids[first[take]]


def _sketches(column, width: int = POSITIONS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _children(node: np.ndarray, sketch: np.ndarray, branches: int) -> np.ndarray:
    """For each row the child nodes along the positions that its node's path chooses."""
    rank = mix(node[:, None] ^ _MASK)
    chosen = np.argpartition(rank, branches, axis=1)[:, :branches]
    rows = np.arange(node.size)[:, None]
    return mix(rank[rows, chosen] + sketch[rows, chosen].astype(np.uint64))


def _gather(reps: DataFrame, leaf: int, near: int, percent: int) -> DataFrame:
    """Links (a, b) that connect each neighbourhood of representatives; each depth of the trees is a table of its own."""
    plain = reps.select("rep", "n", "sketch")
    light = reps.select("rep", F.explode("nodes").alias("node"))
    out = None
    depth = 0

    def compare(batches):
        for t, edges in key_groups(batches, 0):
            ids, sizes_, sk = t.column(1).to_numpy(), t.column(2).to_numpy(), _sketches(t.column(3))
            a, b = [], []
            for x, y in zip(edges, [*edges[1:], t.num_rows], strict=True):
                if y - x > 1:
                    p, q = _neighbourhoods(ids[x:y], sizes_[x:y], sk[x:y], near, percent)
                    a.append(p)
                    b.append(q)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    while True:
        sizes = cut(light.groupBy("node").agg(F.count("*").alias("c"), F.min("rep").alias("pivot")).where("c > 1"), "sizes")
        large = sizes.where(F.col("c") > leaf)
        few = sizes.where(F.col("c") <= leaf).select("node", "c")
        many = large.count()
        at = plain.select(F.col("rep").alias("pivot"), F.col("sketch").alias("at"))
        narrow = many * 256 <= BROADCAST_LIMIT_BYTES  # large nodes are one in ``leaf`` places at most, often few enough to meet their rows where these lie
        if many:
            big = cut((at.join(F.broadcast(large), "pivot") if narrow else large.join(large.select("pivot").distinct().join(at, "pivot"), "pivot")).select("node", "c", "pivot", "at"), "pivots")
        if not many:
            small = light.join(few.select("node"), "node").join(plain, "rep")
        elif narrow:
            met = light.join(F.broadcast(big.select("node", "pivot")), "node").join(plain, "rep").join(F.broadcast(big.select("node", "at")), "node")
            small = light.join(F.broadcast(big.select("node")), "node", "left_anti").join(few.select("node"), "node").join(plain, "rep")
        else:
            rows, keys = salted(light, few.select("node", "c", F.lit(None).cast("long").alias("pivot"), F.lit(None).cast("binary").alias("at")).unionByName(big), ["node"], "rep")
            met = rows.join(keys.where("pivot is not null"), ["node", "salt"]).join(plain, "rep")
            small = rows.join(keys.where("pivot is null"), ["node", "salt"]).join(plain, "rep")
        small = small.select("node", "rep", "n", "sketch").repartition("node").sortWithinPartitions("node")
        found = cut(map_batches(small.select("node", "rep", "n", "sketch"), compare, "a long, b long"), "near")
        out = found if out is None else out.unionByName(found)
        if not many:
            return out
        # a node too large: its documents meet its pivot, those next to it leave, the others branch
        branches = (4, 2)[depth] if depth < 2 else 1
        met = met.select("node", "rep", "sketch", "pivot", "at")

        def branch(batches, branches=branches):
            for b in batches:
                if b.num_rows:
                    sk = _sketches(b.column(2))
                    same = (sk == _sketches(b.column(4))).sum(axis=1)
                    own = _children(b.column(0).to_numpy().view(np.uint64), sk, branches).view(np.int64)
                    own[same >= POSITIONS * 0.9] = 0
                    link = [p if s >= near - 8 else r for p, s, r in zip(b.column(3).to_pylist(), same.tolist(), b.column(1).to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(1), pa.array(link, pa.int64()), pa.array(own.tolist(), pa.list_(pa.int64()))], names=["rep", "b", "nodes"])

        split = cut(map_batches(met, branch, "rep long, b long, nodes array<long>"), "nodes")
        out = out.unionByName(split.where("rep <> b").select(F.col("rep").alias("a"), "b"))
        light = split.select("rep", F.explode("nodes").alias("node")).where("node <> 0")  # a node has one parent, so no place is told twice
        depth += 1


def _confirm(texts: DataFrame, near: DataFrame, size: int, percent: int, block_bytes: int) -> DataFrame:
    """Links (a, b) between representatives on full sets, as spanning forests; ``texts`` are (rep, text, comp)."""

    def sets(batches):
        for b in slices(batches):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([shingles(t, size).tobytes() for t in texts_of(b)], pa.binary())], names=["rep", "comp", "items"])

    full = cut(map_batches(texts, sets, "rep long, comp long, items binary"), "sets")
    # a large neighbourhood meets its pivot in several places, each with its share of the members
    counted = cut(near.groupBy(F.col("component").alias("comp")).agg(F.count("*").alias("c")).withColumn("salts", F.ceil(F.col("c") / MEMBERS).cast("int")), "counted")
    pivots = full.where("rep = comp").groupBy("comp").agg(F.any_value("items").alias("at")).join(counted, "comp").select("comp", "at", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = salted_join(full, counted, ["comp"], "rep").withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int"))

    def meet(batches):
        for b in slices(batches):
            if b.num_rows:
                linked = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.intersect1d(p, q, assume_unique=True).size
                    linked.append(100 * both >= percent * (p.size + q.size - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in b.column(2).to_pylist()], pa.int64()), pa.array(linked, pa.bool_())], names=["rep", "comp", "bytes", "linked"])

    met = cut(map_batches(dealt.join(pivots, ["comp", "salt"]).select("rep", "comp", "items", "at"), meet, "rep long, comp long, bytes long, linked boolean").distinct(), "met")
    stars = met.where("linked and rep <> comp").select(F.col("rep").alias("a"), F.col("comp").alias("b"))
    totals = cut(met.groupBy("comp").agg(
        F.ceil(F.sum("bytes") / block_bytes).alias("blocks"), F.ceil(F.sum(F.when(~F.col("linked"), F.col("bytes"))) / (block_bytes // 4)).alias("odd_blocks"), F.count("*").alias("c")
    ).where("odd_blocks > 0 and c > 2"), "totals")
    rows = salted_join(full.dropDuplicates(["rep"]).join(met.select("rep", "linked"), "rep"), totals, ["comp"], "rep")
    member = F.struct("rep", "linked", "items").alias("m")
    blocks = rows.groupBy("comp", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("k")).agg(F.collect_list(member).alias("members"))
    odd = rows.where("not linked").groupBy("comp", "blocks", F.pmod(F.xxhash64("rep"), F.col("odd_blocks")).alias("o")).agg(F.collect_list(member).alias("odd"))
    odd = odd.select("comp", "odd", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k"))

    def tiles(batches):
        for b in batches:
            for r in range(b.num_rows):
                comp, odd_, all_ = b.column(0)[r].as_py(), b.column(1)[r].as_py(), b.column(2)[r].as_py()
                a, c = _tile(comp, odd_, all_, percent)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    found = map_batches(odd.join(blocks, ["comp", "k"]).select("comp", "odd", "members"), tiles, "a long, b long")
    return stars.unionByName(found)


def _tile(comp: int, odd: list[dict], members: list[dict], percent: int) -> tuple[list[int], list[int]]:
    """Which of ``odd`` are linked with which members; what is linked to the pivot counts as the pivot itself."""
    members = sorted(members, key=lambda m: (len(m["items"]), m["rep"]))
    sets = [np.frombuffer(m["items"], np.uint64) for m in members]
    sizes = np.array([s.size for s in sets])
    edge = np.concatenate(([0], np.cumsum(sizes)))
    every = np.concatenate(sets)
    name = [comp if m["linked"] else m["rep"] for m in members]
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    a, b = [], []
    for z in odd:
        s = np.frombuffer(z["items"], np.uint64)
        lo, hi = np.searchsorted(sizes * 100, percent * s.size), np.searchsorted(sizes * percent, 100 * s.size, side="right")
        if hi <= lo:
            continue
        part = every[edge[lo] : edge[hi]]
        at = np.minimum(np.searchsorted(s, part), s.size - 1)
        both = np.add.reduceat((s[at] == part).astype(np.int64), edge[lo:hi] - edge[lo])
        for k in (np.flatnonzero(100 * both >= percent * (s.size + sizes[lo:hi] - both)) + lo).tolist():
            p, q = find(z["rep"]), find(name[k])
            if p != q:
                top[max(p, q)] = min(p, q)
                a.append(z["rep"])
                b.append(name[k])
    return a, b


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2, percent: int = 80, trees: int = 10, leaf: int = 2000, slack: float = 0.18, block_bytes: int = 4 << 20, row_names: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row, with ``row_names`` also rid, the key of id and text; ids are longs.

    ``percent`` is the Jaccard threshold in hundredths; ``slack`` is how far a sketch may underrate a link (five
    standard deviations of 128 positions at 0.8); ``leaf`` bounds the rows that one task compares with each other.
    """
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_key(id_col, text_col).alias("rid"), F.col(f"`{text_col}`").alias("text"))

    def sign(batches):
        for b in slices(batches):
            if b.num_rows:
                n, h1, h2, sk, nodes = [], [], [], [], []
                for t in texts_of(b):
                    s = shingles(t, size)
                    d = _digest(s)
                    least = minwise(s)
                    n.append(s.size)
                    h1.append(d[0])
                    h2.append(d[1])
                    sk.append((mix(least) >> np.uint64(56)).astype(np.uint8).tobytes() if s.size else None)
                    nodes.append(mix(least[:trees] + _STEP[:trees]).view(np.int64).tolist() if s.size else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sk, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], names=["id", "rid", "n", "h1", "h2", "sketch", "nodes"]
                )

    signed = cut(map_batches(keyed, sign, "id long, rid string, n long, h1 long, h2 long, sketch binary, nodes array<long>"), "signed")
    usable = signed.where("n > 0")
    # one row of each class brings its text; a class is named by half of its digest, those few whose halves meet by another hash
    classes = usable.groupBy("h1", "h2").agg(F.min("rid").alias("rid"), F.min("id").alias("id"), F.count("*").alias("c"), *(F.first(x).alias(x) for x in ("n", "sketch", "nodes")))
    classes = cut(classes, "classes")
    twice = classes.groupBy("h1").agg(F.count("*").alias("times")).where("times > 1").select(F.col("h1").alias("_h"))
    same = [r[0] for r in twice.limit(MET + 1).collect()]
    if len(same) > MET:
        raise ValueError("more digests meet in 64 bits than hashing can explain")

    def rep() -> Column:
        return F.when(F.col("h1").isin(same), F.xxhash64("h2", "h1")).otherwise(F.col("h1")) if same else F.col("h1")

    reps = classes.select(rep().alias("rep"), "rid", "id", "n", "c", "sketch", "nodes")
    near = int(POSITIONS * (percent / 100 - slack))
    around = components(_gather(reps.select("rep", "n", "sketch", "nodes"), leaf, near, percent))
    own = reps.join(around.select(F.col("id").alias("rep"), F.col("component").alias("comp")), "rep").select("rid", "rep", "comp")
    texts = keyed.select("rid", "text").join(own, "rid").select("rep", "text", "comp")
    final = components(_confirm(texts, around, size, percent, block_bytes))
    placed = reps.select("rep", "id", "rid", "c").join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    least = placed.groupBy("comp").agg(F.min("id").alias("component_id"), F.min("rid").alias("first"))
    names = placed.select("rep", "c", "comp").join(least, "comp").select("rep", "c", "component_id", "first")
    # a text of very many rows is one class: its rows are dealt over salts, rows without words need no class
    rows = salted_join(usable.select("id", "rid", "n", rep().alias("rep")), cut(names, "names"), ["rep"], "rid")
    out = rows.select("id", "rid", "n", "component_id", "first").unionByName(signed.where("n = 0").select("id", "rid", "n", F.lit(None).cast("long").alias("component_id"), F.lit(None).cast("string").alias("first")))
    alone = F.col("n") == 0
    lone = alone | (F.col("component_id").isNull() & (F.col("rid") == F.col("first"))) if row_names else F.lit(True)
    kept = F.when(F.col("id").isNull(), lone).otherwise(alone | (F.col("id") == F.col("component_id")))
    group = F.when(alone | (F.col("id").isNull() & F.lit(not row_names)), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), group.alias("component_id"), kept.alias("kept"), *(["rid"] if row_names else []))
