"""Near-duplicate documents by SetSketch registers.

Each document's shingle set is sketched into registers that hold exponentially
spaced, truncated minima: register i holds floor(1 - log_b(smallest value that any
shingle drew for i)). Registers merge by maximum and agree with a chance close to
the sets' similarity, so equal register runs (bands) propose groups; a joint
likelihood of larger/equal/smaller registers discards what can't be similar, and
whole sets confirm the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .components import connected_components
from .runtime import checkpoint, prepare, slices, sorted_groups, text_buffer

U = np.uint64
#: Register base: neighbouring register values differ by this factor of the minimum. With a
#: coarse base unrelated sets' registers agree often enough for bands to collide.
BASE = 1.001
#: Registers hold 0..65535; 1 stands for a minimum near BASE**OFFSET.
OFFSET = 4000
#: Ids of documents with a likely partner are broadcast up to this number; more are joined by a shuffle of the texts.
BROADCAST_DOCUMENTS = 100_000


def sketch(rows: np.ndarray, values: np.ndarray, n_rows: int, registers: int = 128) -> np.ndarray:
    """(n_rows, registers) uint16 sketches of the sets {values[rows == r]}; an empty set has zeros.

    Every element draws the points of a Poisson process of rate `registers`, each
    point falling on a random register, so that each register sees a rate-1 process
    of its own. An element stops once its points exceed all its row's minima.
    """
    least = np.full(n_rows * registers, np.inf)
    row, seed, at = rows, values, np.zeros(len(values))
    step = 0
    with np.errstate(over="ignore", divide="ignore"):
        while len(row):
            step += 1
            h = w.mix(seed + U(step) * U(0xA0761D6478BD642F))
            at = at - np.log(((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / registers
            slot = row * registers + (w.mix(h) >> U(33)).astype(np.int64) % registers
            np.minimum.at(least, slot, at)
            most = least.reshape(n_rows, registers).max(1)
            go = at < most[row]
            row, seed, at = row[go], seed[go], at[go]
        out = np.floor(1 - np.log(least) / np.log(BASE)) + OFFSET
    return np.clip(np.nan_to_num(out, neginf=0), 0, 65535).astype(np.uint16).reshape(n_rows, registers)


def _sides(share: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Chance that the register of a set exceeds the other's; share: of the first set, in units of their sum."""
    x = np.clip(share - (1 - share) * j, 0, 1)
    return np.clip(-np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)


_GRID = np.linspace(0.025, 0.975, 39)


def may_reach(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """False for pairs that a joint likelihood puts below `threshold` almost surely.

    a, b: registers, compared along the last axis; na, nb: set sizes. A pair is
    discarded when its likeliest similarity lies below the threshold and explains
    the registers better by a log-likelihood of 16 (some 5.6 standard deviations).
    """
    up, down = (a > b).sum(-1), (a < b).sum(-1)
    same = a.shape[-1] - up - down
    share = na / np.maximum(na + nb, 1)
    best = np.full(np.shape(share), -np.inf)

    def likelihood(j):
        p, q = _sides(share, j), _sides(1 - share, j)
        # similarity can't exceed the ratio of the sizes
        return up * np.log(p) + down * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-9, 1))

    at = likelihood(threshold)
    for j in _GRID[_GRID < threshold]:
        best = np.maximum(best, likelihood(j))
    return best - at < 16


def _agree(a: np.ndarray, b: np.ndarray, compare) -> np.ndarray:
    """For each pair of rows the number of registers of which compare holds, register by register over small blocks."""
    out = np.zeros((len(a), len(b)), np.uint16)
    bt = np.ascontiguousarray(b.T)
    for lo in range(0, len(a), 128):
        at, block = np.ascontiguousarray(a[lo : lo + 128].T), out[lo : lo + 128]
        for x, y in zip(at, bt, strict=True):
            block += compare(x[:, None], y[None, :])
    return out


def _near(regs_a, size_a, regs_b, size_b, num: int, den: int) -> np.ndarray:
    """Pairs of two lists that may be linked: by size, by the number of equal registers, then by likelihood.

    Pairs with as many equal registers as the threshold lets expect stay at once; the likelihood decides those with fewer.
    """
    m, j = regs_a.shape[1], num / den
    share = np.linspace(j / (1 + j), 0.5, 20)
    p = float(np.min(1 - _sides(share, j) - _sides(1 - share, j)))
    least, enough = m * p - 6 * np.sqrt(m * p * (1 - p)) - 1, m * p
    out = np.zeros((len(regs_a), len(regs_b)), bool)
    for top in range(0, len(regs_a), 256):  # so that what is held beside the result doesn't grow with it
        part = slice(top, top + 256)
        same = _agree(regs_a[part], regs_b, np.equal)
        size = size_a[part, None]
        near = (same >= least) & (den * np.minimum(size, size_b) >= num * np.maximum(size, size_b))
        ka, kb = np.nonzero(near & (same < enough))
        for lo in range(0, len(ka), 8192):
            x, y = ka[lo : lo + 8192], kb[lo : lo + 8192]
            near[x, y] = may_reach(regs_a[part][x], regs_b[y], size_a[part][x], size_b[y], j)
        out[part] = near
    return out


def _sets(batch_text: pa.Array, width: int):
    data, ends = text_buffer(batch_text)
    start, stop, first = w.words(data, ends, w.SPACED)
    rows, values = w.shingles(w.hashes(data, start, stop), first, width)
    return rows, values, np.searchsorted(rows, np.arange(len(batch_text) + 1))


_SKETCHED = "doc_id long, text_key long, n_shingles long, set_hash binary, registers binary"


def sketches(docs: DataFrame, width: int, registers: int = 128) -> DataFrame:
    """(doc_id, text_key, n_shingles, set_hash, registers) of each row of (doc_id, text); empty sets have null hashes."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows, values, cut = _sets(part.column("text"), width)
            size = np.diff(cut)
            regs = sketch(rows, values, part.num_rows, registers)
            digest = [
                hashlib.blake2b(values[cut[i] : cut[i + 1]].tobytes(), digest_size=16).digest() if size[i] else None
                for i in range(part.num_rows)
            ]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_hash", "registers"],
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, _SKETCHED)


def _candidate_groups(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(hub, member): each band bucket's members, each with the bucket's most central node.

    Central is who sits in the fullest buckets over all bands. Two nodes that share
    a bucket share its hub, so the groups by hub hold every proposed pair.
    """
    band = lambda b: F.xxhash64(b, F.substring("registers", b * (2 * rows) + 1, F.lit(2 * rows)))
    keys = reps.select("node", F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)).alias("key"))
    full = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    inside = checkpoint(keys.join(full, "key").select("node", "key", "n"))
    central = inside.groupBy("node").agg(F.sum("n").alias("score"))
    best = F.max(F.struct("score", (-F.col("node")).alias("neg")))
    hubs = inside.join(central, "node").groupBy("key").agg(best.alias("best")).select("key", (-F.col("best.neg")).alias("hub"))
    return inside.join(hubs, "key").select("hub", F.col("node").alias("member")).distinct()


def _intersections(sets_a: list[np.ndarray], sets_b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of 0/1 matrices over 4,096 shingles at a time."""
    vocab = np.unique(np.concatenate(sets_a))
    out = np.zeros((len(sets_a), len(sets_b)))

    def positions(sets):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        col = np.minimum(np.searchsorted(vocab, flat), len(vocab) - 1)
        hit = vocab[col] == flat
        row, col = row[hit], col[hit]
        order = np.argsort(col, kind="stable")
        return row[order], col[order]

    ra, ca = positions(sets_a)
    rb, cb = (ra, ca) if sets_a is sets_b else positions(sets_b)
    width = 4096
    for lo in range(0, len(vocab), width):
        parts = []
        for r, c, n in ((ra, ca, len(sets_a)), (rb, cb, len(sets_b))):
            i, j = np.searchsorted(c, [lo, lo + width])
            m = np.zeros((n, width), np.float32)
            m[r[i:j], c[i:j] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _links(ids_a, sets_a, ids_b, sets_b, num: int, den: int, mask) -> list[tuple[int, int]]:
    """A spanning forest (node, root) of the confirmed links between two lists of sets."""
    inter = _intersections(sets_a, sets_b)
    na, nb = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    linked = den * inter >= num * (na[:, None] + nb[None, :] - inter)
    if mask is not None:
        linked &= mask
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = find(ids_a[i]), find(ids_b[j])
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in root]


def _block_links(width: int, num: int, den: int):
    """Confirmed links inside each sorted (hub, i, j) block; side 0 and 1 are the two lists, or all rows have side 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src, dst = [], []
        for group in sorted_groups(batches, ["hub", "i", "j"]):
            if group.num_rows < 2:
                continue
            ids = group.column("member").to_numpy()
            side = group.column("side").to_numpy()
            size = group.column("n_shingles").to_numpy()
            regs = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(len(ids), -1)
            a = np.flatnonzero(side == 0)
            two = bool((side == 1).any())
            b = np.flatnonzero(side == 1) if two else a
            if not len(a):
                continue
            near = _near(regs[a], size[a], regs[b], size[b], num, den) & (ids[a][:, None] != ids[b][None, :])
            ka, kb = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
            if not len(ka):
                continue
            used = np.union1d(a[ka], b[kb])
            sets, done = {}, 0
            for part in slices(iter(group.select(["text"]).take(pa.array(used)).combine_chunks().to_batches()), "text"):
                _, values, cut = _sets(part.column("text"), width)
                sets |= {used[done + k]: values[cut[k] : cut[k + 1]] for k in range(part.num_rows)}
                done += part.num_rows
            for x, y in _links([int(ids[i]) for i in a[ka]], [sets[i] for i in a[ka]], [int(ids[i]) for i in b[kb]], [sets[i] for i in b[kb]], num, den, near[np.ix_(ka, kb)]):
                src.append(x)
                dst.append(y)
            if len(src) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
                src, dst = [], []
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return run


def _survivors(num: int, den: int):
    """(hub, member) of the sorted groups by hub whose registers come near those of another member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["hub"]):
            size = group.column("n_shingles").to_numpy()
            regs = np.frombuffer(b"".join(group.column("registers").to_pylist()), np.uint16).reshape(len(size), -1)
            near = _near(regs, size, regs, size, num, den)
            np.fill_diagonal(near, False)
            kept = group.filter(pa.array(near.any(1))).select(["hub", "member"]).combine_chunks()
            yield from kept.to_batches()

    return run


def _confirm(rows: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (src, dst) among rows (hub, i, j, side, member, n_shingles, registers, text)."""
    dealt = rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "member")
    return dealt.mapInArrow(_block_links(width, num, den), "src long, dst long")


def near_duplicates(
    docs: DataFrame, *, width: int = 5, threshold: tuple[int, int] = (80, 100), bands: int = 28, rows: int = 5, block: int = 256, sketch_block: int = 2048
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs(doc_id, text).

    A document's set holds its distinct shingles of `width` words (bytes other than
    white space, A-Z lower-cased); with fewer words the whole sequence is one. Documents
    whose sets have an intersection of at least threshold[0]/threshold[1] of their
    union are linked; component_id is the smallest doc_id reachable over links and
    kept marks that document.

    Defined results: a null or empty text has an empty set (n_shingles 0) and links
    with nothing; a null doc_id keeps null ids and links with nothing (kept is true,
    so no text is lost); rows that repeat a doc_id are one document, linked with whatever
    one of its texts is linked with, and each row is returned with the size of its own set;
    other columns are ignored; an empty table gives no rows.

    Words and shingles are compared by 64-bit hashes and equal sets by a 128-bit hash, never
    by their bytes: unequal shingles pass for equal with a chance of 5e-20 each.

    Equal sets are merged first. A group by hub of more than `block` documents is dealt
    out in blocks: inside a block all pairs are decided, between blocks those of
    documents that aren't already linked to the hub. No pair is written out; each
    block returns a spanning forest. Before any text moves, members of groups of up to
    `sketch_block` documents whose registers come near no other member's leave.
    """
    spark = docs.sparkSession
    prepare(spark)
    num, den = threshold
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_sketches = checkpoint(sketches(docs, width, bands * rows))
    known = all_sketches.filter("doc_id is not null and set_hash is not null")
    classes = known.groupBy("set_hash").agg(F.min(F.struct("doc_id", "registers", "n_shingles", "text_key")).alias("c")).select("set_hash", "c.*")
    # a node is a distinct set, as one document may have several; a number is given once, and written
    reps = checkpoint(classes.withColumn("node", F.monotonically_increasing_id()))
    pairs = checkpoint(_candidate_groups(reps, bands, rows))
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("size"))
    sized = pairs.join(sizes, "hub")
    looked = sized.filter(F.col("size") <= sketch_block).join(reps.select(F.col("node").alias("member"), "registers", "n_shingles"), "member")
    looked = looked.repartition("hub").sortWithinPartitions("hub", "member").mapInArrow(_survivors(num, den), "hub long, member long")
    pairs = checkpoint(looked.unionByName(sized.filter(F.col("size") > sketch_block).select("hub", "member")))
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("size"))
    members = pairs.join(sizes, "hub").select("hub", "member", "size", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    # one text for each member: the copies of a set agree on its words
    wanted = reps.select("node", "doc_id", "text_key").join(members.select(F.col("member").alias("node")).distinct(), "node", "left_semi")
    wanted = checkpoint(wanted)
    if wanted.count() <= BROADCAST_DOCUMENTS:
        wanted = F.broadcast(wanted)
    texts = docs.withColumn("text_key", F.xxhash64("text")).join(wanted, ["doc_id", "text_key"]).dropDuplicates(["node"]).select("node", "text")
    full = (
        members.join(texts, members["member"] == texts["node"]).drop("node")
        .join(reps.select(F.col("node").alias("member"), "registers", "n_shingles"), "member")
        .withColumn("of", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    )
    small = full.withColumn("at", F.when((F.col("member") == F.col("hub")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("of")))
    first = _confirm(small.select("hub", F.explode("at").alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "member", "n_shingles", "registers", "text"), width, num, den)
    links = checkpoint(first)
    large = members.filter("blocks > 1")
    if large.limit(1).count():
        found = checkpoint(connected_components(links))
        label = found.select(F.col("node"), F.col("component"))
        big = full.filter("blocks > 1")
        big = (
            big.join(label.select(F.col("node").alias("member"), F.col("component").alias("mine")), "member", "left")
            .join(label.select(F.col("node").alias("hub"), F.col("component").alias("theirs")), "hub", "left")
            .withColumn("apart", ~F.coalesce(F.col("mine") == F.col("theirs"), F.lit(False)))
        )
        apart = big.groupBy("hub").agg(F.sum(F.col("apart").cast("int")).alias("n_apart")).filter("n_apart > 0")
        big = big.join(apart, "hub").withColumn("parts", F.ceil(F.col("n_apart") / block).cast("int"))
        to = F.pmod(F.xxhash64("member", F.lit(1)), F.col("parts")).cast("int")
        # documents apart from the hub meet all blocks; each block holds all of its members
        left = big.filter("apart").select("hub", to.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), "member", "n_shingles", "registers", "text")
        right = big.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("of").alias("j"), F.lit(1).alias("side"), "member", "n_shingles", "registers", "text")
        links = found.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(_confirm(left.unionByName(right), width, num, den))
    several = checkpoint(known.groupBy("doc_id").agg(F.min("set_hash").alias("a"), F.max("set_hash").alias("b")).filter("a < b").select("doc_id"))
    if not several.isEmpty():  # documents with several sets link them
        nodes = known.select("doc_id", "set_hash").join(several, "doc_id").distinct().join(reps.select("set_hash", "node"), "set_hash").select("doc_id", "node")
        least = nodes.groupBy("doc_id").agg(F.min("node").alias("dst"))
        links = links.unionByName(nodes.join(least, "doc_id").select(F.col("node").alias("src"), "dst"))
    groups = reps.select("node", "doc_id").join(connected_components(links), "node").select("node", "doc_id", "component")
    least = groups.groupBy("component").agg(F.min("doc_id").alias("least"))
    groups = groups.join(least, "component").select("node", "least")
    label = reps.join(groups, "node", "left").select("set_hash", F.coalesce("least", "doc_id").alias("component_id"))
    out = all_sketches.join(label, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
