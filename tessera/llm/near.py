"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct shingles of `words` words. Equal sets collapse to the document with the smallest id.
The others get minwise tokens; in each of several trees a document walks down a path on which the node reached so far
selects the token that names the next node, out of those of the tree's own hash functions that the path has not used.
Nodes of at most `LEAF` documents are compared exhaustively on one-bit sketches, larger nodes branch further, and their
documents enter more trees. All candidates are confirmed on the full sets; only confirmed links count.

Confirming: at each depth, what the candidate pairs and the first members of large nodes connect is held against its most
central document. Documents that this connects are not paired again, and large nodes whose members are all connected
branch no further. Large nodes that share members are a cluster. In clusters in which few members (`STRAY_BLOCKS` blocks)
are apart from most others, these are compared with the whole cluster, in blocks of `BLOCK` by `BLOCK` sets as products of
matrices; other clusters branch on, up to the last depth, where all are compared in this way. At the end the candidate
pairs that are still apart are compared directly. So no pairs of a group are written out, a group of n copies costs about
n confirmations a depth and a row for each block of members that are left apart, and no link of a large node is lost.

Recall: two documents of similarity s share a node of depth d in one tree with probability s^d. Trees share no hash
functions, so n trees miss a pair with probability (1 - s^d)^n. Nodes begin at a depth of 3 tokens, in 20 trees. A
document of a node of more than `LEAF` goes on to the next depth there and in the trees that begin at that depth; 20, 28,
37 and 48 trees at 3, 4, 5 and 6 tokens each miss pairs at exactly 0.8 less than once in 1.7 million. A pair whose shared
nodes were all large and that is not connected yet is in all trees of the next depth, so all four depths together miss
less than once in 500,000 whatever the size of the corpus, the sketch filter (once in 500 million) included. Nodes that
are large at the last depth lose nothing more.

Null and empty texts and texts without words are linked with nothing and have themselves as component. Rows with a null id
have a null component and are kept. Fully repeated rows come out as often as they came in. Texts that share an id are one
document: it is linked with whatever any of them is linked with.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored, temporary

TREES, LEAF, DEPTHS, LEVELS = 20, 32, 4, 6
#: Of 128 sketch bits, so many agree at least: pairs at 0.8 agree on 115 with a deviation of 3.4, and on fewer than these once in 500 million.
LEAST_BITS = 92


#: Shuffle partitions to a file at most, and files to a core at least, of tables of ids.
PER_FILE, PER_CORE = 8, 4


def gathered(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """A table of ids, `stored` in few files even where small partitions are many and not merged: Hadoop starts processes for the
    permissions of each file that it makes in a local folder without native code. What compares documents is stored as it is dealt."""
    spark = df.sparkSession
    files = max(PER_CORE * spark.sparkContext.defaultParallelism, math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / PER_FILE))
    return stored(df.coalesce(files), tag, keep)


def trees_at(trees: int) -> list[int]:
    """Trees of each depth: so many that pairs at 0.8 are missed no more often than by `trees` trees at the first."""
    first = LEVELS - DEPTHS + 1
    miss = trees * math.log1p(-(0.8**first))
    return [math.ceil(miss / math.log1p(-(0.8**d)) - 1e-9) for d in range(first, LEVELS + 1)]


#: Hash functions: each tree has one of its own for each token of a path.
FUNCTIONS = LEVELS * trees_at(TREES)[-1]
_K = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle."""
    own = (text or b"").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    span = min(words, len(own))
    out = np.full(len(own) - span + 1, span, np.uint64)
    for k in range(span):
        out = mix(out * _K[0] + hashed[k : k + len(out)])
    return np.unique(out)


_RANDOM = np.random.default_rng(20)
FACTORS = _RANDOM.integers(0, 2**63, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RANDOM.integers(0, 2**63, FUNCTIONS, np.uint64)


def minwise(own: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    least = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 128):
        np.minimum(least, (own[at : at + 128, None] * FACTORS + TERMS).min(axis=0), out=least)
    return least


def paths(tokens: np.ndarray, trees: int) -> list[np.ndarray]:
    """Node keys [document, tree] of each depth; the first node already lies three tokens deep, and later depths have more trees."""
    n, count = len(tokens), trees_at(trees)
    key = np.broadcast_to(mix(np.arange(1, count[-1] + 1, dtype=np.uint64) * _K[0]), (n, count[-1])).copy()
    left = np.broadcast_to(np.arange(count[-1] * LEVELS).reshape(count[-1], LEVELS), (n, count[-1], LEVELS)).copy()
    out = []
    row = np.arange(n)[:, None]
    for level in range(LEVELS):
        at = (level + (mix(key + _K[1]) % np.uint64(LEVELS - level)).astype(np.int64))[:, :, None]
        selected = np.take_along_axis(left, at, 2)[:, :, 0]
        np.put_along_axis(left, at, left[:, :, level : level + 1], 2)
        key = mix(key * _K[2] ^ tokens[row, selected] + selected.astype(np.uint64))
        if (depth := level - LEVELS + DEPTHS) >= 0:
            out.append(key[:, : count[depth]])
    return out


SIGNATURE = "id long, n long, set_id binary, low long, high long, " + ", ".join(f"k{d} array<bigint>" for d in range(DEPTHS))


def signatures(docs: DataFrame, words: int, trees: int) -> DataFrame:
    """Set size, set hash, sketch and node keys of each document."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            tokens = np.stack([minwise(s) for s in sets])
            bits = np.packbits((mix(tokens[:, :128] + _K[0]) >> np.uint64(63)).astype(np.uint8), axis=1).view(np.int64)
            keys = [np.ascontiguousarray(k).view(np.int64) for k in paths(tokens, trees)]
            ends = [pa.array(np.arange(len(sets) + 1) * k.shape[1], pa.int32()) for k in keys]
            return pa.record_batch(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(bits[:, 0]), pa.array(bits[:, 1]), *(pa.ListArray.from_arrays(ends[d], pa.array(keys[d].reshape(-1))) for d in range(DEPTHS))],
                ["id", "n", "set_id", "low", "high", *(f"k{d}" for d in range(DEPTHS))],
            )

        return each

    return map_arrow(docs.select("doc_id", "text"), make, SIGNATURE)


def alike(n1, low1, high1, n2, low2, high2):
    """Sketch and size filter; sizes of sets at 0.8 differ by a quarter at most. Works on arrays and on columns."""
    return (n1 * 10 >= n2 * 8) & (n2 * 10 >= n1 * 8) & (128 - bits_apart(low1, low2) - bits_apart(high1, high2) >= LEAST_BITS)


def bits_apart(a, b):
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64) if isinstance(a, np.ndarray) else F.bit_count(a.bitwiseXOR(b))


def agreement(low1, high1, low2, high2):
    return 128 - bits_apart(low1, low2) - bits_apart(high1, high2)


def compare_nodes(rows: DataFrame) -> DataFrame:
    """One pass over nodes whose rows arrive together: (node null, a, b, bits) for candidate pairs inside nodes of at most LEAF rows,
    and (node, a, b, bits, tree) = (key, member, first member, agreement or 0 if not alike, tree) for each row of a larger one.
    Documents of one `own` are known to be connected and are not paired."""

    def batch_of(node, a, b, bits, tree, small: bool) -> pa.RecordBatch:
        mask = np.full(len(node), small)
        return pa.record_batch([pa.array(node, mask=mask), pa.array(a), pa.array(b), pa.array(bits, pa.int64()), pa.array(tree, pa.int32(), mask=mask)], ["node", "a", "b", "bits", "tree"])

    def pairable(x, y) -> np.ndarray:
        return alike(*x[:3], *y[:3]) & (x[3] != y[3])

    def compare(key, ids, tree, *of) -> Iterator[pa.RecordBatch]:
        found = []
        for shift in range(1, LEAF):
            same = np.flatnonzero(key[shift:] == key[:-shift])
            if not len(same):
                break
            ok = pairable([x[same] for x in of], [x[same + shift] for x in of]) & (ids[same] != ids[same + shift])
            one = same[ok]
            two = one + shift
            found.append((key[one], np.minimum(ids[one], ids[two]), np.maximum(ids[one], ids[two]), agreement(of[1][one], of[2][one], of[1][two], of[2][two]), tree[one]))
        if found:
            yield batch_of(*map(np.concatenate, zip(*found, strict=True)), True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large, first = None, None, []  # rows of the last node; the key and first member of a large node that may go on
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            key, ids, tree, *of = now
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            size = np.diff(np.append(starts, len(key)))
            big = size > LEAF
            heads = [x[starts] for x in (ids, *of)]
            if large is not None and key[0] == large:
                big[0] = True
                for head, x in zip(heads, first, strict=True):
                    head[0] = x
            large, first = (key[-1], [x[-1] for x in heads]) if big[-1] else (None, [])
            in_big = np.repeat(big, size)
            if big.any():
                head = [np.repeat(x, size)[in_big] for x in heads]
                own = [x[in_big] for x in of]
                bits = np.where(pairable(own, head[1:]), agreement(own[1], own[2], head[2], head[3]), 0)
                yield batch_of(key[in_big], ids[in_big], head[0], bits, tree[in_big], False)
            rest = ~in_big
            rest[starts[-1] :] = False
            if rest.any():
                yield from compare(*(x[rest] for x in now))
            held = None if big[-1] else [x[starts[-1] :] for x in now]
        if held is not None:
            yield from compare(*held)

    dealt = rows.select("key", "id", "tree", "n", "low", "high", "own").repartition("key").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(run, "node long, a long, b long, bits long, tree int")


def walk(signed: DataFrame, star: Callable, tiles: Callable, trees: int = TREES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate pairs (a, b, bits) of all depths, the links (a, b) that `star` and `tiles` confirmed, and (id, own, cluster): what each
    confirmed document belongs to, and the cluster in which it was compared with all others.

    `star` takes the candidates of a depth and the ids of its large nodes, and gives links. `tiles` takes the rows (node, id, first, tree, own)
    of large nodes that this leaves apart and whether the depth is the last, and gives links, the (id, cluster) that it settled, and the
    rows of other documents. These go on in those trees, and in the trees that begin at the next depth."""
    count = trees_at(trees)
    pairs, links, settled = [], [], []
    rows = signed.select("id", "n", "low", "high", F.col("id").alias("own"), F.posexplode("k0").alias("tree", "key"))
    for depth in range(DEPTHS):
        if depth:
            on = large.groupBy("id").agg(F.collect_set("tree").alias("on"))  # trees by document, so the join makes a row per document
            new = F.array(*map(F.lit, range(count[depth - 1], count[depth])))
            rows = on.join(signed.select("id", "n", "low", "high", f"k{depth}"), "id").join(own, "id", "left").withColumn("own", F.coalesce("own", "id"))
            rows = rows.withColumn("tree", F.explode(F.concat("on", new))).withColumn("key", F.element_at(f"k{depth}", F.col("tree") + 1))
        found = stored(compare_nodes(rows), "nodes")
        large = found.where(F.col("node").isNotNull())
        starred = large.where("bits > 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits")
        pairs.append(gathered(found.where(F.col("node").isNull()).select("a", "b", "bits").unionAll(starred).distinct(), "candidates"))
        links.append(stored(star(pairs[-1], large.select(F.col("a").alias("id"))), "star"))
        if depth:
            own = gathered(components(union(links)).withColumnRenamed("component", "own"), "own")
        else:  # a star links a document to one centre
            own = links[0].select(F.col("b").alias("id"), F.col("a").alias("own")).unionAll(links[0].select("a", "a"))
            own = gathered(own.distinct(), "own")
        large = large.select("node", F.col("a").alias("id"), F.col("b").alias("first"), "tree").join(own, "id", "left").withColumn("own", F.coalesce("own", "id"))
        apart = large.groupBy("node").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least <> most").select("node")
        large = gathered(large.join(apart, "node", "left_semi"), "large")
        if large.isEmpty():
            break
        more, done, large = tiles(large, depth == DEPTHS - 1)
        links.append(more)
        settled.append(done)
        if large.isEmpty():
            break
    done = union(settled) if settled else own.select("id", F.lit(None).cast("long").alias("cluster")).limit(0)
    return union(pairs), union(links), gathered(own.join(done, "id", "full"), "own")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of the links, component being the smallest id reachable; alternates large and small stars until nothing moves."""
    edges = gathered(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    last = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        big = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = gathered(small, "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        last = state


#: Sets of one side of a tile: at most so many documents, and about so many shingles, are held at a time.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Blocks of strays that each member of a cluster meets at most before the last depth; a member of a branching node costs a row for each tree.
STRAY_BLOCKS = 4
#: Columns of the matrices that tiles are compared by, and documents of the other side that are compared at a time.
COLUMNS, CHUNK = 4096, 256


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of the one list with all of the other: by search for a few sets, else by
    products of 0-1 matrices over the shingles that both sides hold."""
    size = [np.array([len(x) for x in side]) for side in (one, two)]
    every = [np.concatenate(side) for side in (one, two)]
    if len(one) <= 4:
        starts = np.concatenate([[0], np.cumsum(size[1])[:-1]])
        out = np.empty((len(one), len(two)), np.int64)
        for k, x in enumerate(one):
            at = np.minimum(np.searchsorted(x, every[1]), len(x) - 1)
            out[k] = np.add.reduceat((x[at] == every[1]).astype(np.int64), starts)
        return out
    shared = np.intersect1d(*every)
    out = np.zeros((len(one), len(two)), np.int64)
    places = []
    for flat, lengths in zip(every, size, strict=True):
        at = np.searchsorted(shared, flat)
        held = at < len(shared)
        held[held] = shared[at[held]] == flat[held]
        places.append((np.repeat(np.arange(len(lengths)), lengths)[held], at[held]))
    for first in range(0, len(shared), COLUMNS):
        matrices = []
        for (row, at), lengths in zip(places, size, strict=True):
            here = (at >= first) & (at < first + COLUMNS)
            m = np.zeros((len(lengths), min(COLUMNS, len(shared) - first)), np.float32)
            m[row[here], at[here] - first] = 1
            matrices.append(m)
        out += (matrices[0] @ matrices[1].T).astype(np.int64)  # counts up to COLUMNS are exact
    return out


def connecting(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Of pairs of ids, the first ones that join what was apart."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = up = parent.get(up, up)
            x = up
        return x

    out = []
    for k, (one, two) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := top(one)) != (y := top(two)):
            parent[y] = x
            out.append(k)
    return out


def confirm(rows: DataFrame, texts: DataFrame, words: int, share: float) -> DataFrame:
    """Links (a, b) of the texts of role 0 with those of role 1 in the same tile, as many as connect what all of them connect.

    Rows are (tile, role, id, own); documents of one `own` are known to be connected, and not linked again. A tile holds
    its role 0 in memory, which callers bound by BLOCK; role 1 goes by in chunks. Similarity is exact, on integers.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: int | None = None
        ids, own, sets = ([], []), ([], []), ([], [])

        def compare() -> Iterator[pa.RecordBatch]:
            if ids[0] and ids[1]:
                both = overlaps(*sets)
                size = [np.array([len(x) for x in side]) for side in sets]
                linked = 100 * both >= share * (size[0][:, None] + size[1][None] - both) - 1e-6
                linked &= np.array(own[0])[:, None] != np.array(own[1])[None]
                row, column = np.nonzero(linked)
                a, b = np.array(ids[0])[row], np.array(ids[1])[column]
                keep = connecting(a, b)
                if keep:
                    yield pa.record_batch([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])
            for side in (ids[1], own[1], sets[1]):
                side.clear()

        held = 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for now, role, i, group, text in zip(*columns, batch.column(4).cast(pa.binary()).to_pylist(), strict=True):
                if now != tile:
                    yield from compare()
                    tile, held = now, 0
                    ids, own, sets = ([], []), ([], []), ([], [])
                found = shingles(text, words)
                if not len(found):
                    continue
                if role and (len(ids[1]) == CHUNK or held + len(found) > BLOCK_SHINGLES):
                    yield from compare()
                    held = 0
                ids[role].append(i)
                own[role].append(group)
                sets[role].append(found)
                held += len(found) * role
        yield from compare()

    # both sides grow with the corpus: sorted and merged at every size
    dealt = rows.hint("merge").join(texts, "id").select("tile", "role", "id", "own", "text")
    return dealt.repartition("tile").sortWithinPartitions("tile", "role").mapInArrow(run, "a long, b long")


def confirm_star(candidates: DataFrame, texts: DataFrame, words: int, share: float) -> DataFrame:
    """Links (a, b) of the most central document a of what the candidates connect with the others, one comparison a document."""
    group = gathered(components(candidates), "groups")
    both = candidates.select(F.col("a").alias("id"), "bits").unionAll(candidates.select(F.col("b").alias("id"), "bits"))
    weight = both.groupBy("id").agg(F.sum(F.col("bits") - (LEAST_BITS - 1)).alias("weight"))
    central = group.join(weight, "id").groupBy("component")
    central = central.agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("centre"), F.count("*").alias("size"))
    around = group.join(central, "component").where("id <> centre")
    around = around.withColumn("tile", F.xxhash64("centre", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / CHUNK))))
    centres = around.select("tile", F.lit(0).alias("role"), F.col("centre").alias("id"), F.lit(0).alias("own")).distinct()
    star = around.select("tile", F.lit(1).alias("role"), "id", F.lit(1).alias("own")).unionAll(centres)
    return confirm(star, texts, words, share)


def confirm_apart(candidates: DataFrame, own: DataFrame, texts: DataFrame, words: int, share: float) -> DataFrame:
    """Links of the candidate pairs that `own` leaves apart and that no cluster has compared, one row a pair: a document has at
    most LEAF of them in a node and one more for each large node."""
    of = lambda name, out, place: own.select(F.col("id").alias(name), F.col("own").alias(out), F.col("cluster").alias(place))
    left = candidates.join(of("a", "x", "at_x"), "a", "left").join(of("b", "y", "at_y"), "b", "left")
    left = left.where(F.coalesce(F.col("at_x") != F.col("at_y"), F.lit(True)))
    left = left.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")).where("x <> y")
    loose = F.col("x") == F.col("a")
    left = left.select(F.when(loose, F.col("a")).otherwise(F.col("b")).alias("held"), F.when(loose, F.col("b")).otherwise(F.col("a")).alias("other"))
    left = gathered(left, "left")  # read three times below
    degree = left.groupBy("held").agg(F.ceil(F.count("*") / CHUNK).alias("tiles"))
    left = left.join(degree, "held").withColumn("tile", F.xxhash64("held", F.pmod(F.xxhash64("other"), F.col("tiles"))))
    held = left.select("tile", F.lit(0).alias("role"), F.col("held").alias("id"), F.lit(0).alias("own")).distinct()
    pairs = left.select("tile", F.lit(1).alias("role"), F.col("other").alias("id"), F.lit(1).alias("own")).unionAll(held)
    return confirm(pairs, texts, words, share)


def place_large(large: DataFrame, sizes: DataFrame, share: float, last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tiles (tile, role, id, own) of the clusters of large nodes that are compared now, their members (id, cluster), and the rows of the others.

    Nodes of different trees that share members make one cluster. In a cluster, members outside the component that most
    of its members have are strays; strays are compared with all members, in tiles of BLOCK by BLOCK documents, so that
    a document comes up once for each BLOCK strays of its cluster. Sets of less than 0.8 times the size of another are
    never linked, so only tiles of equal or neighbouring size bands are compared. Unless the depth is the last, clusters with
    more than STRAY_BLOCKS blocks of strays in a band are left to branch on, which is cheaper then.
    """
    cluster = components(large.select(F.col("id").alias("a"), F.col("first").alias("b"))).withColumnRenamed("component", "cluster")
    members = large.select("id", "own").distinct().join(cluster, "id").join(sizes, "id")
    band = F.floor(F.log("n") / -math.log(min(share, 99) / 100)).cast("int")
    members = gathered(members.withColumn("band", band), "members")
    parts = members.groupBy("cluster", "own").agg(F.count("*").alias("size"))
    main = parts.groupBy("cluster").agg(F.max_by("own", F.struct("size", "own")).alias("main"))
    members = members.join(main, "cluster").withColumn("stray", F.col("own") != F.col("main"))
    blocks = lambda where: F.ceil(F.greatest(F.count(where) / BLOCK, F.sum(F.when(where, F.col("n"))) / BLOCK_SHINGLES))
    of = members.groupBy("cluster", "band").agg(blocks(F.col("n") > 0).alias("blocks"), blocks(F.when(F.col("stray"), True)).alias("stray_blocks"))
    of = gathered(of, "blocks")
    later = of.where(F.lit(not last) & (F.col("stray_blocks") > STRAY_BLOCKS)).select("cluster").distinct()
    of = of.join(later, "cluster", "left_anti")
    rest = large.join(members.join(later, "cluster", "left_semi").select("id"), "id", "left_semi").drop("own")
    placed = members.join(of, ["cluster", "band"])
    block = lambda count: F.pmod(F.xxhash64("id"), F.col(count))
    next_to = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1))
    beside = lambda count: of.select("cluster", F.col("band").alias("other"), F.col(count).alias("count")).where(F.col(count) > 0)
    strays = placed.where("stray").withColumn("block", block("stray_blocks")).withColumn("other", next_to).join(beside("blocks"), ["cluster", "other"])
    strays = strays.select("cluster", "band", "block", "other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("facing"), "id", "own")
    every = placed.withColumn("facing", block("blocks")).withColumn("other", next_to).join(beside("stray_blocks"), ["cluster", "other"])
    every = every.select("cluster", F.col("other").alias("band"), F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("block"), F.col("band").alias("other"), "facing", "id", "own")
    tile = F.xxhash64("cluster", "band", "block", "other", "facing").alias("tile")
    rows = strays.select(tile, F.lit(0).alias("role"), "id", "own").unionAll(every.select(tile, F.lit(1).alias("role"), "id", "own"))
    return rows, placed.select("id", "cluster"), rest


def links(docs: DataFrame, signed: DataFrame, words: int, share: float, trees: int = TREES) -> DataFrame:
    """Confirmed links between documents with different sets, enough of them to connect each class."""
    texts: list[DataFrame] = []

    def star(candidates: DataFrame, members: DataFrame) -> DataFrame:
        if not texts:  # documents of later depths are members of large nodes here
            wanted = [candidates.select(F.col("a").alias("doc_id")), candidates.select(F.col("b").alias("doc_id")), members.select(F.col("id").alias("doc_id"))]
            own = docs.select("doc_id", "text").join(union(wanted).hint("merge"), "doc_id", "left_semi")
            own = own.withColumnRenamed("doc_id", "id").withColumn("hash", F.xxhash64("text")).dropDuplicates(["id", "hash"])
            texts.append(stored(own.drop("hash"), "texts"))
        return confirm_star(candidates, texts[0], words, share)

    def tiles(large: DataFrame, last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        rows, members, rest = place_large(large, signed.select("id", "n"), share, last)
        return stored(confirm(rows, texts[0], words, share), "links"), gathered(members, "settled"), gathered(rest, "large")

    candidates, found, own = walk(signed, star, tiles, trees)
    return found.unionAll(stored(confirm_apart(candidates, own, texts[0], words, share), "links"))


def near_duplicates(docs: DataFrame, words: int = 5, share: float = 80.0, trees: int = TREES) -> DataFrame:
    """doc_id, set size, smallest id of the class, and whether the document is that one; a row per row of the input."""
    signed = stored(signatures(docs, words, trees), "signatures")
    full = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = stored(full.groupBy("set_id").agg(F.min("id").alias("first")), "classes")
    distinct = signed.drop("set_id").where(F.col("n") > 0).join(classes.select(F.col("first").alias("id")).hint("merge"), "id", "left_semi")
    # texts that share an id are one document
    several = full.groupBy("id").agg(F.min("set_id").alias("least"), F.max("set_id").alias("set_id")).where("least <> set_id").select("id")
    several = full.join(several, "id", "left_semi").join(classes, "set_id").select(F.col("id").alias("a"), F.col("first").alias("b"))
    with temporary(docs.sparkSession):
        found = links(docs, stored(distinct, "distinct"), words, share, trees)
        group = gathered(components(found.unionAll(several)), "groups", keep=True)
    whole = classes.join(group.withColumnRenamed("id", "first"), "first", "left").select("set_id", F.coalesce("component", "first").alias("component"))
    named = signed.select("id", "n", "set_id").join(whole, "set_id", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    out = named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
