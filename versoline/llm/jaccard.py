"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles; two are linked when their sets' Jaccard similarity is
at least percent / 100. Documents with equal sets are one node. The join is exact on 48-bit shingle
hashes:

1. Tokens (shingles) have a global order: rare ones first, frequent ones last, by hash within. Frequent means seen
   often within some task and often enough over all; any fixed choice is correct, so this only decides cost.
2. Linked sets share a token within their prefixes of n - t + 1 tokens, t = ceil(percent * n / 100).
   Rare tokens of the prefix are indexed singly. If linked sets share no rare token there, they share g + 1
   frequent ones within prefixes that are g longer. Frequent tokens fall into g classes by hash, so two shared ones
   are of one class: pairs of a class are indexed. g grows with n, which keeps pairs linear in n.
3. Each key's nodes are verified against one of them, the pivot, which makes as many candidates as there are index rows at most.
   Verified links give components. Keys that still have several components get other pivots, and then all pairs
   of their nodes that are of different components are verified.
4. Length, position and a parity sketch bound a pair's similarity from above; only pairs that may be linked are verified.

Pairs inside a component aren't verified one by one: they can't change what the join returns. No key,
candidate or partner is capped.

Defined cases: null, empty and blank texts have empty sets and are linked with nothing; fewer words than a shingle make one
shingle of the whole sequence; repeated rows are copies; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ODD, U, Scratch, aside, cut, give_back, hashed, held, mixed, slices, stored, table, tidy, words_of
from .components import components, merged

WORDS = 4
PERCENT = 85
#: A token is frequent if some task saw it in LOCAL sets and all tasks in OVERALL; the table of such tokens is bounded.
LOCAL, OVERALL, MOST_FREQUENT = 3, 32, 1_000_000
#: Tokens that a task counts at once, and set digests it remembers to count copies once.
WINDOW_TOKENS, SEEN_SETS = 1_500_000, 100_000
#: Bytes of text taken apart at once.
PART = 1 << 20
#: Bits of the filters that keep shared keys and texts of candidates; their size does not depend on the input.
FILTER_BITS = 1 << 26
#: Pivots in each round: one order of nodes for all keys, then so many orders by key.
ORDERS = (1, 16)
#: Keys of more nodes are compared in families, with sketches at hand, in blocks of so many nodes.
FEW, BLOCK = 32, 1024
#: Parts that rows of a family are dealt to before they meet its size.
SALTS = 64

SALT = np.arange(1, 65, dtype=U) * ODD[0]


def shingle_sets(texts: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the distinct shingles of texts without nulls, by row and token. Tokens have 48 bits, rows 16."""
    offsets, codes, dictionary = words_of(texts)
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, U)
    word = hashed(pc.ascii_lower(dictionary))
    counts = np.diff(offsets)
    n = len(codes)
    tokens = np.zeros(n, U)
    for k in range(width):
        tokens[: max(n - k, 0)] += mixed(word + SALT[k])[codes[k:]]
    row = np.repeat(np.arange(len(counts)), counts)
    whole = (np.arange(n) + width) <= offsets[row + 1]
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        a, b = offsets[r], offsets[r + 1]
        tokens[a] = sum((mixed(word[codes[a + k : a + k + 1]] + SALT[k]) for k in range(b - a)), np.array([b - a], U) * ODD[3])[0]
        whole[a] = True
    both = np.sort(row[whole].astype(U) << U(48) | mixed(tokens[whole]) >> U(16))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    both = both[new]
    return (both >> U(48)).astype(np.int64), both & U((1 << 48) - 1)


def sketches(row: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A list of 64-bit words for each set: which of its buckets have an odd number of tokens.

    A set of n tokens has the least 64 * 2^k buckets that are 2 n or more. Where two sketches of one length differ, the sets
    differ by a token at least: so the number of such bits never is above the size of the symmetric
    difference. The halves of a sketch, XORed, are the sketch of half the length.
    """
    words = 1 << np.ceil(np.log2(np.maximum(1, sizes / 32))).astype(np.int64)
    ends = np.cumsum(words)
    bucket = (ends - words)[row] * 64 + (tokens.view(np.int64) & (words[row] * 64 - 1))
    odd = np.bincount(bucket, minlength=(ends[-1] if len(ends) else 0) * 64) & 1
    bits = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(bits))


def digests(row: np.ndarray, tokens: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The size of each row's set, and a 64-bit digest of it."""
    sizes = np.bincount(row, minlength=rows)
    out = np.zeros(rows, U)
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    if len(full):
        out[full] = mixed(np.add.reduceat(mixed(tokens + ODD[0]), starts) + mixed(np.bitwise_xor.reduceat(tokens * ODD[1], starts)) + sizes[full].astype(U))
    return sizes, out.view(np.int64)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    return (n * percent + 99) // 100


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def index_rows(row: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, frequent: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, key, position) in parts: the index entries of each set."""
    at = np.minimum(np.searchsorted(frequent, tokens), max(len(frequent) - 1, 0))
    often = frequent[at] == tokens if len(frequent) else np.zeros(len(tokens), bool)
    if often.any():
        order = np.argsort(row * 2 + often, kind="stable")
        row, tokens, often = row[order], tokens[order], often[order]
    n = sizes[row]
    position = np.arange(len(row)) - starts_of(sizes)[row]
    prefix = n - needed(n, percent) + 1
    # some larger or smaller set can be linked at all
    could = (n * 100 >= percent * (n + 1)) | ((n - 1) * 100 >= percent * n)
    single = could & ~often & (position < prefix)
    yield row[single], tokens[single], position[single]
    pairs = np.zeros(len(sizes), bool)
    pairs[row[could & often & (position < prefix)]] = True
    if pairs.any():
        level_high = np.log2(np.maximum(sizes, 1)).astype(np.int64)
        level_low = np.log2(np.maximum(needed(sizes, percent), 1)).astype(np.int64)
        for level, wanted in ((level_high, pairs), (level_low, pairs & (level_low != level_high))):
            classes = np.maximum(1, 1 << np.maximum(level - 4, 0))
            use = wanted[row] & often & (position < prefix + classes[row])
            r, t = row[use], tokens[use]
            c = ((t >> U(17)) % classes[r].astype(U)).astype(np.int64)
            o = np.lexsort((t, c, r))
            r, t, c = r[o], t[o], c[o]
            salt = (level[r].astype(U) + U(1)) * ODD[2]
            for s in range(1, len(r)):
                same = np.flatnonzero((r[:-s] == r[s:]) & (c[:-s] == c[s:]))
                if not len(same):
                    break
                key = mixed(mixed(t[same]) * ODD[0] + mixed(t[same + s] + ODD[3]) + salt[same])
                yield r[same], key, np.zeros(len(same), np.int64)


def documents_pass(width: int, percent: int):
    """Rows of kind 0: doc_id, tag, set size, digest, sketch. Of kind 1: a token seen in several sets of this task, and in how many."""
    schema = "kind int, id long, tag long, n long, node long, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        window: list[np.ndarray] = []
        held_tokens = 0

        def counted() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(window), return_counts=True) if window else (np.zeros(0, U), np.zeros(0, np.int64))
            keep = times >= LOCAL
            none = np.zeros(keep.sum(), np.int64)
            return batch_of(np.ones(keep.sum(), np.int32), tokens[keep].view(np.int64), none, times[keep], none, pa.nulls(keep.sum(), pa.list_(pa.int64())))

        def batch_of(kind, ids, tag, n, node, sketch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *(pa.array(x, pa.int64()) for x in (ids, tag, n, node)), sketch], ["kind", "id", "tag", "n", "node", "sketch"])

        for batch in batches:
            ids, tag = batch.column(0), batch.column(2)
            for start, stop in slices(batch.column(1), PART):
                texts = held(batch.column(1).slice(start, stop - start))
                row, tokens = shingle_sets(texts, width)
                sizes, node = digests(row, tokens, len(texts))
                yield batch_of(np.zeros(len(texts), np.int32), ids.slice(start, stop - start), tag.slice(start, stop - start), sizes, node, sketches(row, tokens, sizes))
                if len(seen) > SEEN_SETS:
                    seen.clear()
                fresh = np.zeros(len(texts), bool)
                for r, d in enumerate(node.tolist()):
                    if d not in seen:
                        seen.add(d)
                        fresh[r] = True
                window.append(tokens[fresh[row]])
                held_tokens += len(window[-1])
                if held_tokens > WINDOW_TOKENS:
                    yield counted()
                    window, held_tokens = [], 0
        yield counted()

    return tidy(run), schema


def index_pass(width: int, percent: int, frequent, shared=None):
    """Index rows; of those keys only whose bits are in shared, if that is given."""
    schema = "key long, node long, n int, pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(frequent.value, U)
        bits = None if shared is None else np.frombuffer(shared.value, U)
        seen: set[int] = set()
        for batch in batches:
            for start, stop in slices(batch.column(0), PART):
                texts = held(batch.column(0).slice(start, stop - start))
                row, tokens = shingle_sets(texts, width)
                sizes, node = digests(row, tokens, len(texts))
                if len(seen) > SEEN_SETS:
                    seen.clear()
                fresh = np.zeros(len(texts), bool)
                for r, d in enumerate(node.tolist()):
                    if d not in seen:
                        seen.add(d)
                        fresh[r] = True
                keep = fresh[row]
                row, tokens = row[keep], tokens[keep]
                for r, key, pos in index_rows(row, tokens, np.where(fresh, sizes, 0), often, percent):
                    if bits is not None:
                        there = has_bit(bits, key)
                        r, key, pos = r[there], key[there], pos[there]
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node[r]), pa.array(sizes[r].astype(np.int32)), pa.array(pos.astype(np.int32))], ["key", "node", "n", "pos"])

    return tidy(run), schema


def has_bit(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids.view(U) & U(FILTER_BITS - 1)
    return (bits[(at >> U(6)).view(np.int64)] >> (at & U(63)) & U(1)).astype(bool)


def sets_pass(width: int, wanted):
    """(node, tokens) of the documents whose ids' bits are set."""
    schema = "node long, tokens array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, U)
        for batch in batches:
            ids = pc.fill_null(batch.column(0), 0).to_numpy()
            batch = batch.filter(pa.array(has_bit(bits, ids)))
            for start, stop in slices(batch.column(1), PART):
                texts = held(batch.column(1).slice(start, stop - start))
                row, tokens = shingle_sets(texts, width)
                sizes, node = digests(row, tokens, len(texts))
                full = sizes > 0
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[full])]).astype(np.int32)), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(node[full]), lists], ["node", "tokens"])

    return tidy(run), schema


def frequent_tokens(counted: DataFrame) -> np.ndarray:
    """The sorted tokens of the frequent class; its cutoff rises until the table fits its bound."""
    total = cut(counted.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= OVERALL))
    steps = total.groupBy(F.floor(F.log2("n")).alias("e")).count().orderBy(F.desc("e")).collect()  # at most 63 rows
    size, least = 0, OVERALL
    for e, count in steps:
        if size + count > MOST_FREQUENT:
            least = 2 ** (e + 1)
            break
        size += count
    rows = total.where(F.col("n") >= least).select("id").toArrow()
    return np.sort(rows.column("id").to_numpy().view(U))


def filter_of(ids: DataFrame) -> bytes:
    """A bit set of FILTER_BITS bits with those of the ids of a one-column table."""
    ids = ids.toDF("id")
    bit = F.col("id").bitwiseAND(FILTER_BITS - 1)
    words = ids.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(id & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


class Join:
    """The steps of near_duplicates() that need the same tables."""

    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.width, self.percent, self.spark = width, percent, docs.sparkSession
        self.scratch = Scratch(self.spark)
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag"))
        run, schema = documents_pass(width, percent)
        first = stored(self.texts.mapInArrow(run, schema), "sets")
        self.rows = first.where("kind = 0").select(F.col("id").alias("doc_id"), "tag", F.col("n").alias("n_shingles"), "node")
        self.counted = first.where("kind = 1").select("id", "n")
        one = first.where("kind = 0 and n > 0").groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        self.nodes = stored(one, "nodes")

    def near(self, x: str, y: str):
        """What the sizes and the places of a shared key allow. x and y: suffixes of n and pos."""
        n, m, i, j = (F.col(c) for c in (f"n{x}", f"n{y}", f"pos{x}", f"pos{y}"))
        p = self.percent
        return (100 * F.least(n, m) >= p * F.greatest(n, m)) & ((100 + p) * F.least(n - i, m - j) >= p * (n + m))

    def alike(self, x: str, y: str):
        """What the sketches allow; the longer one, which has twice the words at most where sizes are near, is folded."""
        one, two = F.col(f"sketch{x}"), F.col(f"sketch{y}")
        words = F.least(F.size(one), F.size(two))
        fold = lambda s: F.when(F.size(s) == words, s).otherwise(F.zip_with(F.slice(s, F.lit(1), words), F.slice(s, words + 1, words), lambda a, b: a.bitwiseXOR(b)))
        apart = F.aggregate(F.zip_with(fold(one), fold(two), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, bits: total + bits)
        return (100 + self.percent) * apart <= (100 - self.percent) * (F.col(f"n{x}") + F.col(f"n{y}"))

    def index(self) -> DataFrame:
        """(key, node, n, pos) of keys that several nodes have."""
        often = self.spark.sparkContext.broadcast(frequent_tokens(self.counted).tobytes())
        rows = self.texts.select("text")
        run, schema = index_pass(self.width, self.percent, often)
        # tasks may both emit a copy; least and last differ only if a key has two nodes
        ends = rows.mapInArrow(run, schema).groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
        keys = self.scratch.stored(ends.where("lo < hi").select("key"), "keys")
        run, schema = index_pass(self.width, self.percent, often, self.spark.sparkContext.broadcast(filter_of(keys)))
        return self.scratch.stored(rows.mapInArrow(run, schema).join(keys, "key", "left_semi").distinct(), "index")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of nodes, those whose sets are similar enough."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(self.nodes, "node").select(F.coalesce("least", F.lit(0)))
        run, schema = sets_pass(self.width, self.spark.sparkContext.broadcast(filter_of(ids)))
        sets = self.texts.select("doc_id", "text").mapInArrow(run, schema).groupBy("node").agg(F.first("tokens").alias("tokens"))
        one = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
        two = one.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return self.scratch.stored(two.where(100 * both >= self.percent * (F.size("x") + F.size("y") - both)).select("a", "b"), "links")

    def met(self, one: DataFrame, two: DataFrame, once: bool, by: tuple[str, ...] = ("key",)) -> DataFrame:
        """Distinct (a, b) of different components that share a key and whose similarity isn't ruled out by sizes and places, nor by sketches if rows have them."""
        columns = [c for c in two.columns if c not in by]
        one, two = (df.select(*by, *(F.col(c).alias(f"{c}{x}") for c in columns)) for df, x in ((one, "_x"), (two, "_y")))
        apart = (F.col("root_x") != F.col("root_y")) & (F.lit(not once) | (F.col("node_x") < F.col("node_y")))
        both = one.join(two, list(by)).where(apart & self.near("_x", "_y"))
        both = both.where(self.alike("_x", "_y")) if "sketch" in columns else both
        return both.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()

    def with_pivots(self, part: DataFrame, orders: int) -> DataFrame:
        """Pairs of each node with the pivot of its key: the key's first node in one of so many orders."""
        columns = ("node", "n", "pos", "root")
        first = F.min_by(F.struct(*columns), F.xxhash64("node", F.pmod("key", F.lit(orders))))
        return self.met(part.groupBy("key").agg(first.alias("p")).select("key", "p.*"), part.select("key", *columns), once=False)

    def all_pairs(self, part: DataFrame) -> DataFrame:
        """All pairs of nodes of different components in each key.

        Nodes of keys with many nodes share most of such keys with each other, and would meet in each. So the nodes that such keys
        connect are a family, and where that means no more comparisons, pairs of a family are compared once. Families are found
        over keys, each linked to the least key of its nodes: far fewer links than rows of the index.
        """
        part = part.select("key", "node", "n", "pos", "root", "nodes")
        few = part.where(F.col("nodes") <= FEW).drop("nodes")
        many = cut(part.where(F.col("nodes") > FEW))
        if many.isEmpty():
            return self.met(few, few, once=True)
        least = many.groupBy("node").agg(F.min("key").alias("least"))
        keys = many.select("node", "key").join(least, "node").select(F.col("least").alias("a"), F.col("key").alias("b"))
        family = components(keys.distinct()).select(F.col("node").alias("key"), F.col("root").alias("family"))
        rows = self.scratch.stored(many.join(family, "key", "left").withColumn("family", F.coalesce("family", "key")), "families")
        sizes = rows.groupBy("family", "node").agg(F.sum("nodes").alias("met")).groupBy("family").agg(F.count("*").alias("members"), F.sum("met").alias("met"))
        whole = cut(sizes.select("family", "members", (F.col("members") * F.col("members") <= F.col("met")).alias("together")))
        # a family may hold most rows, so they are dealt by a salt as well
        salted = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("node", "key"), F.lit(SALTS)).cast("int")).join(salted, ["family", "salt"])
        once = rows.where("together").select(F.col("family").alias("key"), "node", "n", F.lit(0).alias("pos"), "root", F.col("members").alias("nodes")).distinct()
        each = rows.where("not together").select("key", "node", "n", "pos", "root", "nodes")
        placed = self.scratch.stored(once.union(each).join(self.nodes.select("node", "sketch"), "node"), "many")
        # each pair of blocks is one group; a node is in one block and is sent to every other
        blocks = F.ceil(F.col("nodes") / BLOCK).cast("int")
        own, every = F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
        columns = ("key", "node", "n", "pos", "root", "sketch")
        one, two = placed.select(*columns, own.alias("i"), every.alias("j")), placed.select(*columns, own.alias("j"), every.alias("i"))
        return self.met(few, few, once=True).union(self.met(one.select(*columns, "i", "j"), two.select(*columns, "i", "j"), once=True, by=("key", "i", "j"))).distinct()

    def screened(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that sketches don't rule out."""
        side = lambda c, x: self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"sketch{x}"))
        return pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b").where(self.alike("_x", "_y")).select("a", "b")

    def roots(self) -> DataFrame:
        """(node, root) of the nodes that have links. What it takes to find them is dropped; it is needed no more."""
        index = self.index()
        part = index.withColumn("root", F.col("node"))
        roots = tested = None
        for orders in (*ORDERS, 0):
            pairs = self.screened(self.scratch.stored(self.with_pivots(part, orders) if orders else self.all_pairs(part), "met"))
            pairs = self.scratch.stored(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
            if not pairs.isEmpty():
                tested = pairs if tested is None else tested.union(pairs)
                roots = merged(roots, self.verified(pairs))
            give_back()
            self.spark.sparkContext._jvm.System.gc()  # for the shuffle files of this round
            if orders:
                if roots is not None:
                    part = part.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
                part = part.drop("nodes")
                split = part.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("nodes")).where("lo < hi").select("key", "nodes")
                part = self.scratch.stored(part.join(split, "key"), "part")
        self.scratch.drop()
        return self.nodes.select("node", F.col("node").alias("root")).limit(0) if roots is None else roots


def with_groups(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows with words (doc_id, tag, n_shingles, group, component), tag a hash of the text, and those without (doc_id, tag, n_shingles)."""
    join = Join(docs, width, percent)
    roots, nodes = join.roots(), join.nodes.select("node", "least")
    grouped = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("group"))
    least = grouped.where("node <> group").groupBy("group").agg(F.min("least").alias("other"))
    first = grouped.where("node = group").join(least, "group", "left").select("group", F.least("least", "other").alias("component"))
    found = stored(grouped.join(first, "group").select("node", "group", "component"), "components")
    full = join.rows.where("n_shingles > 0").join(found, "node").select("doc_id", "tag", "n_shingles", "group", "component")
    return full, join.rows.where("n_shingles = 0").select("doc_id", "tag", "n_shingles")


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row per row of docs (doc_id, text): doc_id, n_shingles, component_id. At most 64 words make a shingle.

    component_id is the least doc_id that links lead to; nulls among ids count only where there is no other.
    """
    full, empty = with_groups(docs, width, percent)
    return full.select("doc_id", "n_shingles", F.col("component").alias("component_id")).union(empty.select("doc_id", "n_shingles", "doc_id"))


def one_of_each(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component of docs, with all columns: that of the least doc_id.

    Rows without words are linked with nothing, and rows without a doc_id take no part: they stay. Of rows that are repeated in id and text,
    the one with the least hash stays; where an id has several texts, each counts for itself, and ties go by the text's hash.
    """
    docs, restored = aside(docs, ("doc_id", "text"))
    docs = docs.withColumn("tag", F.xxhash64("text"))
    full, empty = with_groups(docs.where("doc_id is not null"), width, percent)
    full = stored(full, "groups")
    first = full.groupBy("group").agg(F.min(F.struct("doc_id", "tag")).alias("one")).select("one.*")
    kept = docs.join(stored(first.union(empty.select("doc_id", "tag")).distinct(), "kept"), ["doc_id", "tag"], "left_semi")
    twice = cut(kept.groupBy("doc_id", "tag").count().where("count > 1").select("doc_id", "tag"))
    if not twice.isEmpty():
        row = F.struct(*docs.columns)
        one = kept.join(twice, ["doc_id", "tag"], "left_semi").select("doc_id", "tag", row.alias("row")).groupBy("doc_id", "tag").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(twice, ["doc_id", "tag"], "left_anti").select(*docs.columns).union(one.select("row.*"))
    return restored(kept.select(*docs.columns).union(docs.where("doc_id is null")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
