"""Packing by lexical retrieval: a sharded BM25 index finds the documents that share a window.

Documents stream through each task in shards of bounded size. A shard has an inverted index of its words
with BM25 weights; idf comes from exact counts over all documents, gathered in a first pass. The words that are in most have
theirs in a table that every task gets. Of the rest, each task gets the counts of the words that several of its documents
have: no other word of it can rank anything. They come first in its partition, to which the documents are sent with them.
A window of 4096 ids starts with a seed: what is left of the last document, or else the next unused one. It is filled
greedily with the shard's unused documents, those first that score best for all words of the seed, and with the next unused
one where none shares a word. A document that does not fit is cut, and what is left of it seeds the next window; a shard's
leftover seeds the next shard. At the end of a task the rest is laid out in sequences whose lengths are powers of
two, which need no padding.

Ids never leave the task that made them: nothing is shuffled but the word counts and, where there are too many words for one
table, the texts once. A sequence's number is the partition of its documents and a count within it. The
documents are read twice, and must lie in the same partitions both times, as those of a table do; a word whose count is
missing because they don't is an error.

Defined cases: null and empty texts are a document of the end id alone; repeated rows are packed each; an
empty table gives no rows; other columns are ignored; texts of any length are cut over windows; null ids
are kept as they are; ties in rank go to the document that comes first.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hashed, held, slices, stored, table, tidy, words_of

WINDOW, END_ID = 4096, 2
#: A shard is closed at so many documents or ids.
SHARD_DOCS, SHARD_IDS = 2000, 1_500_000
#: Words of more than this share of a shard's documents have a weight for each document, others have lists.
COMMON = 0.125
#: Words whose document frequency every task gets (of others, a task gets those of its own), and words that a task counts at once.
MOST_WORDS, COUNTED = 500_000, 1_000_000
#: Bytes of text that are counted, and that are encoded, at once.
COUNT_BYTES, ENCODE_BYTES = 2 << 20, 4 << 20
#: Counts that go to Spark at once.
SENT = 1 << 16
K1, B = 1.2, 0.75
#: Ranks that are sorted first.
FIRST = 64
#: Words whose ids a worker keeps, and bytes of both.
KEPT_WORDS, KEPT_BYTES = 800_000, 64 << 20
#: Lower-case letters that no normalisation changes.
LETTERS = "^[a-zà-öø-ÿ]+$"
#: Words that come to the model of a tokenizer whole and unchanged, if these are its steps before.
PLAIN = "^[a-z]+$"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTER = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: ASCII marks that are split off the end of a word, as they never share a token with a letter or digit before them.
MARKS = '.,!?;:%&$#*|()'

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


COUNTS = "word long, docs long, words long, part int"


def counts_of(word: np.ndarray, docs: np.ndarray, part: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTS for words, a bounded number at once."""
    rows = pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(docs, pa.int64()), pa.nulls(len(word), pa.int64()), part], ["word", "docs", "words", "part"])
    for a in range(0, len(word), SENT):
        yield rows.slice(a, SENT)


def count_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, docs, words, part): in how many documents of a partition a hashed word is, each word once for every COUNTED that are held; word null: documents and words."""
    part = TaskContext.get().partitionId()
    held_words: list[np.ndarray] = []
    held_docs: list[np.ndarray] = []
    docs = words = waiting = 0

    def counted() -> Iterator[pa.RecordBatch]:
        word, at = np.unique(np.concatenate(held_words or [np.zeros(0, np.int64)]), return_inverse=True)
        n = np.bincount(at, np.concatenate(held_docs or [np.zeros(0)]), len(word)).astype(np.int64)
        yield from counts_of(word, n, pa.array(np.full(len(word), part, np.int32)))

    for batch in batches:
        for start, stop in slices(batch.column(0), COUNT_BYTES):
            offsets, codes, dictionary = words_of(held(batch.column(0).slice(start, stop - start)))
            if len(codes):
                row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
                both = np.sort(row * len(dictionary) + codes)
                new = np.ones(len(both), bool)
                new[1:] = both[1:] != both[:-1]
                held_words.append(hashed(dictionary).view(np.int64))
                held_docs.append(np.bincount(both[new] % len(dictionary), minlength=len(dictionary)))
                waiting += len(dictionary)
            docs, words = docs + len(offsets) - 1, words + len(codes)
            if waiting > COUNTED:
                yield from counted()
                held_words, held_docs, waiting = [], [], 0
    yield from counted()
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([docs]), pa.array([words]), pa.array([part], pa.int32())], ["word", "docs", "words", "part"])


def merge_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the rows of count_pass(), all of a word together: docs is of all partitions, in a row without a part for each word of several documents, and in one for each part that has several of them.

    Rows without a word come first, and stay as they are.
    """

    def merged(word: np.ndarray, docs: np.ndarray, part: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(word):
            return
        first = np.concatenate([[True], word[1:] != word[:-1]])
        word, run = word[first], np.cumsum(first) - 1
        total = np.add.reduceat(docs, np.flatnonzero(first))
        several = total[run] > 1
        key, at = np.unique(run[several] << 32 | part[several], return_inverse=True)
        key = key[np.bincount(at, docs[several], len(key)) > 1]
        yield from counts_of(word[total > 1], total[total > 1], pa.nulls(int((total > 1).sum()), pa.int32()))
        yield from counts_of(word[key >> 32], total[key >> 32], pa.array((key & 0xFFFFFFFF).astype(np.int32)))

    left = (np.zeros(0, np.int64),) * 3
    for batch in batches:
        none = batch.column(0).null_count
        if none:
            yield batch.slice(0, none)
        word, docs, part = (np.concatenate([old, batch.column(k).slice(none).to_numpy()]) for old, k in zip(left, (0, 1, 3), strict=True))
        end = np.searchsorted(word, word[-1]) if len(word) else 0
        left = (word[end:], docs[end:], part[end:])  # the next batch may go on with this word
        yield from merged(word[:end], docs[:end], part[:end])
    yield from merged(*left)


class Statistics(NamedTuple):
    """Of all documents: how many there are, their mean words, and in how many each frequent word is, by sorted hash. Others are in fewer than least.

    rest and rest_counts: the same of other words that several documents of one partition have.
    """

    docs: int
    mean_words: float
    words: np.ndarray
    counts: np.ndarray
    least: int
    rest: np.ndarray = np.zeros(0, np.int64)
    rest_counts: np.ndarray = np.zeros(0, np.int64)

    def counted(self, words: np.ndarray) -> np.ndarray:
        """In how many documents each of sorted hashed words is; 0 for a word without a count."""
        df = np.zeros(len(words), np.int64)
        for known, counts in ((self.words, self.counts), (self.rest, self.rest_counts)):
            if len(known):
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                df = np.where(known[at] == words, counts[at], df)
        return df

    def idf(self, words: np.ndarray, here: np.ndarray) -> np.ndarray:
        """Weights of sorted hashed words; here: in how many documents of the shard each is. A word without a count is in no other document of the partition."""
        return self.weights(self.counted(words), here)

    def known_idf(self, words: np.ndarray, here: np.ndarray) -> np.ndarray:
        """idf(), where each word that several documents have must have a count."""
        df = self.counted(words)
        if ((df == 0) & (here > 1)).any():
            raise ValueError("documents are in other partitions than when their words were counted: store them first")
        return self.weights(df, here)

    def weights(self, df: np.ndarray, here: np.ndarray) -> np.ndarray:
        df = np.where(df > 0, df, here)
        return np.log1p((np.maximum(self.docs - df, 0) + 0.5) / (df + 0.5))


def corpus_counts(docs: DataFrame, scratch: Scratch) -> tuple[Statistics, DataFrame | None]:
    """Counts over all of docs, exact for each word: of at most MOST_WORDS frequent ones, and, where there are more, (part, word, docs) of the others in several documents of a partition.

    A word of one document needs none. A word that is in several documents of no partition ranks nothing, as retrieval looks within one.
    """
    raw = docs.select("text").mapInArrow(tidy(count_pass), COUNTS)
    counted = scratch.stored(raw.repartition("word").sortWithinPartitions("word").mapInArrow(tidy(merge_pass), COUNTS), "words")
    n, n_words = counted.where("word is null").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    words = counted.where("word is not null")
    total = words.where("part is null")
    steps = total.groupBy(F.floor(F.log2("docs")).alias("e")).count().orderBy(F.desc("e")).collect()  # at most 63 rows
    size, least = 0, 2
    for e, count in steps:
        if size + count > MOST_WORDS:
            least = 2 ** (e + 1)
            break
        size += count
    rows = total.where(F.col("docs") >= least).select("word", "docs").toArrow()
    frequent, times = rows.column("word").to_numpy(), rows.column("docs").to_numpy()
    order = np.argsort(frequent)
    known = Statistics(n, max(1.0, n_words / max(1, n)), frequent[order], times[order], least)
    if least <= 2:
        return known, None
    return known, words.where(F.col("part").isNotNull() & (F.col("docs") < least)).select("part", "word", "docs")


def corpus_statistics(docs: DataFrame) -> Statistics:
    """All counts of corpus_counts(), for use in one process; pack() leaves the rest to the partitions that have its words."""
    scratch = Scratch(docs.sparkSession)
    known, rest = corpus_counts(docs, scratch)
    if rest is not None:
        others = rest.select("word", "docs").distinct().orderBy("word").toArrow()
        known = known._replace(rest=others.column("word").to_numpy(), rest_counts=others.column("docs").to_numpy())
    scratch.drop()
    return known


class Encoder:
    """Ids of texts by a tokenizer that never joins words: each distinct word is encoded once and kept.

    What is kept lies in arrays: a piece in pieces, its ids up to its end in ids. It is found by its hash, and then compared.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        if steps["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZER} and steps["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": SPLITTER}:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.ends_word[k] = token.endswith("</w>")
        self.pieces, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted, and the piece of each

    def each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces, encoded one by one."""
        found = [np.array(e.ids, np.uint32) for a in range(0, len(pieces), 10_000) for e in self.tokenizer.encode_batch_fast(pieces[a : a + 10_000], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)

    def of_letters(self, pieces: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces of letters alone, each one word to the tokenizer, encoded as one text: its ids say where words end."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            return self.each(pieces)  # not such a tokenizer
        return ids, np.diff(ends, prepend=0)

    def known(self, pieces: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The kept rows of pieces, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(pieces), -1)
        order = np.argsort(hashes)  # neighbours are looked up one after another
        at = np.empty(len(hashes), np.int64)
        at[order] = np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self.hashes) - 1)
        met = np.flatnonzero(self.hashes[at] == hashes)
        found, rows = self.rows[at[met]], np.full(len(pieces), -1)
        same = pc.equal(self.pieces.take(pa.array(found)), pieces.take(pa.array(met))).to_numpy(zero_copy_only=False)
        rows[met[same]] = found[same]
        return rows

    def of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ends, rows): the ids of piece k are those of rows[k]. What is learnt first, and so is common, is kept; the rest serves this call. None is empty."""
        hashes = hashed(pieces)
        rows = self.known(pieces, hashes)
        new = np.flatnonzero(rows < 0)
        learnt = pieces.take(pa.array(new))
        kind = 2 - sum(pc.match_substring_regex(learnt, which).to_numpy(zero_copy_only=False).astype(np.int64) for which in (LETTERS, PLAIN))
        order = np.argsort(kind, kind="stable")
        new, learnt = new[order], learnt.take(pa.array(order))
        texts, found = learnt.to_pylist(), []
        plain, letters = np.cumsum(np.bincount(kind, minlength=3))[:2].tolist()
        for a, b, tokenizer in ((0, plain, self.bare or self.tokenizer), (plain, letters, self.tokenizer)):
            found += [self.of_letters(texts[k : min(b, k + 1000)], tokenizer) for k in range(a, b, 1000)]
        found.append(self.each(texts[letters:]))
        rows[new] = len(self.ends) + np.arange(len(new))
        ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(np.concatenate([sizes for _, sizes in found]))])
        ids = np.concatenate([self.ids, *(i for i, _ in found)])
        if len(new) and len(self.ends) < KEPT_WORDS and self.pieces.nbytes + ids.nbytes < KEPT_BYTES:
            order = np.argsort(hashes[new])
            at = np.searchsorted(self.hashes, hashes[new][order])
            self.hashes, self.rows = np.insert(self.hashes, at, hashes[new][order]), np.insert(self.rows, at, rows[new][order])
            self.pieces, self.ids, self.ends = pa.concat_arrays([self.pieces, learnt]), ids, ends
        return ids, ends, rows

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of words. A word is a stem, in lower case, and marks: far fewer stems than words are new."""
        stems = pc.utf8_rtrim(words, MARKS)
        plain = pc.invert(pc.match_substring(words, "<"))  # special tokens stay as they are
        apart = pc.and_(pc.match_substring_regex(stems, "[A-Za-z0-9]$|[à-öø-ÿ]$"), plain)
        stems = pc.if_else(apart, stems, words)
        coded = pc.if_else(plain, pc.ascii_lower(stems), stems).dictionary_encode()
        # the marks are what the stem lacks of the word, all of them single bytes
        lacks = pc.binary_length(words).to_numpy() - pc.binary_length(stems).to_numpy()
        marked = lacks > 0
        tails = last_bytes(words.filter(pa.array(marked)), lacks[marked]).dictionary_encode()
        ids, ends, rows = self.of_pieces(pa.concat_arrays([coded.dictionary, tails.dictionary]))
        order = np.zeros((len(words), 2), np.int64)
        order[:, 0] = rows[coded.indices.to_numpy(zero_copy_only=False)]
        order[marked, 1] = rows[len(coded.dictionary) + tails.indices.to_numpy(zero_copy_only=False)]
        ids, ends = gathered(ids, ends, order[np.stack([np.ones(len(words), bool), marked], 1)])
        return ids, ends[np.cumsum(1 + marked) - 1]

    def texts(self, offsets: np.ndarray, codes: np.ndarray, dictionary: pa.Array) -> list[np.ndarray]:
        """The ids of each row and END_ID."""
        ids, ends = self.of_words(dictionary)
        flat, after = gathered(ids, ends, codes)
        bounds = np.concatenate([[0], after])[offsets]
        out = np.empty(len(flat) + len(offsets) - 1, np.uint32)
        rows = np.arange(len(offsets) - 1)
        out[bounds[1:] + rows] = END_ID
        body = np.ones(len(out), bool)
        body[bounds[1:] + rows] = False
        out[body] = flat
        return [out[a + r : b + r + 1] for r, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))]


def last_bytes(words: pa.Array, n: np.ndarray) -> pa.Array:
    """The last n bytes of each of words (large strings without nulls)."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[words.offset + 1 : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)
    after = np.cumsum(n)
    flat = data[np.repeat(ends - after, n) + np.arange(after[-1] if len(n) else 0)]
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], after]).astype(np.int64)), pa.py_buffer(flat))


def gathered(ids: np.ndarray, ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) of parts in another order, in which parts may repeat."""
    if not len(order):
        return ids[:0], np.zeros(0, np.int64)
    sizes = np.diff(ends, prepend=0)
    many = sizes[order]
    after = np.cumsum(many)
    return ids[np.repeat((ends - sizes)[order] - after + many, many) + np.arange(after[-1])], after


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each worker process, as what it knows serves its later tasks too."""
    return Encoder(path)


class Index:
    """BM25 postings of a shard's words."""

    def __init__(self, words: list[np.ndarray], idf: Callable[[np.ndarray, np.ndarray], np.ndarray], mean_words: float):
        """words: hashed words of each document; idf: of sorted words and the documents here that have them."""
        self.words = words
        sizes = np.array([len(w) for w in words], np.int64)
        doc = np.repeat(np.arange(len(words)), sizes)
        flat = np.concatenate(words) if len(words) else np.zeros(0, np.int64)
        term_of, term = np.unique(flat, return_inverse=True)
        both, tf = np.unique(term.astype(np.int64) * len(words) + doc, return_counts=True)
        term, self.doc = both // len(words), both % len(words)
        weight = idf(term_of, np.bincount(term, minlength=len(term_of)))[term]
        norm = K1 * (1 - B + B * sizes / mean_words)
        self.weight = (weight * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        self.bounds = np.searchsorted(term, np.arange(len(term_of) + 1))
        # each document's words that another one has too
        self.terms, self.sizes = term_of, np.diff(self.bounds)
        sizes = self.sizes
        shared = sizes[term] > 1
        t, d = term[shared], self.doc[shared]
        self.query, self.query_bounds = t[np.argsort(d.astype(np.uint16 if len(words) <= 1 << 16 else np.int64), kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(words)))])
        # the weights of common words, a row each; -1 is a word that has a list
        often = np.flatnonzero(sizes > max(1.0, COMMON * len(words)))
        self.row = np.full(len(term_of), -1)
        self.row[often] = np.arange(len(often))
        self.common = np.zeros((len(often), len(words)), np.float32)
        listed = self.row[term]
        self.common[listed[listed >= 0], self.doc[listed >= 0]] = self.weight[listed >= 0]

    def hashes(self, k: int) -> np.ndarray:
        """The distinct words of a document."""
        return np.unique(self.words[k])

    def answers(self, seed: int, used: np.ndarray) -> np.ndarray:
        """All unused documents that share words of the seed, best first."""
        return np.fromiter(self.in_turn(seed, used), np.int64)

    def answers_to(self, hashes: np.ndarray, used: np.ndarray) -> np.ndarray:
        """All unused documents that have some of these words, best first."""
        return np.fromiter(self.in_turn_to(hashes, used), np.int64)

    def in_turn(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """answers(), ranked as far as they are asked for."""
        return by_rank(self.scores(self.query[self.query_bounds[seed] : self.query_bounds[seed + 1]], used))

    def in_turn_to(self, hashes: np.ndarray, used: np.ndarray) -> Iterator[int]:
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        return by_rank(self.scores(at[self.terms[at] == hashes] if len(self.terms) else at[:0], used))

    def scores(self, terms: np.ndarray, used: np.ndarray) -> np.ndarray:
        rows = self.row[terms]
        scores = self.common[rows[rows >= 0]].sum(0).astype(np.float64)
        listed = terms[rows < 0]
        start, many = self.bounds[listed], self.sizes[listed]
        if len(many):
            after = np.cumsum(many)
            at = np.repeat(start - after + many, many) + np.arange(after[-1])
            scores += np.bincount(self.doc[at], self.weight[at], len(used))
        scores[used] = 0
        return scores


def by_rank(scores: np.ndarray) -> Iterator[int]:
    """All places of positive scores, highest first, ties by place. The FIRST are sorted apart, as most callers stop among them."""
    best = np.flatnonzero(scores > 0)
    parts = [best]
    if len(best) > 4 * FIRST:
        values = scores[best]
        first = values >= np.partition(values, len(values) - FIRST)[-FIRST]
        parts = [best[first], best[~first]]
    for part in parts:
        yield from part[np.argsort(-scores[part], kind="stable")].tolist()


class Packer:
    """Lays documents out in windows. Pieces gather in out: (doc_id, start, length, ids of the document, sequence, offset)."""

    def __init__(self, window: int, first: int):
        self.window, self.sequence, self.filled, self.out = window, first, 0, []
        self.seed = np.zeros(0, np.int64)  # words of the open window's seed, as a shard ends

    def put(self, doc_id, ids: np.ndarray, at: int) -> int:
        """Puts what fits of ids from a place on; where the piece ends."""
        n = min(len(ids) - at, self.window - self.filled)
        self.out.append((doc_id, at, n, ids, self.sequence, self.filled))
        self.filled += n
        if self.filled == self.window:
            self.sequence, self.filled = self.sequence + 1, 0
        return at + n

    def shard(self, docs: list[tuple], index: Index) -> None:
        """Packs all of docs, (doc_id, ids); the last window may stay open."""
        used = np.zeros(len(docs), bool)
        queue = index.in_turn_to(self.seed, used) if self.filled else iter(())
        turn, seed = 0, -1
        while True:
            while turn < len(docs) and used[turn]:
                turn += 1
            if turn == len(docs):
                if seed >= 0:
                    self.seed = index.hashes(seed)
                return
            k = next((d for d in queue if not used[d]), turn)
            used[k] = True
            doc_id, ids = docs[k]
            window, at = self.sequence if self.filled else -1, 0
            while at < len(ids):
                at = self.put(doc_id, ids, at)
            if not self.filled:
                queue = iter(())
            elif self.sequence != window:  # it opened this window, whole or as what was left of it
                queue, seed = index.in_turn(k, used), k

    def closed(self) -> list[tuple]:
        """Takes the pieces of full windows out."""
        n = len(self.out)
        while n and self.out[n - 1][4] == self.sequence:
            n -= 1
        done, self.out = self.out[:n], self.out[n:]
        return done

    def tail(self) -> Iterator[tuple]:
        """The pieces of the open window, laid out anew in sequences whose lengths are the powers of two of their sum."""
        left = sum(p[2] for p in self.out)
        room = filled = 0
        for doc_id, start, length, ids, _, _ in self.out:
            end = start + length
            while start < end:
                if not room:
                    room, filled = 1 << (left.bit_length() - 1), 0
                    left -= room
                n = min(end - start, room)
                yield doc_id, start, n, ids, self.sequence, filled
                start, room, filled = start + n, room - n, filled + n
                self.sequence += not room


def as_rows(pieces: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*((d, a, n, zlib.crc32(ids[a : a + n].data), len(ids), s, o) for d, a, n, ids, s, o in pieces), strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def padded_length(n: int, window: int = WINDOW) -> int:
    """What a sequence of n ids takes: nothing is added at a power of two."""
    return n if n & (n - 1) == 0 else window


class Shards:
    """Packs the documents of a partition, shard by shard."""

    def __init__(self, path: str, known: Statistics, window: int, part: int):
        self.encode, self.known, self.packer = encoder(path), known, Packer(window, part << 32)
        self.docs: list[tuple] = []
        self.words: list[np.ndarray] = []
        self.n_ids = 0

    def add(self, names: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        for start, stop in slices(texts, ENCODE_BYTES):
            ids_of = names.slice(start, stop - start).to_pylist()
            offsets, codes, dictionary = words_of(held(texts.slice(start, stop - start)))
            hashes = hashed(dictionary).view(np.int64)
            for r, ids in enumerate(self.encode.texts(offsets, codes, dictionary)):
                self.docs.append((ids_of[r], ids))
                self.words.append(hashes[codes[offsets[r] : offsets[r + 1]]])
                self.n_ids += len(ids)
                if len(self.docs) >= SHARD_DOCS or self.n_ids >= SHARD_IDS:
                    yield self.shard()

    def shard(self) -> pa.RecordBatch:
        self.packer.shard(self.docs, Index(self.words, self.known.known_idf, self.known.mean_words))
        self.docs, self.words, self.n_ids = [], [], 0
        return as_rows(self.packer.closed())

    def end(self) -> Iterator[pa.RecordBatch]:
        yield self.shard()
        yield as_rows(list(self.packer.tail()))


def pack_pass(path: str, statistics, window: int):
    """Packs each partition of (doc_id, text) as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(path, statistics.value, window, TaskContext.get().partitionId())
        for batch in batches:
            yield from shards.add(batch.column(0), batch.column(1))
        yield from shards.end()

    return run


def dealt_pass(path: str, statistics, window: int):
    """Packs (part, at, id, docs, text), by part and at: first a part's words (at -1) and in how many documents they are, then its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, open_part, counts = None, None, []
        for batch in batches:
            part, is_word = batch.column(0).to_numpy(), batch.column(1).to_numpy() < 0
            turns = np.flatnonzero((part[1:] != part[:-1]) | (is_word[1:] != is_word[:-1])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(part)], strict=True):
                if a == b:
                    continue
                if part[a] != open_part:
                    if shards is not None:
                        yield from shards.end()
                    shards, open_part, counts = None, part[a], []
                some = batch.slice(a, b - a)
                if is_word[a]:
                    counts.append((some.column(2).to_numpy(), some.column(3).to_numpy()))
                    continue
                if shards is None:
                    words, docs = (np.concatenate(c) for c in zip(*counts, strict=True)) if counts else (np.zeros(0, np.int64),) * 2
                    order = np.argsort(words)
                    shards = Shards(path, statistics.value._replace(rest=words[order], rest_counts=docs[order]), window, int(open_part))
                yield from shards.add(some.column(2), some.column(4))
        if shards is not None:
            yield from shards.end()

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """The pieces of docs (doc_id, text). tokenizer: a file of the tokenizers library that never joins words."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(spark)
    known, rest = corpus_counts(rows, scratch)
    statistics = spark.sparkContext.broadcast(known)
    if rest is None:
        scratch.drop()
        return rows.mapInArrow(tidy(pack_pass(tokenizer, statistics, window)), SCHEMA)
    rest = stored(rest, "rest")
    scratch.drop()
    parts = rows._jdf.rdd().getNumPartitions()
    at = F.monotonically_increasing_id()  # the partition's number, and 33 bits for a row's place in it
    texts = rows.select(at.alias("at"), F.col("doc_id").alias("id"), "text").select(F.shiftright("at", 33).cast("int").alias("part"), "at", "id", F.lit(None).cast("long").alias("docs"), "text")
    words = rest.select("part", F.lit(-1).cast("long").alias("at"), F.col("word").alias("id"), "docs", F.lit(None).cast("string").alias("text"))
    dealt = words.union(texts).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "at")
    return dealt.mapInArrow(tidy(dealt_pass(tokenizer, statistics, window)), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), default_tokenizer())
