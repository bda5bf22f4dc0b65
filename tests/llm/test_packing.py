import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from versoline.llm import packing
from versoline.llm.common import words_of


def ones(words, _):
    return np.ones(len(words))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_tokenizer())


def check(rows, docs, tokenizer, window=packing.WINDOW):
    """Every id of every document in exactly one piece, sequences without gaps; the padding."""
    want = defaultdict(list)
    for d, text in docs:
        want[d].append(tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for d, texts in want.items():
        expected = []
        for n in {len(t) for t in texts}:
            assert sum(p[1] for p in pieces[d] if p[3] == n) == n * sum(len(t) == n for t in texts)
        for start, length, crc, total in pieces[d]:
            expected.append(any(len(t) == total and zlib.crc32(np.array(t[start : start + length], np.uint32).tobytes()) == crc for t in texts))
        assert all(expected)
    padding = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= window
        padding += packing.padded_length(end, window) - end
    return padding


@pytest.mark.parametrize("seed", [0, 1])
def test_encoder_is_the_tokenizer(tokenizer, seed):
    rng = random.Random(seed)
    alphabet = ["a", "B", "'s", "'T", "é", "É", "é", "ß", "İ", "Σ", "ς", "日本", "1", "23", "½", ".", ",", "!", "<|endoftext|>", "<|StartOfText|>", "<", "|>", "*", "%", "$", " ", "\n", "\t", " ", " ", "'", '"', "́", "😀", "​", "(", ")", ";", "'ll", "_"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(3000)]
    got = packing.Encoder(packing.default_tokenizer()).texts(*words_of(pa.array(texts, pa.large_string())))
    for text, ids, want in zip(texts, got, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids + [packing.END_ID], text


def test_edges(spark, tokenizer):
    docs = [(1, None), (2, ""), (3, "word " * 30_000), (4, "a b c"), (4, "a b c"), (5, "zzz")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, start int")
    rows = packing.pack(df, packing.default_tokenizer()).collect()
    assert check(rows, docs, tokenizer) == 0
    assert packing.pack(df.limit(0), packing.default_tokenizer()).count() == 0


def test_lexical_neighbours_share_windows():
    """Topics interleaved: a window's documents are of its seed's topic, which arrival order would not give."""
    rng = random.Random(3)
    topics = 12
    texts = [" ".join(f"t{k % topics}w{rng.randrange(30)}" for _ in range(100)) + " the of and" for k in range(240)]
    offsets, codes, dictionary = words_of(pa.array(texts, pa.large_string()))
    hashes = packing.hashed(dictionary).view(np.int64)
    words = [hashes[codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    index = packing.Index(words, ones, 100.0)
    packer = packing.Packer(1000, 0)
    packer.shard([(k, np.zeros(100, np.uint32)) for k in range(240)], index)
    windows = defaultdict(set)
    for doc, _, _, _, sequence, _ in packer.out:
        windows[sequence].add(doc % topics)
    assert np.mean([len(w) for w in windows.values()]) < 2.5


def shard_of(texts):
    offsets, codes, dictionary = words_of(pa.array(texts, pa.large_string()))
    hashes = packing.hashed(dictionary).view(np.int64)
    return [hashes[codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def packed(texts, window, size, parts=1):
    """The documents of each window, in their order; texts come in so many shards."""
    packer, n = packing.Packer(window, 0), len(texts) // parts
    for a in range(0, len(texts), n):
        words = shard_of(texts[a : a + n])
        packer.shard([(a + k, np.zeros(size, np.uint32)) for k in range(len(words))], packing.Index(words, ones, 10.0))
    windows = defaultdict(list)
    for doc, _, _, _, sequence, _ in packer.out:
        windows[sequence].append(doc)
    return [windows[k] for k in sorted(windows)]


def test_windows_of_many_documents_are_filled_by_rank():
    """100 documents a window: neighbours are all taken before any other."""
    texts = [f"t{k % 4}a t{k % 4}b u{k}" for k in range(400)]
    assert all(len({d % 4 for d in w}) == 1 for w in packed(texts, 1000, 10))


def test_every_word_of_a_seed_counts():
    """A neighbour that shares one word of the seed's least weight, of 40 that others share too."""
    seed = " ".join(f"w{k} w{k}" for k in range(40))
    others = [f"w{k}" for k in range(40)]
    texts = [seed, *(f"x{k}" for k in range(50)), *others, "x0 x1"]
    first = packed(texts, 410, 10)[0]
    assert set(first) == {0, *range(51, 91)}


def test_full_ranking_is_bm25():
    rng = random.Random(5)
    words = [np.array([rng.randrange(60) for _ in range(rng.randrange(1, 40))]) for _ in range(200)]
    idf = np.arange(1.0, 100.0)
    index, used = packing.Index(words, lambda t, _: idf[t], 20.0), np.arange(200) % 3 == 0
    for seed in (0, 3, 99):
        want = np.zeros(200)
        for d in np.flatnonzero(~used):
            for t in set(words[seed].tolist()) & set(words[d].tolist()):
                tf = (words[d] == t).sum()
                want[d] += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(words[d]) / 20.0))
        got = index.answers(seed, used)
        assert set(got.tolist()) == set(np.flatnonzero(want).tolist())
        assert (np.diff(want[got]) <= 1e-3).all()
        assert index.answers_to(np.unique(words[seed]), used).tolist() == got.tolist()


def test_the_open_window_of_a_shard_is_filled_by_its_seed():
    texts = ["a a1", "a a2", "b b1", "b b2", "a a3", "b b3", "b b4", "a a4"]
    assert packed(texts, 30, 10, parts=2)[1] == [3, 5, 6]


def test_bm25_scores():
    """Postings against the formula."""
    words = [np.array([1, 1, 2]), np.array([1, 3, 3, 3]), np.array([2, 3])]
    idf = np.zeros(4)
    idf[[1, 2, 3]] = [0.5, 1.5, 2.5]
    index = packing.Index(words, lambda t, _: idf[t], 3.0)
    for term, k in ((1, 0), (2, 1), (3, 2)):
        for at in range(index.bounds[k], index.bounds[k + 1]):
            d = index.doc[at]
            tf = int((words[d] == term).sum())
            norm = packing.K1 * (1 - packing.B + packing.B * len(words[d]) / 3.0)
            assert index.weight[at] == pytest.approx(idf[term] * tf * (packing.K1 + 1) / (tf + norm), rel=1e-6)
    assert index.answers(2, np.array([False, False, True])).tolist()[0] == 1


def test_statistics(spark, sf_dir, monkeypatch):
    """Counts are exact for what is kept, which is what most documents have; the rest has the weight of its shard."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").repartition(3)
    texts = [(r["text"] or "") for r in df.collect()]
    seen = Counter(w for t in texts for w in set(re.findall(r"[^\x20\x09-\x0D]+", t)))
    names = sorted(seen)
    code = dict(zip(packing.hashed(pa.array(names, pa.large_string())).view(np.int64).tolist(), names, strict=True))
    for most, counted in ((10**6, 10**6), (300, 50)):
        monkeypatch.setattr(packing, "MOST_WORDS", most)
        monkeypatch.setattr(packing, "COUNTED", counted)
        got = packing.corpus_statistics(df)
        assert got.docs == len(texts) and got.mean_words == pytest.approx(np.mean([len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]))
        assert len(got.words) <= most and (np.diff(got.words) > 0).all()
        assert {code[w]: n for w, n in zip(got.words.tolist(), got.counts.tolist(), strict=True)} == {w: n for w, n in seen.items() if n >= got.least}
    idf = got.idf(np.array(sorted([got.words[0], 5])), np.array([1, 1]))
    known = got.counts[0]
    assert sorted(idf) == pytest.approx(sorted(np.log1p((len(texts) - n + 0.5) / (n + 0.5)) for n in (1, known)))
    empty = packing.corpus_statistics(df.limit(0))
    assert (empty.docs, empty.mean_words, len(empty.words)) == (0, 1.0, 0)


def test_query(spark, sf_dir, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check(packing.op10_packing(spark, sf_dir).collect(), docs, tokenizer) == 0


def test_words_beyond_the_table_have_exact_counts(spark, sf_dir, monkeypatch):
    """However few words every task gets, the pieces are the same: the others' counts come with the documents."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).select("doc_id", "text")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/dealt"
    df.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    monkeypatch.setattr(packing, "SHARD_DOCS", 20)
    path = packing.default_tokenizer()
    out = []
    for most in (10**6, 300, 0):
        monkeypatch.setattr(packing, "MOST_WORDS", most)
        out.append(sorted(map(tuple, packing.pack(stored, path, 512).collect())))
    assert out[0] == out[1] == out[2]


def test_a_word_without_its_count_is_an_error():
    known = packing.Statistics(9, 2.0, np.array([3, 5]), np.array([4, 6]), 4, np.array([7]), np.array([2]))
    assert known.known_idf(np.array([3, 7, 8]), np.array([2, 1, 1])) == pytest.approx([np.log1p((9 - n + 0.5) / (n + 0.5)) for n in (4, 2, 1)])
    with pytest.raises(ValueError):
        known.known_idf(np.array([8]), np.array([2]))


def test_pieces_of_equal_hashes_are_told_apart(monkeypatch):
    """What is kept is found by its hash, but compared: ids are right however often hashes meet."""
    texts = pa.array(["one two, three. two", "three one! four four;", "five, two one"], pa.large_string())
    want = [packing.Encoder(packing.default_tokenizer()).tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    monkeypatch.setattr(packing, "hashed", lambda words: np.array([len(w) % 2 for w in words.to_pylist()], np.uint64))
    encoder = packing.Encoder(packing.default_tokenizer())
    for k in (0, 1, 2, 0):
        assert encoder.texts(*words_of(texts.slice(k, 1)))[0].tolist() == want[k] + [packing.END_ID]


def test_a_shard_costs_no_pass_over_all_known_words():
    """Looking up few words among many takes far less than sorting these, which every shard did."""
    words = np.random.default_rng(0).permutation(1_000_000).astype(np.int64) << 20
    known = packing.Statistics(10**6, 9.0, np.sort(words), np.full(len(words), 7), 2)
    few, here = known.words[::1000], np.full(1000, 2)
    start = time.process_time()
    np.unique(words)
    sorting = time.process_time() - start
    start = time.process_time()
    for _ in range(10):
        known.known_idf(few, here)
    assert time.process_time() - start < sorting


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_counts_are_merged(size):
    """merge_pass against counting, whatever the batches: a word's rows may lie in several."""
    rng = random.Random(size)
    rows = sorted((rng.randrange(-40, 40) << 57, rng.randrange(1, 3), rng.randrange(6)) for _ in range(150))
    total, here = Counter(), Counter()
    for word, docs, part in rows:
        total[word] += docs
        here[word, part] += docs
    columns = zip((None, 3, 9, 0), *((word, docs, None, part) for word, docs, part in rows), strict=True)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["word", "docs", "words", "part"])
    out = [tuple(r.values()) for b in packing.merge_pass(batch.slice(a, size) for a in range(0, len(batch), size)) for r in b.to_pylist()]
    want = [(w, n, None, None) for w, n in total.items() if n > 1] + [(w, total[w], None, p) for (w, p), n in here.items() if n > 1]
    assert out[0] == (None, 3, 9, 0) and Counter(out[1:]) == Counter(want)


@pytest.mark.parametrize("most", [300, 0])
def test_statistics_have_every_word_that_can_rank(spark, sf_dir, monkeypatch, most):
    """However few words every task gets, no word that several documents of a partition have is without its exact count."""
    monkeypatch.setattr(packing, "MOST_WORDS", most)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/counted{most}"
    spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3).write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path).select("text")
    total, here = Counter(), Counter()
    for r in df.select(packing.F.spark_partition_id().alias("part"), "text").collect():
        words = set(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        total.update(words)
        here.update((r["part"], w) for w in words)
    names = sorted({w for (_, w), n in here.items() if n > 1})
    hashes = packing.hashed(pa.array(names, pa.large_string())).view(np.int64)
    order = np.argsort(hashes)
    got = packing.corpus_statistics(df)
    assert len(names) > 1000 and len(got.words) <= most < len(got.words) + len(got.rest)
    assert got.counted(hashes[order]).tolist() == [total[names[k]] for k in order]


def test_ranks_are_whole_however_many_are_sorted_first(monkeypatch):
    scores = np.random.default_rng(1).integers(-3, 12, 400) / 2.0
    want = sorted(np.flatnonzero(scores > 0).tolist(), key=lambda k: (-scores[k], k))
    for first in (1, 5, 64, 1000):
        monkeypatch.setattr(packing, "FIRST", first)
        assert list(packing.by_rank(scores)) == want


def test_a_long_word_that_is_kept_is_not_copied_for_others():
    """Words that meet no kept hash are compared with nothing."""
    encoder, pool, before = packing.Encoder(packing.default_tokenizer()), pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    encoder.of_words(pa.array(["x" * 100_000], pa.large_string()))
    pa.set_memory_pool(pool)
    try:
        encoder.of_words(pa.array([f"w{k}" for k in range(2000)], pa.large_string()))
    finally:
        pa.set_memory_pool(before)
    assert 0 < pool.max_memory() < 20 << 20
