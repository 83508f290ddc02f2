"""LM scoring by context-tree weighting over the running text.

A text is its words (lower-cased), each with a space after it, and an end mark. Each byte's context is the DEPTH bytes
before it, across words, with end marks before the text's first byte; the trees and their mixing are those of ``ctw``.

Texts are cut into chunks of about CHUNK bytes, each with the distinct (context, byte) keys of its texts and their training
counts. Keys move compressed, by PARTS parts of the contexts' two nearest bytes, so that a part has whole subtrees; what comes
back to a chunk is one number a key, in the order of the chunk's own keys. A text's score is the sum over its positions.

Texts, keys and rare words are written apart, and each is deleted, as are the shuffles, when what was made of it is written.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierloom.llm.common import done, partitions, release, written
from tierloom.llm.ctw import CUT, DEPTH, END, SENT, Top, _at_depth, _batch, _summed, log10_bytes, subtrees

#: Bytes of text at least in a chunk, unless it is a task's last; a text is never cut.
CHUNK = 20_000_000
#: Bytes of text at least that are written in a row, unless they are a batch's last.
SLICE = 3_000_000
#: Bytes of text at least whose keys are sorted at once, unless they are a chunk's last.
SORTED = 8_000_000
#: Bytes of text at least whose words are counted at once, unless they are a batch's last.
COUNTED = 16_000_000
PARTS = 1024
#: Texts that are scored at once.
TEXTS = 256
#: Keys at most whose subtrees are built at once, if they have more than one root.
PIECE = 300_000
_PART = (np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(8) & np.uint64(PARTS - 1)).astype(np.uint16)
_KIND = "chunk bigint, part int, uid bigint, doc_id bigint, held_out boolean, n bigint, known bigint, base double, data binary, counts binary"


def give_back() -> None:
    """Arrays of a megabyte or more, Arrow's too, go back to the system as they are freed, instead of staying with the worker (glibc); what a task before left free goes now."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def running(words: list[bytes]) -> bytes:
    """The text that is scored, of its tokens, the last of which is the end mark."""
    return b" ".join(words)


def keys_of(texts: list[bytes]) -> np.ndarray:
    """For each byte of the texts: its context (nearest byte first) and the byte, in 64 bits."""
    if not texts:
        return np.zeros(0, np.uint64)
    pad = END * DEPTH
    data = pad + pad.join(texts)
    key = np.ndarray(len(data) - DEPTH, "<u8", data, strides=(1,)).astype(np.uint64)  # the byte and those before it, the byte on top
    byte = key >> np.uint64(8 * DEPTH)
    key <<= np.uint64(8)
    key |= byte
    del byte
    own = np.ones(len(key), bool)
    ends = np.cumsum([len(t) + DEPTH for t in texts])[:-1]
    for j in range(1, DEPTH + 1):
        own[ends - j] = False
    return key[own]


def _lowered(column: pa.Array) -> pa.Array:
    """Texts with A-Z lowered, "" for null. Not Arrow's ascii_lower, which takes wrong bytes of what was cast from a slice (as of 23.0.1)."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = texts.buffers()
    if not len(texts) or data is None:
        return texts
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes().lower()
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(data))


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts' words, as ``tokens`` has them but without the end marks, and the number of each word's text; for all texts at once."""
    parts = pc.ascii_split_whitespace(_lowered(column))
    words = pc.list_flatten(parts)
    full = pc.greater(pc.binary_length(words), 0)  # not the nothing before a text's first space, or after its last
    of = np.repeat(np.arange(len(column)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    return words.filter(full).cast(pa.large_binary()), of[full.to_numpy(zero_copy_only=False)]


def joined(words: pa.Array, of: np.ndarray, some: int) -> list[bytes]:
    """Each of so many texts as it is scored."""
    ends = np.cumsum(np.bincount(of, minlength=some), dtype=np.int32)
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.insert(ends, 0, 0)), words.cast(pa.binary())), b" ")
    return [running([t, END]) if t else END for t in texts.to_pylist()]


def numbered(words: pa.Array, of: np.ndarray, some: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct tokens, end marks too; the place in these of each token, and its text."""
    both = pa.concat_arrays([words, pa.array([END] * some, pa.large_binary())]).dictionary_encode()
    return both.dictionary, both.indices.to_numpy(zero_copy_only=False), np.concatenate((of, np.arange(some)))


def pieces_of(batch: pa.RecordBatch, text: int, least: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts, in column ``text``, have at least so many bytes."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + least)) + 1
        yield batch.slice(at, end - at)
        at = end


def counted(held_out: np.ndarray, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct tokens of texts, and how often those that aren't held out have each."""
    words, at, of = numbered(*split(column), len(column))
    return words, np.bincount(at[~held_out[of]], minlength=len(words))


def word_counts(docs: DataFrame) -> DataFrame:
    """word and all, its training tokens (0: only held-out texts have it). docs: held_out and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for whole in batches:
            for b in pieces_of(whole, 1, COUNTED):
                words, times = counted(b.column(0).to_numpy(zero_copy_only=False), b.column(1))
                yield _batch("word all", words.cast(pa.binary()), times)

    return docs.select("held_out", "text").mapInArrow(count, "word binary, all bigint").groupBy("word").agg(F.sum("all").alias("all"))


def _joined(keys: list[np.ndarray]) -> np.ndarray:
    """All keys, sorted; the list is emptied meanwhile, so that they aren't held twice."""
    out, end = np.empty(sum(map(len, keys)), np.uint64), 0
    keys.reverse()
    while keys:
        k = keys.pop()
        out[end : end + len(k)] = k
        end += len(k)
    out.sort()
    return out


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys, and how many there are of each."""
    first = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    some, kept = len(key), key[first]
    del key
    return kept, np.diff(np.flatnonzero(first), append=some).astype(np.uint32)


def _united(*keys: np.ndarray) -> np.ndarray:
    """The distinct keys of all, sorted; holds little besides."""
    key = np.concatenate(keys)
    key.sort()
    first = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    return key[first]


def _added(key: np.ndarray, n: np.ndarray, more: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, distinct keys and their numbers, with others put in between; holds little besides the result. ``n`` is changed."""
    at = np.searchsorted(key, more)
    new = key[np.minimum(at, len(key) - 1)] != more if len(key) else np.ones(len(more), bool)
    n[at[~new]] += times[~new]
    return np.insert(key, at[new], more[new]), np.insert(n, at[new], times[new])


class Units:
    """The numbers of known keys, for texts that have only these: a table in which keys of one place are left to the next, smaller table."""

    def __init__(self, key: np.ndarray, units: np.ndarray):
        """``key``: sorted and distinct; ``units``: whole numbers below 2**32 - 1."""
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        rng = np.random.default_rng(0)
        while len(key) > 256 and len(self.tables) < 64:
            factor, bits = np.uint64(rng.integers(1 << 63, 1 << 64, dtype=np.uint64) | np.uint64(1)), len(key).bit_length() + 1
            shift = np.uint64(64 - bits)
            table, left = np.empty(1 << bits, np.uint32), np.zeros(len(key), bool)
            some = [slice(i, min(len(key), i + self._BLOCK)) for i in range(0, len(key), self._BLOCK)]
            for s in some:
                table[self._places(key[s], factor, shift)] = np.arange(s.start, s.stop, dtype=np.uint32)
            for s in some:
                left[s] = table[self._places(key[s], factor, shift)] != np.arange(s.start, s.stop, dtype=np.uint32)
            for s in some:
                table[self._places(key[s], factor, shift)] = units[s]
            more = np.flatnonzero(left)
            for i in range(0, len(more), self._BLOCK):
                table[self._places(key[more[i : i + self._BLOCK]], factor, shift)] = self._NONE
            for s in some:
                left[s] = table[self._places(key[s], factor, shift)] == self._NONE
            self.tables.append((factor, shift, table))
            key, units = key[left], units[left]
        self.key, self.units = key, units

    _NONE = np.uint32((1 << 32) - 1)
    #: Keys whose places are held at once.
    _BLOCK = 1 << 18

    @staticmethod
    def _places(key: np.ndarray, factor: np.uint64, shift: np.uint64) -> np.ndarray:
        at = key * factor
        at >>= shift
        return at.view(np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        out = np.empty(len(key), np.uint32)
        left = None
        for factor, shift, table in self.tables:
            found = table[self._places(key, factor, shift)]
            if left is None:
                out[:] = found
            else:
                out[left] = found
            more = np.flatnonzero(found == self._NONE)
            left = more if left is None else left[more]
            key = key[more]
        if len(key):
            out[slice(None) if left is None else left] = self.units[np.searchsorted(self.key, key)]
        return out


def packed(x: np.ndarray) -> bytes:
    """Numbers, compressed by planes of their bytes."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    flat = pa.decompress(data, decompressed_size=n * wide, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(wide, n).T).view(kind).reshape(n)


#: A unit of the log-probabilities of bytes as they move: 2**-UNIT.
UNIT = 20


def _units(lp: np.ndarray) -> bytes:
    """log10 of probabilities in whole units; their high bytes, which are mostly alike, compress."""
    return packed(np.rint(lp * -float(1 << UNIT)).astype(np.uint32))


def _keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n, np.uint64), dtype=np.uint64)


def _by_part(key: np.ndarray) -> Iterator[tuple[int, list[slice]]]:
    """Each part that sorted keys have, and where its keys are, in order."""
    ends = np.searchsorted(key, np.arange(1, 1 << 16, dtype=np.uint64) << np.uint64(48)).tolist() + [len(key)]
    runs: list[list[slice]] = [[] for _ in range(PARTS)]
    for part, at, end in zip(_PART.tolist(), [0, *ends], ends, strict=False):
        if at < end:
            runs[part].append(slice(at, end))
    return ((p, own) for p, own in enumerate(runs) if own)


def _gathered(rows: DataFrame, words: pa.Array, known: np.ndarray, base: np.ndarray) -> DataFrame:
    """Per chunk: its slices' texts (part -3), words that ``words`` doesn't have (-2), what is known of the texts (-1), and its keys by part. rows: uid, doc_id, held_out, text."""
    known, base = np.append(known, 0).astype(float), np.append(base, 0.0)  # the last: of words that aren't there

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        chunk = TaskContext.get().partitionId() << 33
        kinds = dict(zip([f.split()[0] for f in _KIND.split(", ")], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()], strict=True))

        def out(some: int, **columns) -> pa.RecordBatch:
            """A batch of so many rows of the chunk, with nulls in the other columns."""
            columns["chunk"] = np.full(some, chunk)
            return _batch(" ".join(kinds), *((x.cast(t) if isinstance(x := columns[c], pa.Array) else pa.array(x, t)) if c in columns else pa.nulls(some, t) for c, t in kinds.items()))

        def with_more(k: np.ndarray, c: np.ndarray, learned: list[np.ndarray], held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            """The chunk's keys and counts with those of more texts; empties the lists."""
            more, times = _distinct(_joined(learned))
            k, c = _added(k, c, more, times) if len(k) else (more, times)
            more, _ = _distinct(_joined(held))
            return _added(k, c, more, np.zeros(len(more), np.uint32))

        def closed(k: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            parts, sizes, data, counts = [], [], [], []
            for p, own in _by_part(k):
                key, n = (np.concatenate([x[s] for s in own]) for x in (k, c))
                parts.append(p)
                sizes.append(len(key))
                data.append(packed(np.diff(key, prepend=np.uint64(0))))
                counts.append(packed(n))
            return out(len(parts), part=parts, n=sizes, data=data, counts=counts)

        none = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        number, size, lot, learned, held, (k, c) = 0, 0, 0, [], [], none
        for whole in batches:
            for b in pieces_of(whole, 3, min(SLICE, CHUNK)):
                spelled = split(b.column(3))
                texts = joined(*spelled, b.num_rows)
                here, own, of = numbered(*spelled, b.num_rows)
                at = pc.fill_null(pc.index_in(here, words), len(words)).to_numpy(zero_copy_only=False)[own]
                sums = {"n": np.bincount(of), "known": np.bincount(of, known[at]).astype(np.int64), "base": np.bincount(of, base[at])}
                yield out(len(texts), part=np.full(len(texts), -1), uid=b.column(0), doc_id=b.column(1), held_out=b.column(2), **sums)
                rare = at == len(words)
                which, times = np.unique(of[rare] * len(here) + own[rare], return_counts=True)
                of, own = np.divmod(which, len(here))
                yield out(len(which), part=np.full(len(which), -2), uid=b.column(0).take(pa.array(of)), n=times, data=here.take(pa.array(own)))
                outs = b.column(2).to_pylist()
                for keys, kind in ((learned, False), (held, True)):
                    keys.append(keys_of([t for t, o in zip(texts, outs, strict=True) if o == kind]))
                sizes, data = np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts)
                yield out(1, part=[-3], uid=[number], doc_id=[len(data)], n=[len(texts)], data=[pa.Codec("zstd", compression_level=5).compress(data, asbytes=True)], counts=[packed(sizes)])
                number, size, lot = number + 1, size + len(data), lot + len(data)
                if lot >= SORTED or size >= CHUNK:
                    (k, c), lot = with_more(k, c, learned, held), 0
                if size >= CHUNK:
                    yield closed(k, c)
                    number, size, chunk, (k, c) = 0, 0, chunk + 1, none
        if size:
            if lot:
                k, c = with_more(k, c, learned, held)
            yield closed(k, c)

    return rows.mapInArrow(run, _KIND)


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield from zip(*(b.slice(at, 256).column(n).to_pylist() for n in names), strict=True)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[np.ndarray], np.ndarray, np.ndarray]]:
    """Part, its chunks, their keys, and all distinct keys with their counts."""
    for part, own in groupby(_rows(batches, "part", "chunk", "n", "data", "counts"), lambda r: r[0]):
        chunks, keys, counts = [], [], []
        for _, chunk, n, data, c in own:
            chunks.append(chunk)
            keys.append(_keys(data, n))
            counts.append(unpacked(c, n, np.uint32).astype(np.int64))
        yield part, chunks, keys, *_summed(np.concatenate(keys), np.concatenate(counts))


def _pieces(key: np.ndarray) -> Iterator[slice]:
    """Sorted keys in pieces of whole roots."""
    root = key >> np.uint64(48)
    at = 0
    while at < len(key):
        end = len(key)
        if end - at > PIECE:
            end = int(np.searchsorted(root, root[at + PIECE]))
            if end <= at:
                end = int(np.searchsorted(root, root[at], side="right"))
        yield slice(at, end)
        at = end


def _key_scores(gathered: DataFrame) -> DataFrame:
    """chunk, part and data: log10 of the probability of each of the chunk's keys of the part, in their order."""
    blobs = gathered.filter("kind = 0").select("part", "chunk", "n", "data", "counts")
    blobs = blobs.repartition(partitions(gathered.sparkSession), "part").sortWithinPartitions("part", "chunk")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for _, _, _, key, n in _parts(batches):
            for s in _pieces(key):
                node, a, b, log_w, _ = subtrees(key[s], n[s])[CUT]
                at, a, b, log_w = _summed(_at_depth(node, 1), a, b, log_w)
                yield _batch("at a b w", at.view(np.int64), a, b, log_w)

    got = blobs.mapInArrow(lambda x: roots(x), "at bigint, a double, b double, w double").groupBy("at").agg(*(F.sum(c).alias(c) for c in "abw")).toArrow()
    release(gathered.sparkSession)
    top = Top(got["at"].to_numpy().view(np.uint64), *(got[c].to_numpy() for c in "abw"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for part, chunks, keys, key, n in _parts(batches):
            lp = np.concatenate([log10_bytes(key[s], n[s], top) for s in _pieces(key)])
            data = [_units(lp[np.searchsorted(key, k)]) for k in keys]
            yield _batch("chunk part data", pa.array(chunks, pa.int64()), pa.array([part] * len(chunks), pa.int32()), pa.array(data, pa.binary()))

    return blobs.mapInArrow(score, "chunk bigint, part int, data binary")


def _text_scores(texts: DataFrame, scores: DataFrame) -> DataFrame:
    """The texts' rows, with lp, the sum over their bytes, and size, their number. scores: of ``_key_scores``."""
    both = texts.unionByName(scores, allowMissingColumns=True)
    both = both.repartition(partitions(texts.sparkSession), "chunk").sortWithinPartitions("chunk", "part", "uid")
    fields = ("chunk", "part", "uid", "doc_id", "held_out", "n", "known", "base", "data", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for _, own in groupby(_rows(batches, *fields), lambda r: r[0]):
            slices, keys, about, units = [], [], [], []
            for r in own:
                if r[1] == -3:
                    sizes = unpacked(r[9], r[5], np.int64)
                    data, ends = pa.decompress(r[8], decompressed_size=r[3], codec="zstd", asbytes=True), np.cumsum(sizes)
                    own_texts = [data[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    for i in range(0, len(sizes), TEXTS):
                        slices.append((own_texts[i : i + TEXTS], sizes[i : i + TEXTS]))
                    keys.append(_united(keys_of(own_texts)))
                    if len(keys) == 4:  # most are the same
                        keys = [_united(*keys)]
                    del data, own_texts
                elif r[1] == -1:
                    about.append(r[2:8])
                else:
                    units.append(r[8])
            key = _united(*keys)
            keys.clear()
            all_ = np.empty(len(key), np.uint32)
            for data, (_, own_keys) in zip(units, _by_part(key), strict=True):
                part, at = unpacked(data, sum(s.stop - s.start for s in own_keys), np.uint32), 0
                for s in own_keys:
                    all_[s] = part[at : at + s.stop - s.start]
                    at += s.stop - s.start
            units.clear()
            known = Units(key, all_)
            del key, all_
            sums = np.concatenate([np.add.reduceat(known.of(keys_of(t)), np.cumsum(sizes) - sizes, dtype=np.int64) for t, sizes in slices])
            size = np.concatenate([sizes for _, sizes in slices])
            cols = [pa.array(c, t) for c, t in zip(zip(*about, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()), strict=True)]
            yield _batch("uid doc_id held_out n known base lp size", *cols, sums * -(1.0 / (1 << UNIT)), size)

    return both.mapInArrow(run, "uid bigint, doc_id bigint, held_out boolean, n bigint, known bigint, base double, lp double, size bigint")


def scored(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    score is the log10 probability of the whole text under the model, base_score that under the add-one unigram; bits_per_byte is
    score as a code length, per byte of the words and their ends. A null or empty text is its end mark alone. Texts are
    learned from unless held out; a document without doc_id isn't held out. Repeated rows count, and are scored, each. With
    nothing to learn from, every decision has probability one half. An empty table gives no rows.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), "text")
    words = words_at = written(word_counts(rows), "words")
    release(docs.sparkSession)
    n, v = words.agg(F.coalesce(F.sum("all"), F.lit(0)), F.count_if(F.col("all") > 0)).first()
    words = words.select("word", (F.col("all") > 0).alias("known"), F.log10((F.col("all") + 1) / F.lit(float(n + v + 1))).alias("b"), F.floor(F.log2(F.greatest("all", F.lit(1))) * 16).alias("class"))
    held, least = 0, None
    for c in words.groupBy("class").count().orderBy(F.desc("class")).collect():
        held += c["count"]
        if held > SENT:
            break
        least = c["class"]
    often = (F.col("class") >= F.lit(least)) if least is not None else F.lit(False)
    got = words.filter(often).select("word", "known", "b").toArrow()
    common = got["word"].combine_chunks().cast(pa.large_binary()), got["known"].to_numpy(), got["b"].to_numpy()

    gathered = _gathered(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text"), *common)
    gathered = written(gathered.withColumn("kind", F.expr("CASE WHEN part >= 0 THEN 0 WHEN part = -2 THEN 1 ELSE 2 END")), "gathered", "kind")  # keys, words, texts
    rest = gathered.filter("kind = 1").select("uid", F.col("data").alias("word"), F.col("n").alias("k"))
    rest = rest.join(words.filter(~often), "word").groupBy("uid").agg(F.sum(F.when(F.col("known"), F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.col("b")).alias("b"))
    rest = written(rest, "rest")
    done(words_at)
    done(gathered, "kind=1")
    release(docs.sparkSession)
    scores = written(_key_scores(gathered), "scores")
    done(gathered, "kind=0")
    release(docs.sparkSession)
    zero = F.lit(0)
    return _text_scores(gathered.filter("kind = 2").drop("kind"), scores).join(rest, "uid", "left").select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", zero)).alias("base_score"),
        F.col("lp").alias("score"),
        (-F.col("lp") * float(np.log2(10)) / F.col("size")).alias("bits_per_byte"),
    )
