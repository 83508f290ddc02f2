"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words by Spark's higher-order functions.

The rank file becomes a literal map, laid out as two flat arrays (hash, displace and compare), as a lookup in a literal
of Spark's map type would scan it. A word is the array of its neighbouring pairs of ids; a fold repeats the leftmost of
the least ranked merges until none is left. The corpus's distinct words are counted; those that occur most, at most
CACHED of them, are folded once and sent to all tasks as Arrow arrays. Documents are cut into words by Spark, each batch of
words is looked up at once, and what a document has besides, its distinct rare words, goes through the same fold. So no
text moves, whatever the number of distinct words. Decoding takes the ids' binary pieces, one after the other.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierloom.llm.common import written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Distinct words, the commonest, that the tasks hold encoded. This bounds a broadcast and changes no result.
CACHED = 1 << 19
#: Words of more bytes than this merge by a heap over their pairs, each on its own, as a fold takes quadratic time in a word's length.
LONG = 256
#: Above every rank.
NONE = 1 << 16
#: Words that are looked up at once.
AT_ONCE = 1 << 20
#: Words whose ids a task holds at once, or those of one document.
FILLED = 1 << 17
#: Letters and numbers that Unicode has had since Java 17's version of it, up to the tokenizer library's.
LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 "
    "10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 "
    "1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA "
    "16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 "
    "1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _class(ranges: str) -> str:
    """The ranges as a Java class that ASCII fails at its first comparison."""
    return r"[\x{870}-\x{10FFFF}&&[" + "".join("-".join(r"\x{" + x + "}" for x in r.split("-")) for r in ranges.split()) + "]]"


def java_pattern(pattern: str) -> str:
    """The pattern as Java reads it, with Unicode's classes of the library's version, whatever Java's own."""
    both = {r"\p{L}": r"\p{L}" + _class(LETTERS), r"\p{N}": r"\p{N}" + _class(NUMBERS)}
    out, inside = [], False
    for t in re.findall(r"\\p\{\w\}|\\.|.", pattern, re.S):
        inside = t == "[" or (inside and t != "]")
        out.append(both.get(t, t) if inside else f"[{both[t]}]" if t in both else t)
    return "(?U)" + "".join(out)


def _packed(rows: dict[int, dict[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """A double array: row a's entry b is at base[a] + b, marked with a. Rows are placed at random places that are free, the fullest first."""
    size = n + 4 * sum(map(len, rows.values()))
    rng, base = np.random.default_rng(7), np.zeros(n, np.int64)
    free, table = np.ones(size, bool), np.full(size, 1 << 60, np.int64)
    for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        own = np.array(sorted(row), np.int64)
        while not free[(at := int(rng.integers(0, size - n))) + own].all():
            pass
        base[a] = at
        free[at + own] = False
        table[at + own] = [a << 17 | row[x] for x in own.tolist()]
    return base, table


def literals(spark: SparkSession, **arrays: pa.Array) -> dict[str, Column]:
    """Array literals in Spark's own compact layout, which goes to the tasks as plain bytes and is read in place.

    ``lit`` would make every element an object, several times a plan.
    """
    row = pa.table({k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in arrays.items()})
    df = spark.createDataFrame(row)
    got = df._jdf.queryExecution().executedPlan().executeCollect()[0]
    jvm, out = spark.sparkContext._jvm, {}
    for i, name in enumerate(arrays):
        value = got.getArray(i).copy()
        kind = df._jdf.schema().apply(i).dataType()
        out[name] = Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(jvm.org.apache.spark.sql.catalyst.expressions.Literal(value, kind)))
    return out


def member(hashes: DataFrame, n: int) -> Callable[[Column], Column]:
    """A Bloom filter of the ``n`` values of ``xxhash64`` as a literal: true for a column's value if its hash is among them, and for one in a hundred others."""
    if not n:
        return lambda _: F.lit(False)
    jvm = hashes.sparkSession.sparkContext._jvm
    made = hashes._jdf.stat().bloomFilter("hash", n, 0.01)
    made.writeTo(out := jvm.java.io.ByteArrayOutputStream())
    bits, util, catalyst = F.lit(bytes(out.toByteArray())), jvm.org.apache.spark.sql.classic.ExpressionUtils, jvm.org.apache.spark.sql.catalyst.expressions
    return lambda x: Column(util.column(catalyst.BloomFilterMightContain(util.expression(bits._jc), util.expression(F.xxhash64(x)._jc))))


class Merges:
    """The literal rank map: the rank of the merge of two ids, or at least NONE."""

    def __init__(self, spark: SparkSession, path: str):
        of = ranks(path)
        self.end = max(of.values()) + 1  # stands at both ends of a word, and merges with nothing
        rows: dict[int, dict[int, int]] = {}
        for t, r in of.items():
            for i in range(1, len(t)):
                if t[:i] in of and t[i:] in of:
                    rows.setdefault(of[t[:i]], {})[of[t[i:]]] = r
        if self.end >= NONE or len(of) != self.end:
            raise ValueError("ids must be 0 to n - 1, and fewer than 65536")
        base, table = _packed(rows, self.end + 1)
        flat = literals(spark, base=pa.array(base), table=pa.array(table), byte_ids=pa.array([of[bytes([i])] for i in range(256)], pa.int64()))
        self.base, self.table, self.byte_ids = flat["base"], flat["table"], flat["byte_ids"]

    def entry(self, a: Column, b: Column, i: Column) -> Column:
        """A pair as one number that orders by rank, then place: rank, at most NONE, place, and the two ids.

        An entry of row a loses its mark by the XOR, and is the rank; any other keeps bits above all ranks.
        """
        rank = F.least(F.get(self.table, F.get(self.base, a) + b).bitwiseXOR(F.shiftleft(a, 17)), F.lit(NONE).cast("bigint"))
        return F.shiftleft(rank, 46).bitwiseOR(F.shiftleft(i.cast("bigint"), 32)).bitwiseOR(F.shiftleft(a, 16)).bitwiseOR(b)


def _let(x: Column, f) -> Column:
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def _fold(word: Column, m: Merges) -> Column:
    """The ids of a word (string) of fewer than 2**14 bytes: array<int>.

    The fold's state is the array of the word's neighbouring pairs, with an end mark before and after it. A step removes
    the least pair, of several the leftmost, puts the merged id into the pairs before and after it, and moves those
    behind one place ahead.
    """
    latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")  # one character a byte
    end, low, places, behind, none, one = F.array(_long(m.end)), _long(0xFFFF), _long(0x3FFF), _long(1 << 32), _long(NONE << 46), F.lit(1)
    ids = F.transform(F.split(latin, ""), lambda c: F.get(m.byte_ids, F.ascii(c)))
    # a pair's second id is looked up from the array, as the first of the next
    start = _let(F.concat(end, ids, end), lambda x: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda a, i: m.entry(a, F.get(x, i + one), i)))

    def step(pairs: Column, _: Column) -> Column:
        def merge(least: Column) -> Column:
            merged = F.shiftright(least, 46)

            def at(p: Column) -> Column:
                def moved(x: Column, i: Column) -> Column:
                    before, after = m.entry(F.shiftright(x, 16).bitwiseAND(low), merged, i), m.entry(merged, x.bitwiseAND(low), i)
                    return F.when(i > p, x - behind).when(i < p - one, x).when(i == p, after).otherwise(before)

                return F.transform(F.array_remove(pairs, least), moved)

            return F.when(least < none, _let(F.shiftright(least, 32).bitwiseAND(places).cast("int"), at)).otherwise(pairs)

        return _let(F.array_min(pairs), merge)

    folded = F.aggregate(F.sequence(F.lit(2), F.greatest(F.octet_length(word), F.lit(2))), start, step)
    # the last pair ends in the mark; a let, as an expression that is named twice is evaluated twice
    return _let(folded, lambda f: F.transform(F.slice(f, F.lit(1), F.size(f) - 1), lambda x: x.bitwiseAND(low).cast("int")))


def merge_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one word: the same merges, in the same order, from a heap of the pairs, in time n log n."""
    end, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))  # of the piece that starts at a byte: its end, and the start of the one before
    heap: list[tuple[int, int, int]] = []  # rank, start, end of the merged piece

    def push(at: int) -> None:
        if (mid := end[at]) < len(word) and (r := rank.get(word[at : end[mid]])) is not None:
            heapq.heappush(heap, (r, at, end[mid]))

    for at in range(len(word) - 1):
        push(at)
    while heap:
        _, at, upto = heapq.heappop(heap)
        mid = end[at]
        if mid < 0 or mid >= upto or end[mid] != upto:
            continue  # one of the two is no longer there
        end[at], end[mid] = upto, -1
        if upto < len(word):
            before[upto] = at
        push(at)
        if before[at] >= 0:
            push(before[at])
    ids, at = [], 0
    while at < len(word):
        ids.append(rank[word[at : end[at]]])
        at = end[at]
    return ids


#: The public pattern with its commonest alternatives first. No two of those that changed places can begin with the same characters, so that it matches the same.
_SOONER = {public_tokenizers.PATTERN: r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}


def words_of(text: Column, pattern: str) -> Column:
    pattern = _SOONER.get(pattern, pattern)
    return F.regexp_extract_all(text, F.lit(java_pattern(pattern)), F.lit(0))


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A column of lists without nulls: where each begins, and the end; and all their elements."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.values.slice(offsets[0], offsets[-1] - offsets[0])


def _nested(starts: np.ndarray, values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), values)


def sliced(batch: pa.RecordBatch, ends: np.ndarray, at_once: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of ``at_once`` words, by the words before each row, or of one row."""
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + at_once, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _filled(batch: pa.RecordBatch, words: pa.Array, starts_of: np.ndarray, ids_of: np.ndarray, rank: Callable[[], dict[bytes, int]]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """For some documents at a time: their other columns, where each one's ids begin, and the end; and all their ids.

    The last columns: a document's words, its words that aren't common, and their ids (null: a long word). All words of
    the batch are looked up at once, as each look-up hashes the common ones.
    """
    starts, flat = _lists(batch.column(batch.num_columns - 3))
    at = pc.index_in(flat, value_set=words)
    unknown = at.is_null()
    code = at.fill_null(0).to_numpy().copy()
    others = flat.filter(unknown).dictionary_encode()
    _, rare = _lists(batch.column(batch.num_columns - 2))
    _, folded = _lists(batch.column(batch.num_columns - 1))
    own = folded.take(pc.index_in(others.dictionary, value_set=rare)) if len(rare) else pa.nulls(len(others.dictionary), folded.type)
    if own.null_count:  # long words, and those that the filter took for common ones
        own = pa.array([merge_long(w.encode(), rank()) if x is None else x for w, x in zip(others.dictionary.to_pylist(), own.to_pylist(), strict=True)], own.type)
    own_starts, own_ids = _lists(own) if len(own) else (np.zeros(1, np.int64), pa.array([], pa.int32()))
    code[unknown.to_numpy(zero_copy_only=False)] = len(words) + others.indices.to_numpy()
    del at, unknown, flat, others
    every = np.concatenate((ids_of, own_ids.to_numpy()))
    begins = np.concatenate((starts_of[:-1], len(ids_of) + own_starts[:-1]))
    sizes = np.concatenate((np.diff(starts_of), np.diff(own_starts)))
    lo = 0
    for b in sliced(batch, starts, FILLED):
        some = code[starts[lo] : starts[lo + b.num_rows]]
        size = sizes[some]
        ends = np.concatenate(([0], np.cumsum(size)))
        ids = every[np.repeat(begins[some] - ends[:-1], size) + np.arange(ends[-1])]
        yield b.columns[:-3], ends[starts[lo : lo + b.num_rows + 1] - starts[lo]], ids
        lo += b.num_rows


class Tokenizer:
    """Encodes and decodes columns of texts by a rank file and the pattern that cuts a text into words."""

    def __init__(self, spark: SparkSession, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        self.spark, self.path, self.pattern = spark, path, pattern
        self.merges = Merges(spark, path)
        self._pieces = None

    def decode(self, ids: Column) -> Column:
        """The bytes of ids: their binary pieces, one after the other."""
        if self._pieces is None:
            pieces = sorted(ranks(self.path), key=ranks(self.path).get)
            self._pieces = literals(self.spark, pieces=pa.array([t.hex().upper() for t in pieces]))["pieces"]
        return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(self._pieces, i)), ""))

    def _common(self, docs: DataFrame) -> tuple[pa.Array, pa.Array, Callable[[Column], Column]]:
        """The commonest distinct words of all documents, at most CACHED, their ids, and a filter that holds for them, and for one in a hundred others."""
        word = F.explode(words_of(F.col("text"), self.pattern)).alias("w")
        words = docs.select(word).groupBy("w").agg(F.count("*").alias("n"))
        words = written(words.filter((F.col("n") > 1) & (F.octet_length("w") <= LONG)).withColumn("class", F.floor(F.log2("n") * 16)), "words")
        held, least = 0, None
        for c in words.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("class")).collect():
            held += c["n"]
            if held > CACHED:
                break
            least = c["class"]
        some = words.filter(F.col("class") >= least) if least is not None else words.limit(0)
        got = some.select("w", _fold(F.col("w"), self.merges).alias("ids")).toArrow()
        got = [pa.concat_arrays(got[c].chunks) if got[c].num_chunks else pa.array([], got.schema.field(c).type) for c in ("w", "ids")]
        return *got, member(some.select(F.xxhash64("w").alias("hash")), len(got[0]))

    def _coded(self, docs: DataFrame, keep: list[str], finish: Callable, schema: T.StructType) -> DataFrame:
        """``finish`` gets batches of the columns to keep, the documents' first ids, and all ids; the schema is that of what it returns.

        One Python worker a task: the words that aren't common are told by a filter in Spark and folded there, before
        anything goes to Python. What isn't kept, as the text, doesn't go there.
        """
        words, ids, common = self._common(docs)
        names = [f"c{i}" for i in range(len(keep))]
        cut = docs.select(*keep, F.coalesce(words_of(F.col("text"), self.pattern), F.array().cast("array<string>"))).toDF(*names, "words")
        rare = cut.withColumn("rare", F.filter(F.array_distinct("words"), lambda w: ~common(w)))
        folded = rare.withColumn("folded", F.transform("rare", lambda w: F.when(F.octet_length(w) <= LONG, _fold(w, self.merges))))
        starts_of, ids_of = _lists(ids)
        sent, path = self.spark.sparkContext.broadcast((words, starts_of, ids_of.to_numpy().astype(np.int32))), self.path

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for some in _filled(b, *sent.value, lambda: ranks(path)):
                    yield finish(*some)
                del b, some
                pa.default_memory_pool().release_unused()

        return folded.mapInArrow(fill, schema)

    def encode(self, docs: DataFrame) -> DataFrame:
        """All columns of ``docs`` and ``ids``, array<int>: the ids of the whole text, as the tiktoken library's ``encode_ordinary``.

        A null or empty text has no ids. The commonest words are found in a first pass over all documents. A column that
        is called ids is replaced.
        """
        docs = docs.drop("ids")
        names = [*docs.columns, "ids"]

        def finish(columns: list[pa.Array], starts: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*columns, _nested(starts, pa.array(ids))], names)

        return self._coded(docs, docs.columns, finish, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))

    def digests(self, docs: DataFrame, ids: bool = False) -> DataFrame:
        """All columns of ``docs`` but its text, n_tokens, ids_sha256 and decoded_sha256, and the ids themselves if they are asked for."""
        kept = [f for f in docs.schema.fields if f.name != "text"]
        more = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        more += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
        schema, path = T.StructType([*kept, *more]), self.path
        names = [f.name for f in schema.fields]

        def finish(columns: list[pa.Array], starts: np.ndarray, flat: np.ndarray) -> pa.RecordBatch:
            pieces = _pieces(path)
            little = memoryview(flat.astype("<u4")).cast("B")
            ends = np.concatenate(([0], np.cumsum(pc.binary_length(pieces).to_numpy()[flat])))[starts].tolist()
            whole = pieces.take(pa.array(flat)).buffers()[2] if len(flat) else b""
            decoded, to = memoryview(whole) if whole else memoryview(b""), starts.tolist()
            sha = [[hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cut, cut[1:], strict=False)] for data, cut in ((little, [4 * x for x in to]), (decoded, ends))]
            cols = [*columns, pa.array(np.diff(starts)), *(pa.array(x, pa.string()) for x in sha)]
            return pa.RecordBatch.from_arrays(cols + [_nested(starts, pa.array(flat))] * ids, names)

        return self._coded(docs, [f.name for f in kept], finish, schema)


@cache
def _pieces(path: str) -> pa.Array:
    """The tokens' bytes, by id."""
    return pa.array(sorted(ranks(path), key=ranks(path).get), pa.large_binary())


def digests(docs: DataFrame, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256.

    A null or empty text has no tokens, and the digests of no bytes. Very long texts and words are encoded whole. Repeated rows are
    encoded each; a null doc_id stays null; an empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    t = tokenizer or Tokenizer(docs.sparkSession)
    return t.digests(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
