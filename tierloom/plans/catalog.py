"""The catalogue of queries: one per operator, over whole tables, with the same in SQL where SQL can express it.

Searches take every row whose id is divisible by 100 as a query, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierloom.functions import text as ft
from tierloom.functions import vectors as fv
from tierloom.functions import zstd
from tierloom.operators import dedup, traces
from tierloom.operators.codecs import PQ, SQ8, Binary, recall_at
from tierloom.operators.search import inner, rerank, top_k
from tierloom.operators.tables import ranked, table, written
from tierloom.plans import recall, tiers
from tierloom.sources import canonical

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
EVERY, K, M = 100, 10, 8


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), fv.doubles("embedding").alias("vector"))


def asked(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "vector")


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "id", (F.round("score", 6) + 0.0).alias("score"))


E_ = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT id AS query_id, v AS qv FROM e WHERE id % 100 = 0)"
FIT = """p AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e),
f AS (SELECT pos, min(x)::FLOAT AS mins, ((max(x) - min(x)) / 255)::FLOAT AS scale FROM p GROUP BY pos),
a AS (SELECT list(mins::DOUBLE ORDER BY pos) AS m, list(scale::DOUBLE ORDER BY pos) AS s FROM f),
c AS (SELECT id, v, m, s, list_transform(range(1, len(v) + 1), lambda i: CASE WHEN s[i] = 0 THEN 0 ELSE greatest(0, least(255, round_even((v[i] - m[i]) / s[i], 0))) END) AS code FROM e, a),
d AS (SELECT id, v, list_transform(range(1, len(v) + 1), lambda i: code[i] * s[i] + m[i]) AS y FROM c)"""


def _top(score: str, source: str, k: int = K) -> str:
    return f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, id) AS rank, id, {score} AS score FROM {source}, q WHERE id <> query_id QUALIFY rank <= {k}"


def _out(cte: str) -> str:
    return f"SELECT query_id, rank, id, round(score, 6) + 0.0 AS score FROM {cte}"


# --- vectors


@query(f"WITH {E_}, n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS nn FROM e) SELECT id, len(v)::INT AS dims, round(nn, 6) AS norm, round(list_sum(list_transform(v, lambda x: x / nn)), 6) + 0.0 AS total, round(list_max(v) / nn, 6) + 0.0 AS largest FROM n")
def l2_normalize(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("unit", fv.l2_normalize(F.col("vector")))
    total = F.aggregate("unit", F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", F.size("unit").alias("dims"), F.round(fv.norm(F.col("vector")), 6).alias("norm"), (F.round(total, 6) + 0.0).alias("total"), (F.round(F.array_max("unit"), 6) + 0.0).alias("largest"))


@query(f"WITH {E_}, t AS (SELECT id, v[1:16] AS v FROM e), n AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS nn FROM t) SELECT id, len(v)::INT AS dims, round(v[1] / nn, 6) + 0.0 AS first, round(v[16] / nn, 6) + 0.0 AS last FROM n")
def matryoshka_16(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("unit", fv.truncate(F.col("vector"), 16))
    return rows.select("id", F.size("unit").alias("dims"), (F.round(F.element_at("unit", 1), 6) + 0.0).alias("first"), (F.round(F.element_at("unit", 16), 6) + 0.0).alias("last"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS nonfinite, max(len(embedding))::INT AS dims FROM embeddings")
def nonfinite_rows(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return rows.agg(F.count("*").alias("n"), F.count_if(~fv.finite(F.col("vector"))).alias("nonfinite"), F.max(F.size("vector")).alias("dims"))


@query(f"WITH {E_}, t AS ({_top('list_dot_product(v, qv)', 'e')}) {_out('t')}")
def exact_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _rounded(top_k(rows, asked(rows), inner, K))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the scalar codec against exact search: scan, fit, encode, search, compare."""
    return recall_at_k(spark, sf_dir)


@query(f"WITH {E_}, {FIT} SELECT pos::INT AS pos, mins::DOUBLE AS mins, scale::DOUBLE AS scale FROM f")
def sq8_fit(spark, sf_dir):
    return SQ8.ranges(vectors(spark, sf_dir)).select("pos", F.col("mins").cast("double").alias("mins"), F.col("scale").cast("double").alias("scale"))


def _codes(column: str = "code"):
    """A binary code as numbers with commas."""
    at = F.sequence(F.lit(1), F.octet_length(column))
    return F.array_join(F.transform(at, lambda i: F.conv(F.hex(F.substring(F.col(column), i, F.lit(1))), 16, 10)), ",")


@query(f"WITH {E_}, {FIT} SELECT id, array_to_string(list_transform(code, lambda x: x::INT), ',') AS code FROM c")
def sq8_encode(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return SQ8.fit(rows).encode(rows).select("id", _codes().alias("code"))


@query(f"WITH {E_}, {FIT}, z AS (SELECT unnest(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - y[i]))) AS err, generate_subscripts(v, 1) - 1 AS pos FROM d) SELECT pos::INT AS pos, round(max(err), 6) AS worst FROM z GROUP BY pos")
def sq8_decode_error(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    codec = SQ8.fit(rows)

    def worst(batches):
        from tierloom.operators.search import matrix

        most = None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(x), -1)
                e = np.abs(x - codec.values(codes)).max(axis=0)
                most = e if most is None else np.maximum(most, e)
        if most is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most), dtype=np.int32)), pa.array(most)], ["pos", "err"])

    return codec.encode(rows).mapInArrow(worst, "pos int, err double").groupBy("pos").agg(F.round(F.max("err"), 6).alias("worst"))


@query(f"WITH {E_}, {FIT}, t AS ({_top('list_dot_product(y, qv)', 'd')}) {_out('t')}")
def sq8_search(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    codec = SQ8.fit(rows)
    return _rounded(top_k(written(codec.encode(rows).select("id", "code"), "codes"), asked(rows), codec.scorer, K))


@query(f"WITH {E_}, {FIT}, t AS ({_top('list_dot_product(y, qv)', 'd', 50)}), r AS (SELECT t.query_id, t.id, list_dot_product(v, qv) AS s FROM t JOIN e USING (id) JOIN q ON q.query_id = t.query_id), u AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank, id, s AS score FROM r QUALIFY rank <= 10) {_out('u')}")
def sq8_rerank_exact(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    codec = SQ8.fit(rows)
    found = top_k(written(codec.encode(rows).select("id", "code"), "codes"), asked(rows), codec.scorer, 50)
    return _rounded(rerank(found, rows, asked(rows), K))


@query(f"WITH {E_} SELECT id, array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END), '') AS bits, len(list_filter(v, lambda x: x > 0))::INT AS ones FROM e")
def binary_encode(spark, sf_dir):
    rows = Binary.encode(vectors(spark, sf_dir))
    n = F.size("vector")
    bits = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.getbit(F.get("code", F.floor(i / 63).cast("int")), i % 63).cast("string"))
    return rows.select("id", F.array_join(bits, "").alias("bits"), F.aggregate("code", F.lit(0), lambda s, x: s + F.bit_count(x)).alias("ones"))


HAM = "-len(list_filter(range(1, len(v) + 1), lambda i: (v[i] > 0) <> (qv[i] > 0)))::DOUBLE"


@query(f"WITH {E_}, t AS ({_top(HAM, 'e')}) {_out('t')}")
def hamming_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    codes = written(Binary.encode(rows).select("id", "code"), "codes")
    return _rounded(top_k(codes, asked(rows), Binary.words_scorer, K))


@query(f"WITH {E_}, t AS ({_top(HAM, 'e', 100)}), r AS (SELECT t.query_id, t.id, list_dot_product(v, qv) AS s FROM t JOIN e USING (id) JOIN q ON q.query_id = t.query_id), u AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank, id, s AS score FROM r QUALIFY rank <= 10) {_out('u')}")
def binary_rerank(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    codes = written(Binary.encode(rows).select("id", "code"), "codes")
    return _rounded(rerank(top_k(codes, asked(rows), Binary.words_scorer, 100), rows, asked(rows), K))


PQ_SQL = """b AS (SELECT v, row_number() OVER (ORDER BY id) - 1 AS w FROM e ORDER BY id LIMIT 256),
w AS (SELECT w, j, v[j * 8 + 1 : j * 8 + 8] AS c FROM b, (SELECT unnest(range(8)) AS j)),
x AS (SELECT id, j, v[j * 8 + 1 : j * 8 + 8] AS s FROM e, (SELECT unnest(range(8)) AS j)),
k AS (SELECT id, j, w, c, list_dot_product(c, c) - 16 * list_dot_product(s, c) + 7 / greatest(list_dot_product(s, s), 1e-30) * list_dot_product(s, c) * list_dot_product(s, c) AS cost FROM x JOIN w USING (j)),
o AS (SELECT id, j, w, c FROM k QUALIFY row_number() OVER (PARTITION BY id, j ORDER BY cost, w) = 1)"""


@query(f"WITH {E_}, {PQ_SQL} SELECT id, string_agg(w::VARCHAR, ',' ORDER BY j) AS code FROM o GROUP BY id")
def pq_encode_fixed(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return PQ.from_rows(rows, M).encode(rows).select("id", _codes().alias("code"))


@query(f"WITH {E_}, {PQ_SQL}, y AS (SELECT id, flatten(list(c ORDER BY j)) AS y FROM o GROUP BY id), t AS ({_top('list_dot_product(y, qv)', 'y')}) {_out('t')}")
def pq_adc_search(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    codec = PQ.from_rows(rows, M)
    return _rounded(top_k(written(codec.encode(rows).select("id", "code"), "codes"), asked(rows), codec.scorer, K))


@query()
def pq_fit_search(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    codec = PQ.fit(rows, M)
    found = top_k(written(codec.encode(rows).select("id", "code"), "codes"), asked(rows), codec.scorer, 200)
    return _rounded(rerank(found, rows, asked(rows), K))


@query(f"WITH {E_}, {FIT}, t AS ({_top('list_dot_product(v, qv)', 'e')}), u AS ({_top('list_dot_product(y, qv)', 'd')}) SELECT round(avg(n), 6) AS recall, count(*) AS queries FROM (SELECT query_id, count(u.id) / 10.0::DOUBLE AS n FROM t LEFT JOIN u USING (query_id, id) GROUP BY query_id)")
def recall_at_k(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    codec = SQ8.fit(rows)
    return recall_at(top_k(rows, asked(rows), inner, K), top_k(written(codec.encode(rows).select("id", "code"), "codes"), asked(rows), codec.scorer, K), K)


@query()
def verify_tiers(spark, sf_dir):
    """Per codec: recall among 1, 10 and 100 on queries that aren't in the database, and bytes of codes and of what rows share."""
    rows = vectors(spark, sf_dir)
    return recall.verify(rows.filter(F.col("id") % EVERY != 0), asked(rows), M)


@query("SELECT codec, (n * per)::BIGINT AS codes, aux::BIGINT AS aux FROM (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings), LATERAL (VALUES ('fp32', 4 * d, 0), ('sq8', d, 8 * d), ('pq', d // 4, 1024 * d), ('binary', d // 8, 0)) t(codec, per, aux)")
def codec_bytes(spark, sf_dir):
    sizes = vectors(spark, sf_dir).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"))
    return sizes.select(tiers.codec_bytes(F.col("n"), F.col("d")).alias("x")).select("x.*")


@query("SELECT * FROM (VALUES ('hot', NULL, NULL::INT, NULL::DOUBLE, 1.0::DOUBLE, 0::INT), ('warm', 'sq8', 10, 0.99, 0.25, 0), ('cold', 'pq', 19, 0.95, 0.08, 200), ('cold', 'binary', 19, 0.90, 0.08, 500)) t(tier, codec, zstd_level, recall_floor, footprint, rerank_depth)")
def tier_specs(spark, sf_dir):
    return tiers.specs(spark)


@query("SELECT round(t / 1e9 * 0.023 + v / 1e9 * 0.33, 9) AS monthly, t AS trace_bytes, v AS vector_bytes FROM (SELECT sum(strlen(text))::BIGINT AS t FROM conversations), (SELECT sum(len(embedding) * 4)::BIGINT AS v FROM embeddings)")
def pricing_model(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").agg(F.sum(F.octet_length("text")).alias("trace_bytes")).withColumn("vector_bytes", F.lit(0).cast("bigint"))
    v = table(spark, sf_dir, "embeddings").agg(F.sum((F.size("embedding") * 4).cast("bigint")).alias("vector_bytes")).withColumn("trace_bytes", F.lit(0).cast("bigint"))
    both = t.unionByName(v).agg(F.sum("trace_bytes").alias("trace_bytes"), F.sum("vector_bytes").alias("vector_bytes"))
    return both.select(F.round(tiers.monthly_cost(F.col("trace_bytes"), F.col("vector_bytes")), 9).alias("monthly"), "trace_bytes", "vector_bytes")


@query("SELECT arg_max(codec, ratio) AS codec, round(max(ratio), 6) AS ratio FROM (SELECT codec, 4.0 * d * n / (n * per + aux) AS ratio FROM (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings), LATERAL (VALUES ('sq8', d, 8 * d), ('pq', d // 4, 1024 * d), ('binary', d // 8, 0)) t(codec, per, aux))")
def headline_tier(spark, sf_dir):
    sizes = vectors(spark, sf_dir).agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d"))
    sizes = sizes.select((4 * F.col("n") * F.col("d")).alias("raw"), tiers.codec_bytes(F.col("n"), F.col("d")).alias("x")).filter("x.codec <> 'fp32'")
    ratio = F.col("raw") / (F.col("x.codes") + F.col("x.aux"))
    return sizes.agg(F.max_by("x.codec", ratio).alias("codec"), F.round(F.max(ratio), 6).alias("ratio"))


@query("WITH e AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e), c AS (SELECT label, pos, avg(x) AS m FROM p GROUP BY ALL) SELECT label, count(*) AS dims, round(sqrt(sum(m * m)), 6) AS length FROM c GROUP BY label")
def cluster_separation(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode(fv.doubles("embedding")).alias("pos", "x"))
    means = rows.groupBy("label", "pos").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(F.count("*").alias("dims"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 6).alias("length"))


@query()
def leave_out_split(spark, sf_dir):
    """A tenth of the rows, drawn by hashed id, as held-out queries; the others are the database."""
    rows = vectors(spark, sf_dir).select("id")
    drawn = ranked(rows.withColumn("draw", F.xxhash64(F.lit(1337), "id")), [], [F.col("draw"), F.col("id")], "split")
    n = drawn.count()
    return drawn.select("id", (F.col("rank") < n // 10).alias("held_out"))


# --- traces


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as canonical JSON lines of one file."""
    rows = table(spark, sf_dir, "conversations")
    line = F.to_json(
        F.struct(
            F.concat(F.lit("conv-"), F.lpad(F.col("conv_id").cast("string"), 6, "0")).alias("trace_id"),
            (F.lit(1700000000000000) + F.col("conv_id") * 1000000 + F.col("turn") * 1000).alias("ts"),
            "role",
            F.lit("message").alias("type"),
            F.col("text").alias("content"),
        )
    )
    rows = ranked(rows.select("conv_id", "turn", F.encode(line, "UTF-8").alias("raw")), [], [F.col("conv_id"), F.col("turn")], "lines")
    return rows.select(F.lit("part-0000.jsonl").alias("file"), F.col("rank").alias("line_index"), "raw")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.canonicalize(lines(spark, sf_dir))


def _bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return traces.shred(written(events(spark, sf_dir), "events"))


LINES = """l AS (SELECT 'conv-' || lpad(conv_id::VARCHAR, 6, '0') AS trace_id, 1700000000000000 + conv_id * 1000000 + turn * 1000 AS ts, role, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_index FROM conversations),
r AS (SELECT *, '{"trace_id":"' || trace_id || '","ts":' || ts || ',"role":' || to_json(role)::VARCHAR || ',"type":"message","content":' || to_json(text)::VARCHAR || '}' AS raw FROM l)"""


@query(f"WITH {LINES} SELECT 1::BIGINT AS files, count(*) AS events, 0::BIGINT AS malformed, sum(strlen(raw))::BIGINT AS bytes_read FROM r")
def ingest_stats(spark, sf_dir):
    return canonical.stats(events(spark, sf_dir))


@query(f"WITH {LINES} SELECT line_index, trace_id, ts, role, 'message' AS type, sha256(text) AS content_sha FROM l")
def canonical_events(spark, sf_dir):
    return events(spark, sf_dir).select("line_index", "trace_id", "ts", "role", "type", F.sha2("content", 256).alias("content_sha"))


@query("SELECT event_id AS line_index, user_id::VARCHAR AS trace_id, epoch_ms(ts) * 1000 AS ts, event_type AS type, 'unknown' AS role FROM events")
def alias_coalesce(spark, sf_dir):
    """The events table as lines with other names for the fields, and times in milliseconds."""
    rows = table(spark, sf_dir, "events")
    line = F.to_json(F.struct(F.col("user_id").alias("Session_ID"), F.floor((ft.wall_micros(F.col("ts")) + 500) / 1000).alias("timestamp"), F.col("event_type").alias("kind"), "value"))
    made = rows.select(F.lit("events.jsonl").alias("file"), F.col("event_id").alias("line_index"), F.encode(line, "UTF-8").alias("raw"))
    return canonical.canonicalize(made).select("line_index", "trace_id", "ts", "type", "role")


@query("SELECT event_id, epoch_ms(ts) // 1000 * 1000000 AS from_s, epoch_ms(ts) * 1000 AS from_ms, epoch_us(ts) AS from_us FROM events")
def ts_units(spark, sf_dir):
    """Times as whole seconds (of the milliseconds), as milliseconds to the nearest, and as microseconds, all back as microseconds."""
    us = ft.wall_micros(F.col("ts"))
    ms = F.floor((us + 500) / 1000)
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", ft.micros(F.floor(ms / 1000)).alias("from_s"), ft.micros(ms).alias("from_ms"), ft.micros(us).alias("from_us"))


@query()
def quarantine_sample(spark, sf_dir):
    """Conversations cut short, so that most lines are malformed: the first 1000 of them and why."""
    cut = lines(spark, sf_dir).withColumn("raw", F.when(F.col("line_index") % 3 == 0, F.expr("substring(raw, 1, 40)")).otherwise(F.col("raw")))
    return canonical.quarantine(canonical.canonicalize(cut))


@query("SELECT role, count(*) AS events, count(DISTINCT conv_id) AS traces, sum(strlen(text))::BIGINT AS bytes FROM conversations GROUP BY role")
def role_turn_rollup(spark, sf_dir):
    return events(spark, sf_dir).groupBy("role").agg(F.count("*").alias("events"), F.countDistinct("trace_id").alias("traces"), F.sum(F.octet_length("content")).alias("bytes"))


@query("SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1")
def intern_content(spark, sf_dir):
    return traces.intern(table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("sha", "copies", F.col("first.doc_id").alias("first"))


@query("WITH g AS (SELECT sha256(text) AS sha, min(doc_id) AS first FROM documents GROUP BY 1), r AS (SELECT sha, row_number() OVER (ORDER BY first) - 1 AS ref FROM g) SELECT doc_id, ref FROM documents JOIN r ON sha256(text) = sha")
def content_refs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("first"))
    refs = ranked(first, [], [F.col("first")], "refs").select("sha", F.col("rank").alias("ref"))
    return docs.join(refs, "sha").select("doc_id", "ref")


@query(
    "WITH p AS (SELECT DISTINCT text, sha256(text) AS sha, encode(text) AS b FROM documents WHERE text IS NOT NULL), "
    "h AS (SELECT sha, b, CASE WHEN octet_length(b) > 256 THEN b[1:256] ELSE b END AS a FROM p), "
    "k AS (SELECT sha, substr(regexp_replace(regexp_replace(hex(a), '(..)', '\\1 ', 'g'), '((09|0A|0B|0C|0D|20) )+', '20 ', 'g'), 1, 192) AS k0, substr(hex(b), 1, 192) AS k1 FROM h) "
    "SELECT row_number() OVER (ORDER BY k0, k1, sha) - 1 AS item, sha FROM k"
)
def pack_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("body", F.encode("text", "UTF-8"))
    return traces.pack(traces.intern(docs, "body", ["doc_id"])).select("item", "sha")


@query("WITH i AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS item, strlen(text) AS size FROM documents), s AS (SELECT item, size, coalesce(sum(size) OVER (ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM i) SELECT item, size::BIGINT AS size, start, start // 1048576 AS block FROM s")
def block_offsets(spark, sf_dir):
    docs = ranked(table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body")), [], [F.col("doc_id")], "items")
    return traces.block_offsets(docs.select(F.col("rank").alias("item"), "body"))


@query(f"WITH {LINES} SELECT line_index, trace_id, ts, role, sha256(text) AS content_sha, false AS residual FROM l")
def shred_structured(spark, sf_dir):
    b = _bundle(spark, sf_dir)
    rows = b["structured"].join(b["content"].select(F.col("item").alias("content_ref"), F.col("sha").alias("content_sha")), "content_ref", "left")
    return rows.select("line_index", "trace_id", "ts", "role", "content_sha", F.col("residual_ref").isNotNull().alias("residual"))


@query(f"WITH {LINES} SELECT line_index, sha256(raw) AS sha FROM r")
def replay_lines(spark, sf_dir):
    return traces.replay(_bundle(spark, sf_dir)).select("line_index", F.sha2("raw", 256).alias("sha"))


@query(f"WITH {LINES} SELECT line_index, sha256(raw) AS sha FROM r WHERE trace_id = 'conv-000003'")
def replay_trace(spark, sf_dir):
    return traces.replay(_bundle(spark, sf_dir), "conv-000003").select("line_index", F.sha2("raw", 256).alias("sha"))


@query("SELECT count(*) AS left_lines, count(*) AS right_lines, 0::BIGINT AS mismatches FROM conversations")
def roundtrip_check(spark, sf_dir):
    return traces.differences(lines(spark, sf_dir), traces.replay(_bundle(spark, sf_dir)))


@query("SELECT count(*) AS n, 0.0::DOUBLE AS rate FROM conversations")
def residual_rate(spark, sf_dir):
    return events(spark, sf_dir).agg(F.count("*").alias("n"), (F.count_if(F.col("residual").isNotNull()) / F.count("*")).alias("rate"))


@query(f"WITH {LINES} SELECT line_index, sha256(raw) AS warm, sha256(raw) AS cold FROM r")
def tier_equality(spark, sf_dir):
    """The digests of each line as two tiers replay it: the warm one's payloads are read from parquet, the cold one's from zstd frames."""
    bundle = _bundle(spark, sf_dir)
    cold = {n: df if n == "structured" else zstd.decompressed(written(zstd.compressed(df, "body", 19), n), "body") for n, df in bundle.items()}
    sha = lambda b, name: traces.replay(b).select("line_index", F.sha2("raw", 256).alias(name))
    return sha(bundle, "warm").join(sha(cold, "cold"), "line_index", "full_outer")


# --- duplicates


GROUPS = "g AS (SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first, (count(*) - 1) * any_value(strlen(text)) AS saved FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"


@query(f"WITH {GROUPS} SELECT sha, copies, first, saved::BIGINT AS saved FROM g")
def exact_dup_groups(spark, sf_dir):
    return dedup.exact_groups(table(spark, sf_dir, "documents").filter("text is not null"))


@query(f"WITH {GROUPS} SELECT (SELECT count(*) FROM documents) AS bodies, (SELECT count(DISTINCT text) FROM documents) AS different, (SELECT count(DISTINCT text) FROM documents WHERE length(text) > 64) AS eligible, count(*) AS groups, sum(saved)::BIGINT AS saved FROM g")
def dedup_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    g = docs.groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("copies"), F.first(F.octet_length("text")).cast("bigint").alias("size"), F.first(F.char_length("text")).alias("chars"))
    return g.agg(F.sum("copies").alias("bodies"), F.count("sha").alias("different"), F.count_if(F.col("chars") > 64).alias("eligible"), F.count_if(F.col("copies") > 1).alias("groups"), F.sum((F.col("copies") - 1) * F.col("size")).alias("saved"))


@query(f"WITH {GROUPS} SELECT sha, copies, first, saved::BIGINT AS saved FROM g ORDER BY copies DESC, first LIMIT 5")
def top_clusters(spark, sf_dir):
    return dedup.top_clusters(exact_dup_groups(spark, sf_dir))




@cache
def _normal_sql() -> str:
    t = "trim(regexp_replace(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+', ' ', 'g'))"
    patterns = (
        ("0-9a-f", r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
        ("0-9", r"\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:z|[+-]\d{2}:?\d{2})?"),
        ("0-9a-z", r"\d{10,16}"),
    )
    for beside, p in patterns:
        for _ in range(2):
            t = f"regexp_replace({t}, '(^|[^{beside}]){p}([^{beside}]|$)', '\\1 \\2', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256({_normal_sql()}) AS sha FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(ft.normalize(F.col("text")), 256).alias("sha"))


@query("WITH s AS (SELECT DISTINCT item_id, substr(text, i, 5) AS shingle FROM benchmark, LATERAL (SELECT unnest(range(1, greatest(length(text) - 4, 1) + 1)) AS i)), h AS (SELECT *, count(*) OVER (PARTITION BY shingle) AS holders FROM s) SELECT item_id, count(*) AS shingles, count(*) FILTER (WHERE holders > 1) AS shared FROM h GROUP BY item_id")
def shingle_overlap(spark, sf_dir):
    return dedup.jaccard_nearest(table(spark, sf_dir, "benchmark"))


@query()
def minhash_signature(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return dedup.signatures(rows).select("id", F.size("signature").alias("slots"), F.sha2(F.array_join("signature", ","), 256).alias("digest"))


@query()
def near_dup_clusters(spark, sf_dir):
    return dedup.near_clusters(table(spark, sf_dir, "documents"))


@query()
def hashing_embed(spark, sf_dir):
    """Texts as 64-dimensional unit vectors of hashed words and word pairs."""
    from tierloom.functions.hashing import embed

    return embed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 64)


@query("SELECT source, count(*) AS bodies, count(DISTINCT text) AS different, max(n_chars) AS longest FROM documents GROUP BY source")
def source_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("bodies"), F.countDistinct("text").alias("different"), F.max("n_chars").alias("longest"))


@query("SELECT conv_id, count(*) AS turns, sum(strlen(text))::BIGINT AS bytes, row_number() OVER (ORDER BY count(*) DESC, conv_id) - 1 AS place FROM conversations GROUP BY conv_id")
def trace_sizes(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.octet_length("text")).alias("bytes"))
    return ranked(g.withColumn("_n", -F.col("turns")), [], [F.col("_n"), F.col("conv_id")], "sizes").select("conv_id", "turns", "bytes", F.col("rank").alias("place"))
