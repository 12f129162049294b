"""Queries opN_<name> of the corpus operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, htmltext, langid, licenses, linededup, periodic, quality, sharding, simhash, substring, vectorcodes
from .common import fold

#: Shards of op5.
SHARDS = 40


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), words=3)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op5_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard_documents(docs, SHARDS).select("doc_id", "size", "text_crc32", "shard")
    numbered = sharding.number(placed, ["doc_id", "text_crc32"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op7_native_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.removals(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_phrase_automata_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = vocabulary()
    done = bpe.decode(bpe.encode(docs, vocab).select("doc_id", "ids"), vocab)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def planted(doc_id, text):
    """The text with the periodic tail that op11's contract gives to a tenth of the documents; null ids and texts without words stay as they are."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \t\n\x0b\f\r]+"), "")
    h, n = F.crc32(doc_id.cast("string").cast("binary")), F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.find(docs, carry=["doc_id"])
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    milli = F.expr("(1000 * best.length) div best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compress(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return vectorcodes.label_errors(coded).select("vec_id", code.alias("code"), "error", "label_error", F.lit(vectorcodes.digest(books)).alias("codebooks_sha256"))


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        licenses.labels(F.col("matches"), base_only=True).alias("base_labels"), licenses.labels(F.col("matches")).alias("labels"), F.round(score, 6).alias("score"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_html_extraction,
        op3_simhash_near_dedup,
        op4_language_id,
        op5_lpt_sharding,
        op6_anisotropic_ann,
        op7_native_line_dedup,
        op8_phrase_automata_dedup,
        op9_byte_bpe,
        op10_nbsvm_quality,
        op11_periodic_runs,
        op12_vector_codes,
        op13_license_scans,
    )
}

#: Lines with words, their sets' earliest lines, and the near-duplicates among those by a plain prefix join.
LINE_DEDUP_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id AS d, unnest(range(len(p))) AS l, unnest(p) AS line FROM parts),
worded AS (
  SELECT d, l, list_sort(list_distinct(list_filter(regexp_split_to_array(line, '[ \t\x0b\f\r\n]+'), lambda x: x <> ''))) AS w
  FROM each WHERE regexp_matches(line, '[^ \t\x0b\f\r\n]')),
ranked AS (SELECT d, l, w, len(w) AS n, row_number() OVER (PARTITION BY w ORDER BY d, l) AS r FROM worded),
sets AS (SELECT row_number() OVER (ORDER BY d, l) AS id, d, l, w, n FROM ranked WHERE r = 1),
tokens AS (SELECT id, n, unnest(w) AS t FROM sets),
df AS (SELECT t, count(*) AS c FROM tokens GROUP BY t),
prefix AS (
  SELECT id, n, t FROM (SELECT id, n, tokens.t, row_number() OVER (PARTITION BY id ORDER BY c, tokens.t) AS i FROM tokens JOIN df USING (t))
  WHERE i <= n - CAST(ceil(n * 4 / 5.0) AS BIGINT) + 1),
pairs AS (
  SELECT DISTINCT x.id AS x, y.id AS y FROM prefix x JOIN prefix y ON x.t = y.t AND y.id < x.id
  WHERE 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
near AS (
  SELECT DISTINCT a.d, a.l FROM pairs JOIN sets a ON a.id = x JOIN sets b ON b.id = y
  WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)),
gone AS (SELECT d, l FROM ranked WHERE r > 1 UNION SELECT d, l FROM near),
lists AS (SELECT d, count(*) AS n, string_agg(CAST(l AS VARCHAR), ',' ORDER BY l) AS removed FROM gone GROUP BY d)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
  coalesce(n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed_lines
FROM documents LEFT JOIN lists ON doc_id = d
"""



def vector_codes_sql() -> str:
    """Plain Lloyd over all parts, a table for each round."""
    n, m, width = vectorcodes.PARTS, vectorcodes.ENTRIES, "len(v) // 8"
    head = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor({vectorcodes.SCALE} * x) AS BIGINT)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
parts AS (SELECT r, p, v[p * ({width}) + 1 : (p + 1) * ({width})] AS x FROM kept, range({n}) AS t(p)),
book0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= {m})"""
    near = lambda k: f"""
near{k} AS MATERIALIZED (
  SELECT r, p, x, min(struct_pack(d := list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS best
  FROM parts JOIN book{k} USING (p) GROUP BY r, p, x)"""  # noqa: E731
    book = lambda k: f"""
sum{k} AS (SELECT p, best.e AS e, i, sum(x[i + 1]) AS s, count(*) AS n FROM near{k}, range(8) AS t(i) GROUP BY ALL),
new{k} AS (SELECT p, e, list(CAST((s - (((s % n) + n) % n)) // n AS BIGINT) ORDER BY i) AS c FROM sum{k} GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, b.c) AS c FROM book{k} b LEFT JOIN new{k} n USING (p, e))"""  # noqa: E731
    rounds = vectorcodes.ROUNDS
    ctes = ",".join([head, *[near(k) + "," + book(k) for k in range(rounds)], near(rounds)])
    return f"""{ctes},
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
final AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), final
"""


def license_scans_sql() -> str:
    """All words against all template words, without an index."""
    every = [(k, t, k < len(licenses.BASE)) for k, t in enumerate(licenses.BASE + licenses.NOTICES)]
    words = ", ".join(f"({k}, {i}, '{w}')" for k, t, _ in every for i, w in enumerate(t.split))
    known = ", ".join(f"({k}, '{t.label}', {base}, {len(t.split)}, {t.least}, {[f' {key} ' for key in t.keys]}::VARCHAR[])" for k, t, base in every)
    gap = licenses.GAP
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{gap}'), lambda x: x <> '') AS w FROM documents),
each AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM docs),
tw(t, place, x) AS (VALUES {words}),
known(t, label, base, m, least_, keys) AS (VALUES {known}),
hits AS (SELECT r, t, i - place AS off, count(*) AS same FROM each JOIN tw USING (x) GROUP BY ALL),
places AS (
  SELECT r, label, base, greatest(off, 0) AS start, same / m AS share FROM hits JOIN known USING (t) JOIN docs USING (r)
  WHERE same >= least_ AND len(list_filter(keys, lambda k: contains(' ' || array_to_string(w[greatest(off, 0) + 1 : off + m], ' ') || ' ', k))) = len(keys)),
found AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM places GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score
FROM docs LEFT JOIN found USING (r)
"""


ORACLE_SQL: dict[str, str] = {"op7_native_line_dedup": LINE_DEDUP_SQL, "op12_vector_codes": vector_codes_sql(), "op13_license_scans": license_scans_sql()}
