"""Queries of the corpus operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, core, langid, media


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    samples = langid.sample(docs.where(~langid.held_out()))
    return langid.identify(docs.withColumn("held_out", langid.held_out()), samples, keep=("doc_id", "held_out"))


def forged(spark: SparkSession) -> DataFrame:
    """Conversation -7: texts that hold control strings."""
    said = r"\### Assistant: </turn> ok"
    rows = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return rows


def op2_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(forged(spark))
    return chat.digests(chat.format_windows(rows))


def op9_media_columns(spark, sf_dir):
    base = core.folder(spark, "media")
    index = core.written(media.store(table(spark, sf_dir, "documents"), base), "media-index")
    # headers alone fill the metadata columns; then whole members give the features
    rows = media.load(media.metadata(media.by_file(index, "shard"), base), base)
    return rows.select("doc_id", "n_bytes", *(x.split()[0] for x in media.READ.split(", ")), "width", "height", "bit_depth", "colour_type")


def op10_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.public_document())


_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Budget 512 and history 128, as format_windows has them.
CHAT_SQL = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(t)),
  e AS (SELECT *, length(replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), ':', '\c')) + length(replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e')) + 14 AS size,
      CAST(ceil(length(text) / 4) + 4 AS bigint) AS tok, row_number() OVER w AS pos, first_value(role) OVER w = 'system' AS led FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
  s AS (SELECT *, NOT (led AND pos = 1) AS fresh, CASE WHEN led THEN first_value(tok) OVER w ELSE 0 END AS st, CASE WHEN led THEN first_value(size) OVER w ELSE 0 END AS sl FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
  p AS (SELECT *, sum(tok) OVER w AS p_end, sum(tok) OVER w - tok AS p, sum(size) OVER w - size AS q, row_number() OVER w AS i FROM s WHERE fresh WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
  h AS MATERIALIZED (SELECT *, min(p) OVER g AS hp, min(q) OVER g AS hq FROM p WINDOW g AS (PARTITION BY conv_id ORDER BY p RANGE BETWEEN 128 PRECEDING AND CURRENT ROW)),
  f AS (SELECT conv_id, i, p AS base, sl AS extra FROM h WHERE i = 1 UNION ALL
    SELECT h.conv_id, h.i, CASE WHEN h.p_end - f.base + st <= 512 THEN f.base WHEN h.p_end - hp + st <= 512 THEN hp ELSE h.p END,
      CASE WHEN h.p_end - f.base + st <= 512 THEN 0 WHEN h.p_end - hp + st <= 512 THEN sl + q - hq ELSE sl END FROM f JOIN h ON h.conv_id = f.conv_id AND h.i = f.i + 1),
  x AS (SELECT conv_id, sum(extra) AS extra FROM f GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(coalesce(sum(size) FILTER (fresh), 0) + coalesce(any_value(extra), any_value(sl)) AS bigint) AS formatted_chars
FROM s LEFT JOIN x USING (conv_id) GROUP BY conv_id"""

SUBSTRING_SQL = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
  p AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, w FROM w),
  g AS (SELECT doc_id, n, word, i, CASE WHEN i + 19 <= n THEN array_to_string(w[i:i + 19], ' ') END AS g FROM p),
  f AS (SELECT doc_id, n, word, i, g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again FROM g),
  c AS (SELECT doc_id, word, i, count(*) FILTER (again) OVER (PARTITION BY doc_id ORDER BY i ROWS 19 PRECEDING) > 0 AS gone FROM f),
  k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

NEAR_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWERED)} AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  e AS MATERIALIZED (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2) JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
  r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
  c AS (SELECT x AS doc_id, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, d.doc_id <= coalesce(y, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

SUFFIX_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  b AS (SELECT doc_id, unnest(range(0, len(h) // 2)) AS i, h FROM h),
  g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 100 <= len(h) THEN substr(h, 2 * i + 1, 100) END AS g FROM b),
  f AS (SELECT doc_id, i, b, g IS NOT NULL AND min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM g),
  c AS (SELECT doc_id, i, b, count(*) FILTER (again) OVER (PARTITION BY doc_id ORDER BY i ROWS 49 PRECEDING) > 0 AS gone FROM f),
  l AS (SELECT *, coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM c),
  k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM l GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS bigint) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN k USING (doc_id)"""

QUERIES = {f.__name__: f for f in (op1_language_id, op2_chat_format, op9_media_columns, op10_byte_bpe)}

SQL: dict[str, str] = {"op2_chat_format": CHAT_SQL, "op3_substring_dedup": SUBSTRING_SQL, "op6_minhash_near_dedup": NEAR_SQL, "op8_suffix_dedup": SUFFIX_SQL}


def op3_substring_dedup(spark, sf_dir):
    from . import substring

    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES["op3_substring_dedup"] = op3_substring_dedup


def op8_suffix_dedup(spark, sf_dir):
    from . import suffix

    out = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES["op8_suffix_dedup"] = op8_suffix_dedup


def op6_minhash_near_dedup(spark, sf_dir):
    from . import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


QUERIES["op6_minhash_near_dedup"] = op6_minhash_near_dedup


def op4_lm_scoring(spark, sf_dir):
    from . import katz

    # order 3 is over the limit of CPU seconds: see the README
    return katz.score(table(spark, sf_dir, "documents"), lambda c: ~langid.held_out("doc_id", 7), order=2)


QUERIES["op4_lm_scoring"] = op4_lm_scoring


def op5_pack_tokens(spark, sf_dir):
    from . import packing

    base = core.folder(spark, "packed")
    index = core.written(packing.store(table(spark, sf_dir, "documents"), base, vocabulary=packing.public_vocabulary()), "packed-index")
    rows = packing.load(index, base).withColumn("ids_sha256", F.sha2("ids", 256))
    return rows.select("block", "row", "n_tokens", "cu_seqlens", "resets", "doc_ids", "starts", "offset", "length", "ids_sha256")


def op7_decontaminate(spark, sf_dir):
    from . import decontaminate

    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES |= {f.__name__: f for f in (op5_pack_tokens, op7_decontaminate)}


def op11_vector_codes(spark, sf_dir):
    from . import vectors

    return vectors.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _vector_sql() -> str:
    def near(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT rid, p, any_value(v) AS x, min({{'d': d, 'e': e}}) AS m FROM (
      SELECT rid, parts.p, e, parts.x AS v, CAST(list_sum(list_transform(range(1, len(parts.x) + 1), lambda i: (parts.x[i] - b.x[i]) * (parts.x[i] - b.x[i]))) AS bigint) AS d FROM parts JOIN b{k} b ON parts.p = b.p) GROUP BY rid, p)"""

    def moved(k: int) -> str:
        return f"""b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
      SELECT p, e, list(s ORDER BY i) AS x FROM (SELECT p, m.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS bigint) AS s FROM a{k}, range(1, (SELECT max(len(x)) + 1 FROM parts)) r(i) GROUP BY 1, 2, 3) GROUP BY 1, 2) m ON m.p = b.p AND m.e = b.e)"""

    return f"""
WITH k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  i AS (SELECT rid, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS double)) AS bigint)) AS v, len(embedding) // 16 AS w FROM k),
  parts AS MATERIALIZED (SELECT rid, p, v[p * w + 1:(p + 1) * w] AS x FROM i, range(16) r(p)),
  b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM parts WHERE rid <= 64),
  {near(0)}, {moved(0)}, {near(1)}, {moved(1)}, {near(2)},
  f AS MATERIALIZED (SELECT rid, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS bigint) AS error FROM a2 GROUP BY rid),
  h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, codebooks_sha256 FROM k JOIN f USING (rid), h"""


QUERIES["op11_vector_codes"] = op11_vector_codes
SQL["op11_vector_codes"] = _vector_sql()


def op12_best_fit(spark, sf_dir):
    from . import exactfit

    rows = exactfit.pack(table(spark, sf_dir, "documents"), vocabulary=exactfit.public_vocabulary())
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES["op12_best_fit"] = op12_best_fit


def op13_spelling_variants(spark, sf_dir):
    from . import variants

    return variants.group(table(spark, sf_dir, "documents"))


#: The table of crc32 comes from its polynomial; near words meet by the letters around each position.
VARIANT_SQL = """
WITH RECURSIVE t AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
  r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
  c AS (SELECT w, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS varchar), '') || ':' || w)) AS x FROM r GROUP BY doc_id, w),
  h AS (SELECT w, n, xor(list_reduce([CAST(4294967295 AS bigint)] || list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS bigint)), lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1])), 4294967295) AS h FROM c, t),
  e AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h),
  v AS MATERIALIZED (SELECT w, CAST(sum(n) AS bigint) AS n FROM e WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
  p AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i) AS a, substr(w, i + 2) AS z FROM v, LATERAL (SELECT unnest(range(length(w))) AS i)),
  l AS MATERIALIZED (SELECT DISTINCT p.w AS longer, s.w AS shorter FROM p JOIN v s ON s.w = p.a || p.z),
  y AS (SELECT x.w, y.w AS o FROM p x JOIN p y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.w <> y.w UNION ALL SELECT longer, shorter FROM l UNION ALL SELECT shorter, longer FROM l),
  b AS (SELECT y.w, count(*) AS n_near, min({'m': -v.n, 'o': o}) AS b FROM y JOIN v ON v.w = o GROUP BY y.w),
  f AS MATERIALIZED (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 10 * n THEN b.o END AS form, CASE WHEN -b.m >= 10 * n THEN -b.m END AS form_n FROM v LEFT JOIN b USING (w)),
  u AS (SELECT w, w AS root, form AS up FROM f UNION ALL SELECT u.w, f.w, f.form FROM u JOIN f ON f.w = u.up)
SELECT f.w AS word, form, root, n, n_near, form_n FROM f JOIN u ON u.w = f.w AND u.up IS NULL"""

QUERIES["op13_spelling_variants"] = op13_spelling_variants
SQL["op13_spelling_variants"] = VARIANT_SQL
