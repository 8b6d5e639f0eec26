"""The subpackage's registered queries, each over its whole table, and their SQL where it can be stated."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rainweave.llm import (chat_format, decontaminate, language_id, lexical_search, license_scan, line_dedup, neighbours, ngram_join, sentencepiece_codec,
                           spelling, substring_dedup, toxicity, warc)
from rainweave.session import checkpoint_dir

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def piece_model(path: str = PIECE_MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


@query("op1_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
newest AS (SELECT payload_digest, max(page_id) AS newest FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN newest > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN newest > page_id THEN newest END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM p LEFT JOIN newest USING (payload_digest)""")
def op1_warc(spark, sf):
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(warc.classify(read(spark, sf, "pages")), folder)
    return warc.resolve_revisits(warc.reassemble(warc.read_archives(spark, folder)))


@query("op2_substring_dedup", r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS pos, words FROM w WHERE len(words) >= 13),
k AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + 12], ' ')) AS h FROM s),
low AS (SELECT h, min(doc_id) AS low FROM k GROUP BY h),
gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM k JOIN low USING (h), range(13) AS r(j) WHERE doc_id > low),
kept AS (SELECT doc_id, pos, words[pos] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w)),
left_over AS (SELECT kept.doc_id, string_agg(word, ' ' ORDER BY kept.pos) AS text, count(*) AS n FROM kept
              LEFT JOIN gone ON gone.doc_id = kept.doc_id AND gone.pos = kept.pos WHERE gone.pos IS NULL GROUP BY kept.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(left_over.text, '')) AS kept_sha256
FROM w LEFT JOIN left_over ON left_over.doc_id = w.doc_id""")
def op2_substring_dedup(spark, sf):
    return substring_dedup.remove_repeated(read(spark, sf, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op3_ngram_jaccard_join")
def op3_ngram_jaccard_join(spark, sf):
    return ngram_join.similar_components(read(spark, sf, "documents"))


@query("op4_decontamination")
def op4_decontamination(spark, sf):
    return decontaminate.contained_items(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("op5_preference_format")
def op5_preference_format(spark, sf):
    return chat_format.format_preferences(*chat_format.with_substitute_reply(read(spark, sf, "conversations")))


def document_files(documents: DataFrame) -> DataFrame:
    """Documents as files of a source tree: two directory levels by number; every twentieth is a licence file, at one of three levels."""
    thousand, hundred = F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100)
    level = F.pmod(F.floor(F.col("doc_id") / 20), F.lit(3))
    is_licence = F.pmod("doc_id", F.lit(20)) == 0
    root = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")))
    folder = F.when(is_licence & (level == 0), root).when(is_licence & (level == 1), F.concat_ws("/", root, thousand.cast("string"))).otherwise(
        F.concat_ws("/", root, thousand.cast("string"), hundred.cast("string")))
    name = F.concat(F.when(is_licence, F.lit("LICENSE-")).otherwise(F.lit("doc-")), F.col("doc_id").cast("string"))
    return documents.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", folder, name).alias("path"), "text")


@query("op6_license_scan")
def op6_license_scan(spark, sf):
    return license_scan.scan(document_files(read(spark, sf, "documents"))).withColumnRenamed("file_id", "doc_id")


@query("op7_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
           FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k.doc_id <> coalesce(r.keeper, k.doc_id)) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE k.doc_id = coalesce(r.keeper, k.doc_id)), '')) AS kept_sha256
FROM k LEFT JOIN r ON r.key = k.key GROUP BY k.doc_id""")
def op7_line_dedup(spark, sf):
    return line_dedup.dedup_lines(read(spark, sf, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op8_language_id")
def op8_language_id(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang", held_out().alias("held_out"))
    model = language_id.fit(docs.where("not held_out"))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


@query("op9_sentencepiece")
def op9_sentencepiece(spark, sf):
    rows = sentencepiece_codec.encode_texts(read(spark, sf, "documents"), piece_model())
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


@query("op10_nearest_neighbours")
def op10_nearest_neighbours(spark, sf):
    vectors = read(spark, sf, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query("op11_toxicity")
def op11_toxicity(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", held_out().alias("held_out"))
    model = toxicity.fit(docs, read(spark, sf, "labels").where(~held_out()))
    rows = toxicity.predict(docs, model, keep=("doc_id", "held_out")).select("kept.*", "score")
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query("op12_lexical_search", r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
size AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
whole AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS length FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM b) GROUP BY doc_id, term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
impact AS (SELECT tf.doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length)))) AS value
           FROM tf JOIN size ON size.doc_id = tf.doc_id JOIN weight ON weight.term = tf.term, whole),
scored AS (SELECT item_id, doc_id, CAST(sum(value) AS BIGINT) AS score FROM b JOIN impact ON impact.term = b.term GROUP BY item_id, doc_id HAVING sum(value) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""")
def op12_lexical_search(spark, sf):
    return lexical_search.rank_documents(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("op13_spelling_variants", r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
                              lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run
         FROM documents),
own AS (SELECT doc_id, run, count(*) AS n, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS digits FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT),
                  list_transform(range(len(digits) // 2), lambda k: CAST('0x' || digits[2 * k + 1:2 * k + 2] AS UBIGINT))),
                  lambda c, b: xor(c >> 8, steps[CAST(xor(c, b) & 255 AS BIGINT) + 1]))) AS h FROM own, crc),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT n, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, pos, left(word, pos - 1) AS head, substr(word, pos + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM w)),
pairs AS (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.pos = y.pos AND x.head = y.head AND x.tail = y.tail AND x.word <> y.word
          UNION SELECT cut.word, w.word FROM cut JOIN w ON w.word = head || tail UNION SELECT w.word, cut.word FROM cut JOIN w ON w.word = head || tail),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, {'less': -w.n, 'word': encode(b)}) AS top, max(w.n) AS top_n FROM pairs JOIN w ON w.word = b GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * w.n THEN top END AS form, CASE WHEN top_n >= 10 * w.n THEN top_n END AS form_n
          FROM w LEFT JOIN best ON best.word = w.word),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL)
SELECT forms.word, form, walk.root, n, n_near, form_n FROM forms JOIN walk ON walk.word = forms.word
WHERE walk.root NOT IN (SELECT word FROM forms WHERE form IS NOT NULL)""")
def op13_spelling_variants(spark, sf):
    return spelling.spelling_variants(spelling.word_counts(read(spark, sf, "documents"), damage_every=31))
