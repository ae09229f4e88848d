"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm import ann, chat_format, embedding_dedup, language_id, line_dedup, lm_scoring, mixing, ngram_jaccard, packing, source_divergence, spelling, token_output, window_packing
from skyledger.llm.common import crc_mod, stored, table
from skyledger.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; one fifth of the documents never teaches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    found = language_id.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query("op6_token_output")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as token ids in block files, and per document what reading the files back gives."""
    path = scratch_path(spark, "token-blocks")
    token_output.write_token_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_output.read_token_blocks(spark, path).withColumnRenamed("key", "doc_id")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).withColumnRenamed("key", "doc_id")


@query("op3_mixing", """
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix' || coalesce(':' || doc_id::VARCHAR, '')), 1, 13))::BIGINT AS draw
  FROM documents),
s AS (SELECT no_source, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY no_source, src) - 1) % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap FROM s),
v AS (SELECT *, row_number() OVER l AS first, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(weight) OVER (l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW l AS (ORDER BY cap::DOUBLE / weight, no_source, src)),
t AS (SELECT *, least(cap::DOUBLE, coalesce((SELECT arg_min(level, first) FROM v WHERE level <= cap::DOUBLE / weight) * weight, cap::DOUBLE)) AS target FROM v),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole, target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM t),
z AS (SELECT no_source, src, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
y AS (SELECT z.*, rest, coalesce(sum(size * n) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS certain, sum(size * size * n) OVER (l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS below
      FROM z JOIN r ON r.no_source = z.no_source AND r.src = z.src WINDOW l AS (PARTITION BY z.no_source, z.src ORDER BY size DESC)),
i AS (SELECT no_source, src, max(size) AS bound, arg_max((rest - certain) / below::DOUBLE, size) AS scale, arg_max(rest - certain, size) AS sampled
      FROM y WHERE (rest - certain) / below::DOUBLE * size <= 1 GROUP BY ALL),
k AS (SELECT d.doc_id, d.size, d.draw, r.no_source, r.src, source_size, target, whole, bound, sampled, scale * d.size AS p, (draw + 0.5::DOUBLE) / 4503599627370496 AS u
      FROM d JOIN r ON d.no_source = r.no_source AND d.src = r.src LEFT JOIN i ON i.no_source = d.no_source AND i.src = d.src),
q AS (SELECT *, CASE WHEN size <= bound AND p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) END AS q FROM k),
c AS (SELECT *, sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER o AS total, sum(size) OVER (PARTITION BY no_source, src, q, draw) AS own FROM q WINDOW o AS (PARTITION BY no_source, src ORDER BY q NULLS LAST, draw))
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN size > bound OR (q IS NOT NULL AND total - own / 2.0::DOUBLE <= sampled) THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes from every document."""
    rows = mixing.draws(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    rows = stored(rows.select("doc_id", *mixing.SOURCE, "__size", "__draw"), "mix-sizes")
    return mixing.mix_sizes(rows).select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__copies")).alias("taken"))

#: Lines that line_dedup removes from texts of a view ``docs``: those that follow or precede another one that they followed or preceded earlier.
REPEATED_LINES = """
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM docs WHERE text IS NOT NULL),
f AS (SELECT doc_id, i, line, row_number() OVER w AS o, lead(line) OVER w AS next_line, lead(i) OVER w AS next_i FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, row_number() OVER (PARTITION BY line, next_line ORDER BY doc_id, i) > 1 AS again FROM f WHERE next_line IS NOT NULL),
g AS (SELECT doc_id, o, i, next_i FROM p WHERE again),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, next_i + 1)) AS i FROM g),
runs AS (SELECT doc_id, count(*) AS removed_chunks FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.doc_id = g.doc_id AND h.o = g.o - 1) GROUP BY 1),
deduped AS (SELECT l.doc_id, count(*)::INT AS n_lines, count(gone.i)::INT AS removed_lines, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL), '') AS text
            FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY 1)
"""


@query("op4_line_dedup", "WITH docs AS (SELECT * FROM documents)," + REPEATED_LINES + """
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(removed_lines, 0) AS removed_lines, coalesce(removed_chunks, 0)::INT AS removed_chunks, x.text
FROM docs d LEFT JOIN deduped x ON d.doc_id = x.doc_id LEFT JOIN runs ON runs.doc_id = d.doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without chunks of lines that occurred together before."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed_lines").alias("removed_lines"), F.col("__removed_chunks").alias("removed_chunks"), "text")


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in chat_format.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


@query("op5_chat_format", f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(chat_format.START + chat_format.SEPARATOR + chat_format.END)} + length({_escaped("role")}) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted as one chain of replies, and what reading the result back gives."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], rows.schema)
    text = [F.coalesce(F.col(c), F.lit("")) for c in ("role", "text")]
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", *text))
    chain = rows.unionByName(extra).withColumn("message_id", number).withColumn("parent_id", F.col("message_id") - 1).withColumn("score", F.lit(0))
    out = chat_format.format_chats(chain, order="message_id")
    turns = chat_format.read_turns(F.col("formatted"))
    loss = F.array_join(chat_format.read_loss(F.col("formatted"), F.col("loss")), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))), "")
    read = out.select(F.col("__conv").alias("conv_id"), turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


@query("op8_nearest_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for one row in twenty, among all rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), 20)


@query("op9_embedding_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of near-duplicate vectors of one label."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op7_ngram_jaccard")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingle sets have a Jaccard similarity of at least 0.9."""
    found = ngram_jaccard.join_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query("op2_lm_scoring")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, scored = lm_scoring.learn_and_score(docs, crc_mod(F.col("doc_id"), 7) != 2)
    return scored.select(F.col("key").alias("doc_id"), (crc_mod(F.col("key"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op11_spelling_variants", """
WITH RECURSIVE c AS (SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, x)) AS crc),
t AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
r AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM t WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [195, ord(x)::BIGINT - 64] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda v, x: xor(v >> 8, crc[(xor(v, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM b, c),
d AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
p AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w),
s AS (SELECT word, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM p),
near AS (
  SELECT a.word, b.word AS near FROM s a JOIN s b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT s.word, w.word FROM s JOIN w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM s JOIN w ON s.rest = w.word),
f AS (SELECT near.word, count(*) AS n_near, first(near.near ORDER BY w.n DESC, near.near) AS form, max(w.n) AS form_n FROM near JOIN w ON near.near = w.word GROUP BY near.word),
g AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM w LEFT JOIN f ON w.word = f.word),
u AS (SELECT word, form AS root, 1 AS step FROM g WHERE form IS NOT NULL UNION ALL SELECT u.word, g.form, step + 1 FROM u JOIN g ON u.root = g.word WHERE g.form IS NOT NULL),
last AS (SELECT word, arg_max(root, step) AS root FROM u GROUP BY word)
SELECT g.word, form, coalesce(root, g.word) AS root, n, n_near, form_n FROM g LEFT JOIN last ON g.word = last.word""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven code points or more and the frequent words that they may be misspelt from; one run in 31 loses a code point first."""
    runs = spelling.letter_runs(table(spark, sf_dir, "documents"), min_length=7)
    code = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    hashed = runs.select("run", code.alias("h"))
    cut = F.expr("CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, int(h % length(run))), substr(run, int(h % length(run)) + 2)) ELSE run END")
    return spelling.variants(spelling.counted_words(hashed.select(cut.alias("word"))))


@query("op12_window_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens that keep the stored order."""
    pieces = window_packing.pack_in_order(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumnRenamed("key", "doc_id")


@query("op13_source_divergence", """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * v.v) AS p,
    1 + 1000000000::HUGEINT * (k.n + 2) // (v.total + 2 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
y AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM x UNION ALL FROM y))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM z WHERE part = 'pair' OR rank <= 10""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that each has more of than its language."""
    return source_divergence.audit(table(spark, sf_dir, "documents"))
