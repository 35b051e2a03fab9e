"""Line-first cleaning with DataFrame functions only.

Every line of a text is judged by punctuation (its end, its symbols), navigation and
boilerplate rules; failing lines are removed, and a document that loses too much of its
text, or fails the document rules, is rejected.

Defined results: a null text counts as empty; an empty text has no words and
fails the minimum length; repeated rows each get a row; an empty table gives an
empty result; only the id and text columns are read, so extra columns with any
names do no harm.  Work is per row, so very long texts need memory only for
their own arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
SPACE_RE = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
# Phrases of notices and controls, in English, German, French and Spanish.
BOILERPLATE = (
    "licensed under|all rights reserved|copyright|privacy policy|cookie policy|"
    "accept cookies|terms of (use|service)|sign in|log in|enable javascript|subscribe to|"
    "alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|cookies akzeptieren|"
    "tous droits réservés|politique de confidentialité|conditions d.utilisation|accepter les cookies|"
    "todos los derechos reservados|política de privacidad|condiciones de uso|aceptar cookies|iniciar sesión"
)
#: Such a phrase as whole words.
PHRASE = rf"(^|[^\p{{L}}\p{{N}}])({BOILERPLATE})([^\p{{L}}\p{{N}}]|$)"
#: What ends a sentence, or a line that goes on or is quoted; white space may follow.
ENDED = r"""[.!?…:;,。！？：；、"'”’»)\]]\s*$"""


def words(text: Column) -> Column:
    """Array of the words of a text, without empty ones."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def line_fails(line: Column, symbol_share: float = 0.05, max_separators: int = 2, phrase_chars: int = 160) -> Column:
    """Whether a line with words is navigation, boilerplate or not prose.

    A phrase of boilerplate counts in a line of up to ``phrase_chars`` characters: longer
    ones are prose that speaks of such things."""
    length = F.length(line)
    symbols = F.length(F.regexp_replace(line, f"[^{SYMBOLS}]+", ""))
    separators = F.size(F.split(line, r" [|»>] ")) - 1
    shouts = F.size(F.split(line, "!!")) - 1
    no_letter = ~line.rlike(r"\p{L}")
    return (
        no_letter
        | (symbols > symbol_share * length)
        | (shouts >= 3)
        | (separators >= max_separators)
        | ~line.rlike(ENDED)
        | ((length <= phrase_chars) & line.rlike(f"(?iu){PHRASE}"))
    )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 10,
    window: int = 5,
    max_repeat_percent: int = 20,
    min_kept_share: float = 0.5,
) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_lines, n_failed_lines, clean_text.

    ``clean_text`` is the text without its failing lines; ``kept`` is false for
    documents that fail the document rules or whose remaining lines hold less
    than ``min_kept_share`` of the characters of all lines.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.select("_id", "_t", words(F.col("_t")).alias("_w"), F.split("_t", "\n").alias("_l"))
    hashes = F.when(
        F.size("_w") >= window,
        F.transform(
            F.sequence(F.lit(0), F.size("_w") - window),
            lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(window)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    has_word = F.filter("_l", lambda x: F.btrim(x, F.lit(SPACE)) != "")
    d = d.select(
        "_id",
        "_t",
        F.size("_w").alias("_n"),
        F.length(F.array_join("_w", "")).alias("_chars"),
        has_word.alias("_hl"),
        F.size("_l").alias("_nl"),
        F.transform("_l", lambda x: F.struct(x.alias("l"), ((F.btrim(x, F.lit(SPACE)) != "") & line_fails(x)).alias("f"))).alias("_lf"),
        hashes.alias("_h"),
    )
    # Only texts with an equal pair of windows pay for the sort.
    ordered = F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
    )
    d = d.withColumn("_s", ordered)
    equal = F.filter(
        "_s",
        lambda e, i: F.coalesce(e["h"] == F.get(F.col("_s"), i - 1)["h"], F.lit(False))
        | F.coalesce(e["h"] == F.get(F.col("_s"), i + 1)["h"], F.lit(False)),
    )
    d = d.withColumn("_p", F.sort_array(F.transform(equal, lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("_p", lambda x, i: F.least(F.lit(window), F.coalesce(F.get(F.col("_p"), i + 1) - x, F.lit(window)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    d = d.select(
        "_id",
        F.col("_n").cast("long").alias("n_words"),
        F.col("_chars").cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_hl") - F.size(F.array_distinct("_hl"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("_nl").cast("long").alias("n_lines"),
        F.size(F.filter("_lf", lambda x: x["f"])).cast("long").alias("n_failed_lines"),
        F.array_join(F.transform(F.filter("_lf", lambda x: ~x["f"]), lambda x: x["l"]), "\n").alias("clean_text"),
        F.length(F.replace(F.col("_t"), F.lit("\n"), F.lit(""))).alias("_all"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.length(F.replace(F.col("clean_text"), F.lit("\n"), F.lit("")))
    return d.select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= min_kept_share * F.col("_all"))).alias("kept"),
        "n_lines",
        "n_failed_lines",
        "clean_text",
    )


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).drop("clean_text")


_WS = r"[ \t\n\v\f\r]+"
OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') AS w,
         string_split(t, chr(10)) AS l
  FROM d
), f AS (
  SELECT doc_id, t, w, l,
    list_filter(l, lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) AS hl,
    list_filter(l, lambda x: regexp_matches(x, '[^ \t\n\v\f\r]') AND (
        NOT regexp_matches(x, '\p{{L}}')
        OR length(regexp_replace(x, '[^{SYMBOLS}]+', '', 'g')) > 0.05 * length(x)
        OR len(string_split(x, '!!')) - 1 >= 3
        OR len(regexp_split_to_array(x, ' [|»>] ')) - 1 >= 2
        OR NOT regexp_matches(x, '{ENDED.replace("'", "''")}')
        OR length(x) <= 160 AND regexp_matches(x, '(?i){PHRASE}'))) AS bad
  FROM w
), r AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (
    SELECT doc_id, unnest(range(p, p + 5)) AS q FROM (
      SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, h) AS c FROM (
        SELECT doc_id, unnest(range(1, len(w) - 3)) AS p,
               unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS h
        FROM w WHERE len(w) >= 5)) WHERE c > 1) GROUP BY doc_id
), o AS (
  SELECT f.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g'))::BIGINT AS n_symbols,
    (len(hl) - len(list_distinct(hl)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, len(bad)::BIGINT AS n_failed_lines,
    length(array_to_string(l, '')) AS whole, coalesce(length(array_to_string(bad, '')), 0) AS lost
  FROM f LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND whole - lost >= 0.5 * whole AS kept,
  n_lines, n_failed_lines
FROM o
"""
QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": OP1_SQL}
