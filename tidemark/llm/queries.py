"""The queries of the numbered operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anagram, ann, bpe, exact_dedup, html_text, language, line_dedup, mixing, near_dedup, periodic, piecewise, token_file, toxicity
from .shared import SPACE


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train_folds(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", (toxicity.fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    learn = docs.where(toxicity.fold("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), "text", "lang")
    found = language.language(docs, language.fit(learn))
    return found.select("doc_id", (toxicity.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return ann.search(ann.build(vectors), vectors.where("vec_id % 100 = 0"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), digests=True)


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piecewise.beside_next(_read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        piecewise.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        piecewise.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def misspelled(docs: DataFrame) -> DataFrame:
    """word: every run of letters of the texts, in lower case (A-Z alone), of which one in 97, by the hash of id and run, loses a letter.
    Runs too short to be counted are left out. Without an id none loses one."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{anagram.LETTERS}]{{{anagram.LEAST_LETTERS},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", anagram.lower_letters(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return runs.select(F.when(h % 97 == 0, less).otherwise(F.col("run")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anagram.group_variants(anagram.count_words(misspelled(_read(spark, sf_dir, "documents"))))


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id, text: one document in ten, by the hash of its id, repeats a stretch of words from a place in it to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col("text"), F.lit(f"[^{SPACE}]+"), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(words, 1, a), F.slice(again, 1, n - a)), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(repeating(_read(spark, sf_dir, "documents")))
    none = F.lit(None).cast(periodic.RUN)
    # Runs are in order of start and period, so of equal exponents the first stays.
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.reduce("runs", none, lambda best, r: F.when(more(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_ann, op3_bpe, op4_exact_dedup, op5_toxicity, op6_language, op7_mix_sources, op8_html_text, op9_token_file, op10_line_dedup,
        op11_fingerprints, op12_spelling_variants, op13_periodic_runs,
    )
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": f"""
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
               text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op7_mix_sources": r"""
        WITH d AS (
            SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
            FROM documents),
        b AS (
            SELECT *, length(bin(size)) AS bits, size >> greatest(length(bin(size)) - 4, 0) AS top,
                   md5(coalesce(doc_id::VARCHAR, ''))[1:2] AS spread
            FROM d),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (
            SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
                   3 * source_size AS cap
            FROM s),
        f AS (
            SELECT *, sum(source_size) OVER () AS total,
                   coalesce(sum(cap) OVER p, 0) AS cap_before,
                   sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS weight_left
            FROM w
            WINDOW p AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (
            SELECT *, (total - cap_before)::DOUBLE / weight_left::DOUBLE AS level FROM f),
        a AS (
            SELECT arg_min(level, cap_before) AS lvl FROM l WHERE cap > level * weight),
        t AS (
            SELECT source, source_size,
                   CASE WHEN lvl IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, lvl * weight) END AS target,
                   ('0x' || md5('7:' || coalesce(source, ''))[1:8])::BIGINT / 4294967296.0::DOUBLE AS u
            FROM l LEFT JOIN a ON true),
        n AS (
            SELECT b.*, row_number() OVER (PARTITION BY source
                   ORDER BY bits, top, spread, size, doc_id ASC NULLS LAST, digest) AS n
            FROM b),
        c AS (
            SELECT n.*, t.source_size, t.target, t.u,
                   CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size::DOUBLE, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS share
            FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, source,
               ((floor(n * share + u) - floor((n - 1) * share + u)) * size)::BIGINT AS taken
        FROM c
    """,
    "op10_line_dedup": r"""
        WITH d AS (
            SELECT doc_id, text, md5(coalesce(text, '')) AS digest,
                   coalesce('s' || source, 'n') AS site, string_split(text, chr(10)) AS lines
            FROM documents),
        x AS (
            SELECT doc_id, digest, site, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS no FROM d),
        l AS (
            SELECT doc_id, digest, site, no, trim(line, chr(32) || chr(9) || chr(13)) AS bare FROM x),
        k AS (
            SELECT *, row_number() OVER (PARTITION BY bare ORDER BY doc_id ASC NULLS LAST, no, digest) AS r,
                   first_value((doc_id, no, digest)) OVER (PARTITION BY bare ORDER BY doc_id ASC NULLS LAST, no, digest) AS top
            FROM l WHERE bare <> ''),
        b AS (
            SELECT bare FROM l WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= 4),
        g AS (
            SELECT doc_id, digest, list(DISTINCT no) AS goes FROM k
            WHERE bare IN (SELECT bare FROM b) AND (doc_id, no, digest) IS DISTINCT FROM top
            GROUP BY doc_id, digest)
        SELECT d.doc_id,
               coalesce(len(lines), 0)::BIGINT AS n_lines,
               coalesce(len(goes), 0)::BIGINT AS n_removed,
               CASE WHEN goes IS NULL THEN text
                    ELSE array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(goes, i - 1)], chr(10)) END AS text
        FROM d LEFT JOIN g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.digest = g.digest
    """,
    "op12_spelling_variants": rf"""
        WITH RECURSIVE t AS (
            SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                                lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS crc),
        r AS (
            SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{5,}}')) AS run FROM documents),
        o AS (
            SELECT doc_id, translate(run, '{_UPPER}', '{_UPPER.lower()}') AS run, count(*) AS times FROM r GROUP BY 1, 2),
        h AS (
            SELECT run, times, xor(list_reduce(list_prepend(4294967295,
                       [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode(doc_id || ':' || run)), '..')]),
                       lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h
            FROM o, t),
        w AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times
            FROM h),
        v AS MATERIALIZED (
            SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
        i AS (
            SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
        holes AS MATERIALIZED (
            SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole,
                   substr(word, 1, i - 1) || substr(word, i + 1) AS less
            FROM i),
        near AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
            UNION SELECT a.word, v.word, v.n FROM holes a JOIN v ON a.less = v.word
            UNION SELECT v.word, a.word, a.n FROM holes a JOIN v ON a.less = v.word),
        best AS (
            SELECT word, count(*) AS n_near, min({{'least': -near_n, 'near': near}}) AS best FROM near GROUP BY word),
        formed AS MATERIALIZED (
            SELECT v.word, v.n, coalesce(n_near, 0) AS n_near,
                   CASE WHEN -best.least >= 2 * n THEN best.near END AS form, CASE WHEN -best.least >= 2 * n THEN -best.least END AS form_n
            FROM v LEFT JOIN best ON v.word = best.word),
        walk AS (
            SELECT word, word AS here, form AS next FROM formed
            UNION ALL SELECT walk.word, formed.word, formed.form FROM walk JOIN formed ON walk.next = formed.word)
        SELECT word, form, here AS root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n
        FROM formed JOIN walk USING (word) WHERE walk.next IS NULL
    """,
}
