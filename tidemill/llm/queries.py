"""Queries that apply the operators to whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_cnn, chat_format, decontaminate, fim, mixing, quality_rules, simhash, suffix_dedup, token_counts, url_filter, warc, whitening
from .common import fresh_path

RULES = (
    url_filter.UrlRule("allow", "org/"),
    url_filter.UrlRule("block", "example.org/es/"),
    url_filter.UrlRule("block", "example.org/en/1"),
    url_filter.UrlRule("allow", "com/fr/"),
    url_filter.UrlRule("block", "com/de/"),
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table the URL model learns from: made-up hosts and paths, blocked or not."""
    bad = "casino win bets free ads track click pills poker slots lotto cheap spam porn xxx adult loans pharma prize bonus".split()
    good = "news blog wiki docs library school museum garden recipes science history music travel health sports weather books forum city review".split()
    rows = []
    for k, (x, y) in enumerate(zip(bad, bad[1:] + bad[:1], strict=True)):
        rows += [(f"https://{x}-{y}.example.{d}/{p}/{k * 37}", 1) for d, p in (("com", "en"), ("net", "de"), ("org", "fr"), ("com", "es"))]
        rows += [(f"http://www.{x}-online.test/offer.html", 1), (f"https://m.{y}-{x}.example.com/en/{k}?ref=x", 1)]
    for k, (x, y) in enumerate(zip(good, good[1:] + good[:1], strict=True)):
        rows += [(f"https://{x}.example.{d}/{p}/{k * 41}", 0) for d, p in (("com", "en"), ("net", "de"), ("org", "fr"), ("com", "es"))]
        rows += [(f"http://www.{x}{y}.test/{p}/{k}.html", 0) for p in ("en", "de", "fr", "es")]
        rows += [(f"https://m.{y}.example.net/en/{k}/", 0), (f"https://blog.{x}.example.org/es/{k * 7}", 0)]
    part = "ther than there hand ever real ling sion tower shore inner stone".split()
    for k, x in enumerate(part):
        rows += [(f"https://{x}{y}.example.{d}/{p}/{k * 53 + 9}", 0) for y in part[k % 3 :: 3] for d, p in (("com", "en"), ("net", "de"), ("org", "fr"), ("com", "es"))]
    rows += [("", 0)]
    return spark.createDataFrame(rows, "url string, blocked int")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = url_filter.fit(labelled_urls(spark))
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, RULES, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = F.col("stats")
    base = (s["w"]["n_words"] < 20) | (100 * s["w"]["n_repeat_words"] > 30 * s["w"]["n_words"])
    return judged.select(
        "doc_id", s["w"]["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"),
        s["l"]["n_dup_lines"].alias("n_dup_lines"), s["w"]["n_repeat_words"].alias("n_repeat_words"),
        base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.digests(warc.assemble(spark, path))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = byte_cnn.train(docs, labels.filter(~held).select("doc_id", F.col("quality").alias("label")))
    return byte_cnn.classify(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotate_perspectives(_table(spark, sf_dir, "conversations"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(ids).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened_rows(_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))  # null beyond 64 bits


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash": op3_simhash,
    "op4_url_filter": op4_url_filter,
    "op5_quality_rules": op5_quality_rules,
    "op6_warc": op6_warc,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_chat_format": op8_chat_format,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
    "op11_bpe": op11_bpe,
    "op12_whitening": op12_whitening,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op8_chat_format": chat_format.ORACLE_SQL,
    "op13_fill_in_middle": fim.ORACLE_SQL,
}
