"""Bodies of the corpus pipeline's stages: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mixing, neardup, pieces, private, quality
from .common import WORD, cut_lineage, free_name, word_count


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that pass the quality rules: enough words, not too repetitive, and the trained verdict.

    Null, empty and short texts fail; repeated rows get one verdict each, the same;
    without labelled rows the base rules decide alone; a probability of exactly the
    threshold passes.  Other columns, of whatever names, pass unread; an empty table
    gives no rows.
    """
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return quality.judge_documents(docs, quality.train_model(docs, labels), prefix=prefix).filter(F.col(f"{prefix}kept")).select(*docs.columns)


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Texts without words are near copies of nothing and stay, and so do rows without a
    doc_id.  Of rows that agree in doc_id and text one stays, whichever.  Different
    texts of one doc_id are documents of their own.  An empty table gives no rows;
    other columns pass unread.
    """
    named = docs.withColumn(th := free_name(docs, "th"), F.xxhash64("text"))
    plain = F.coalesce(~F.col("text").rlike(WORD), F.lit(True)) | F.col("doc_id").isNull()
    one = neardup.representatives(docs, words, similarity).withColumnsRenamed({"th": th})
    one = one.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    worded = named.filter(~plain).join(one, ["doc_id", th], "left_semi").dropDuplicates(["doc_id", th])
    return worded.unionByName(named.filter(plain)).select(*docs.columns)


def hide_private(docs: DataFrame, key: str) -> DataFrame:
    """Documents with pseudonyms for personal data: all rows stay, ``text`` (and ``n_chars``, if there) changes.

    Null and empty texts stay as they are, very long ones are treated like others,
    equal values get equal pseudonyms in all rows, repeated rows stay equal.  Other
    columns, of whatever names, pass unread; an empty table gives no rows.
    """
    return private.pseudonymise(docs, key, free_name(docs, "pii_kinds")).select(*docs.columns)


def mix_sources(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times).

    A null source is a source of its own.  Null and empty texts have no words, so a
    mix takes them by chance and they count for nothing; rows that agree in doc_id and
    text are taken equally often; equal sizes are told apart by a hash.  Other columns,
    of whatever names, pass unread; an empty table gives no rows.
    """
    sized = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("th")))
    mixed = mixing.cube_mix(sized, mixing.source_targets(sized)).groupBy("doc_id", "th").agg(F.max("times").alias("times")).filter("times > 0")
    doc, th, times = (free_name(docs, n) for n in ("mix_doc", "mix_th", "mix_times"))
    mixed = mixed.withColumnsRenamed({"doc_id": doc, "th": th, "times": times})
    taken = docs.join(mixed, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(th)))
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the decoded text of every row.

    A null text is empty: begin and end alone.  Repeated rows are encoded each; other
    columns are left out; an empty table gives no rows.
    """
    return pieces.encode_documents(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
