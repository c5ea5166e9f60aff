"""Exact dedup: 128-bit content hash, smallest id stays, bytes compared inside groups.

All DataFrame functions. The grouping key is the hash *and* the normalised text
itself, so Spark compares the bytes of rows that share a hash and two texts with
one hash never fall together. The partial aggregate folds copies before the
shuffle: a hot group reaches the reducer as one row per task. Rows find their
class again by two digests, so no text is shuffled a second time; that join is
between two plain exchanges, which adaptive execution splits where a class is hot.

Defined cases: null text counts as empty; a null id is never the smallest unless
all ids of the class are null (``keep_id`` is then null and the rows stay); rows
that repeat an id and its text share one verdict; other columns of the input,
whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    text = F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), SPACES, " ")
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("norm")).select("doc_id", "norm", F.unhex(F.md5("norm")).alias("content"))
    classes = (
        rows.groupBy("content", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("content", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    keyed = rows.select("doc_id", "content", F.sha2("norm", 256).alias("text_sha256"))
    return keyed.join(classes, ["content", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


ORACLE = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
