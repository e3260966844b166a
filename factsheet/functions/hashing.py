"""Digests: source ids, table fingerprints and token buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factsheet.functions.columns import value
from factsheet.functions.text import printed

TOKEN = r"[\p{L}\p{N}]+"


def decoded(path: Column) -> Column:
    """A path or file name of ``_metadata``, which Spark gives URL-encoded, as it is on disk."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def source_id(path: Column, content: Column, prefix: str = "") -> Column:
    """``<stem>_<16 hex digits>`` of a file's full path and a digest of its content.

    The same file always gets the same id, a changed one a new id, and files of one name in two folders get two.
    """
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", ""), " ", "_")
    digest = F.md5(F.concat_ws("\x00", path, content))
    return F.concat(F.lit(prefix), stem, F.lit("_"), F.substring(digest, 1, 16))


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """48 bits of the md5 of a row's cells as an exact decimal, ready to be summed."""
    cells = [
        F.coalesce(printed(value(df, n), df.schema[n].dataType), F.lit("\x00")) for n in columns
    ]
    digest = F.md5(F.concat_ws("\x1f", *cells))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(20,0)")


def fingerprint(columns: Sequence[str], rows: Column, digest_sum: Column) -> Column:
    """Digest of header, row count and digest sum: independent of row order and partitioning."""
    return F.md5(
        F.concat_ws(
            "\x1f",
            F.lit("\x1e".join(columns)),
            rows.cast("string"),
            F.coalesce(digest_sum.cast("decimal(38,0)").cast("string"), F.lit("0")),
        )
    )


def token_buckets(text: Column, dimension: int) -> Column:
    """The bucket of every word of a text, repeats included."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.transform(
        words,
        lambda w: (F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("bigint") % dimension).cast("int"),
    )
