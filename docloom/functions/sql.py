"""Functions for SQL users.

Those with short definitions are SQL functions, which Catalyst expands into plain expressions.  The canonical form of a
URL is too long for one; SQL users get it as an Arrow-batched Python function, DataFrame users should prefer
``docloom.functions.urls.normalize_url``.
"""

from __future__ import annotations

from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from docloom.functions.urls import TRACKING_PARAMS

BODIES = {
    "content_hash(c STRING) RETURNS STRING": "sha2(c, 256)",
    "accession_number(u STRING) RETURNS STRING": r"nullif(regexp_extract(u, '([0-9]{10}-[0-9]{2}-[0-9]{6})', 1), '')",
    "url_domain(u STRING) RETURNS STRING": r"lower(regexp_extract(u, '^[\\x00-\\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))",
    "quarter_start(t TIMESTAMP) RETURNS DATE": "CAST(date_trunc('quarter', t) AS DATE)",
    "backoff_seconds(attempt INT) RETURNS DOUBLE": "least(1.0D * pow(2.0D, attempt), 60.0D)",
}


def canonical(url: str | None) -> str | None:
    """Canonical form of one URL by Python's parser; null if the parser refuses it."""
    if not url:
        return ""
    try:
        parts = urlparse(url.strip())
    except ValueError:
        return None
    scheme, host = parts.scheme, parts.netloc.lower()
    for name, port in (("http", ":80"), ("https", ":443")):
        if scheme == name:
            host = host.removesuffix(port)
    kept = sorted((k, v) for k, v in parse_qs(parts.query, keep_blank_values=True).items() if k.lower() not in TRACKING_PARAMS)
    return urlunparse((scheme, host, parts.path.rstrip("/") or "/", "", urlencode(kept, doseq=True), ""))


@udtf(returnType="pos int, sentence string")
class SplitSentences:
    """Sentences of a text, for LATERAL joins."""

    def eval(self, text: str):
        import re

        for i, s in enumerate(re.findall(r"[^.!?]+[.!?]*", text or "")):
            yield i, s


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; their names."""
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @F.pandas_udf("string")
    def normalize_url(urls: pd.Series) -> pd.Series:
        return urls.map(canonical)

    spark.udf.register("normalize_url", normalize_url)
    spark.udtf.register("split_sentences", SplitSentences)
    return [h.split("(")[0] for h in BODIES] + ["normalize_url", "split_sentences"]
