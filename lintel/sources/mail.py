"""Pages in MIME archives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mail_html(mails: DataFrame, key: str, content: str) -> DataFrame:
    """key and html: the first HTML part of MIME archives, null where there is none."""
    import email

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, raw in zip(batch[key], batch["_raw"], strict=True):
                parts = [p for p in email.message_from_bytes(raw or b"").walk() if p.get_content_type() == "text/html"]
                body = parts[0].get_payload(decode=True).decode(parts[0].get_content_charset() or "utf-8", "replace") if parts else None
                out.append((name, body))
            yield pd.DataFrame(out, columns=[key, "html"])

    kind = mails.schema[key].dataType.simpleString()
    return mails.select(key, F.col(content).alias("_raw")).mapInPandas(read, f"{key} {kind}, html string")
