"""The three string functions Spark has no expression for, as Arrow-batched UDFs; rows that need none are passed as NULL."""

from __future__ import annotations

import html
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def _ascii(host: str | None) -> str | None:
    try:
        return host if host is None or host.isascii() else host.encode("idna").decode("ascii")
    except UnicodeError:
        return None


@F.pandas_udf(StringType())
def to_ascii(hosts: pd.Series) -> pd.Series:
    return hosts.map(_ascii)


#: What ``html.unescape`` looks up, the longest that can be one: an entity alone is undone as it is in its text.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.arrow_udf(ArrayType(StringType()))
def entities_undone(found: pa.Array) -> pa.Array:
    """Each list of entities as what they stand for; each spelling is undone once a batch."""
    sizes = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    coded = found.flatten().dictionary_encode()
    plain = pa.array([html.unescape(e) for e in coded.dictionary.to_pylist()], pa.string())
    ends = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(ends, plain.take(coded.indices), mask=found.is_null())


@F.pandas_udf(StringType())
def url_join(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else urljoin(b, h) for b, h in zip(base, href, strict=True)], dtype=object)
