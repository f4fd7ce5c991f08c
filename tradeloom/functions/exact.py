"""Small Arrow helpers for what no built-in function gives: Unicode forms and canonical JSON."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(StringType())
def _nfkd(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD")


def normalized(c: Column, form: str) -> Column:
    """Text in form NFKC or NFKD; only text beyond ASCII is sent to Python."""
    beyond = c.rlike("[^\\x00-\\x7f]")
    helper = {"NFKC": _nfkc, "NFKD": _nfkd}[form]
    return F.when(beyond, helper(F.when(beyond, c))).otherwise(c)


def with_normalized(df: DataFrame, columns: dict[str, str], form: str) -> DataFrame:
    """df with further columns: new name -> column whose text is wanted in the form. Rows of plain ASCII pass no Python."""
    text = df.withColumns({new: F.col(c).cast("string") for new, c in columns.items()})
    beyond = F.coalesce(F.greatest(*[F.coalesce(F.col(c).rlike("[^\\x00-\\x7f]"), F.lit(False)) for c in columns], F.lit(False)), F.lit(False))
    helper = {"NFKC": _nfkc, "NFKD": _nfkd}[form]
    return text.where(~beyond).union(text.where(beyond).withColumns({c: helper(F.col(c)) for c in columns}))


@F.pandas_udf(StringType())
def content_hash(body: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text written anew: keys sorted, ', ' and ': ' between, beyond ASCII escaped. Null stays null."""
    return body.map(lambda b: None if b is None else hashlib.sha256(json.dumps(json.loads(b), sort_keys=True).encode()).hexdigest())
