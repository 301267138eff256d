"""The two functions that SQL users may call by name: ``tokenize(text)`` and the table function ``ngrams(tokens, n)``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fumikura.operators import neardup


def cut(text: str | None) -> list[str] | None:
    """Words of a text in lower case: a letter of Han or kana is one, and so is a run of other letters and digits."""
    if text is None:
        return None
    t = text.lower()
    cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    cls = neardup._classes()[cp]
    edge = np.flatnonzero(np.concatenate([[True], (cls[1:] != cls[:-1]) | (cls[1:] == 2)])) if len(cp) else np.zeros(0, int)
    ends = np.append(edge[1:], len(cp))
    return [t[a:b] for a, b in zip(edge.tolist(), ends.tolist()) if cls[a]]


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize(s: pd.Series) -> pd.Series:
    return s.map(cut, na_action="ignore")


class Ngrams:
    """pos (from 1) and ngram of every run of n tokens; none for null, for too few tokens or for n below 1."""

    def eval(self, tokens: list[str] | None, n: int | None):
        for p in range(len(tokens) - n + 1) if tokens is not None and n is not None and n > 0 else ():
            yield p + 1, " ".join(x or "" for x in tokens[p : p + n])


def register(spark: SparkSession) -> None:
    spark.udf.register("tokenize", tokenize)
    spark.udtf.register("ngrams", F.udtf(Ngrams, returnType="pos int, ngram string"))


__all__ = ["Ngrams", "cut", "register", "tokenize"]
