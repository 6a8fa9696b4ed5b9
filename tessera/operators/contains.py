"""Which terms of a list occur in texts: one walk over each text, by an automaton over all terms."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a list that counts as small.
MOST = 10_000
#: Terms and letters of one automaton; longer lists are dealt to several, each of which walks over the texts.
TERMS, LETTERS = 200_000, 8 << 20

_BUILT: dict = {}


def is_small(terms: DataFrame, most: int = MOST) -> bool:
    return terms.limit(most + 1).count() <= most


def _automaton(name: str, terms: Sequence[str]):
    """In a worker: the automaton of a list, the last one built is kept."""
    if name not in _BUILT:
        _BUILT.clear()
        made = ahocorasick.Automaton()
        for t in terms:
            made.add_word(t, t)
        made.make_automaton()
        _BUILT[name] = made
    return _BUILT[name]


class Terms:
    """A list of distinct terms, none empty, ready to be looked for in a column."""

    def __init__(self, spark: SparkSession, terms: Sequence[str]):
        self.size, self.name = len(terms), uuid.uuid4().hex
        self.shared = spark.sparkContext.broadcast(list(terms)) if terms else None

    def found(self, text: Column) -> Column:
        """ARRAY of the terms that occur in a text, sorted; of a null text none."""
        if not self.size:
            return F.array().cast("array<string>")
        shared, name = self.shared, self.name

        @F.pandas_udf("array<string>")
        def of(texts: pd.Series) -> pd.Series:
            walk = _automaton(name, shared.value)
            return pd.Series([sorted({t for _, t in walk.iter(x)}) if x else [] for x in texts], dtype=object)

        return of(text)

    def any(self, text: Column) -> Column:
        """Whether one of the terms occurs in a text; in a null text none does."""
        if not self.size:
            return F.lit(False)
        shared, name = self.shared, self.name

        @F.pandas_udf("boolean")
        def of(texts: pd.Series) -> pd.Series:
            walk = _automaton(name, shared.value)
            return pd.Series([bool(x) and next(walk.iter(x), None) is not None for x in texts], dtype=bool)

        return of(text)


def lists(terms: DataFrame, term: str, most: int = TERMS) -> list[Terms]:
    """The distinct terms, dealt by hash to as few lists as their number and letters allow; a list is what the driver holds at once."""
    wanted = terms.select(F.col(term).alias("term")).where(F.col("term") != "").distinct()
    n, letters = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    parts = max(1, math.ceil(n / most), math.ceil(letters / LETTERS))
    dealt = lambda i: wanted.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == i) if parts > 1 else wanted
    return [Terms(terms.sparkSession, sorted(r["term"] for r in dealt(i).collect())) for i in range(parts)]


def containing(texts: DataFrame, text: str, terms: DataFrame, term: str, most: int = TERMS) -> DataFrame:
    """texts joined with each of the terms that occurs in them, once. Column names of the two must differ.

    Rows stay where they are: each list of up to `most` terms is looked for on the way, and what was found joins the
    terms' other columns on the term. Empty terms occur nowhere.
    """
    out = None
    for part in lists(terms, term, most):
        hits = texts.withColumn("_term", F.explode(part.found(F.col(text))))
        out = hits if out is None else out.unionByName(hits)
    return out.join(terms, F.col("_term") == F.col(term)).drop("_term")
