"""Checks and name lists as functions of Spark SQL, and known names as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from hushframe.functions import checks as C
from hushframe.functions import fixed_values as V

_CHECKS = {"is_luhn": C.luhn, "is_card": C.card, "is_iban": C.mod97, "is_gulf_iban": C.gulf, "is_ipv4": C.ipv4, "is_email": C.email_strict, "is_ssn": C.ssn}


def register(spark: SparkSession) -> list[str]:
    """The checks under their names, vectorised; null gives null."""
    for name, check in _CHECKS.items():
        spark.udf.register(name, F.pandas_udf(_over(check), "boolean"))
    return list(_CHECKS)


def _over(check: Callable[[str], bool]) -> Callable[[pd.Series], pd.Series]:
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else bool(x) and check(x) for x in s], dtype="object")

    return run


def known_name(word: Column, names: Iterable[str]) -> Column:
    """Whether a word, trimmed and in lower case, is among ``names``."""
    return F.lower(F.trim(word)).isin([n.lower() for n in names])


def arabic_first_name(word: Column) -> Column:
    return known_name(word, [*V.ARABIC_FIRST, *V.ARABIC_FIRST_FEMALE])


def arabic_family_name(word: Column) -> Column:
    """Also with the article before it."""
    bare = F.regexp_replace(F.lower(F.trim(word)), "^(al|el)[- ]?", "")
    return known_name(word, V.ARABIC_FAMILY) | known_name(bare, V.ARABIC_FAMILY)


def name_prefix(word: Column) -> Column:
    """Titles and the small words of Arabic names."""
    return F.regexp_replace(F.lower(F.trim(word)), r"\.$", "").isin("dr", "mr", "mrs", "ms", "prof", "bin", "bint", "ibn", "abu", "al", "el", "umm")
